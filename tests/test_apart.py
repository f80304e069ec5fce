"""The engine stands without its optional parts."""

import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[1]


def test_works_without_the_training_data_operators(tmp_path):
    """A copy without both llm folders and the pipeline imports, registers its queries and knows none of the others."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 70; assert not any(n == 'pipeline' or n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout
