"""The registered queries against their SQL, and that the engine stands without its optional parts."""

import math
import os
import pathlib

import pytest

from tableproof.queries import QUERIES
from tableproof.queries_sql import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)), key=str)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_nothing_imports_the_training_data_operators():
    root = pathlib.Path(__file__).parents[1] / "tableproof"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tableproof.llm" not in path.read_text(), path
