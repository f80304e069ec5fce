import os
import random
from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_pipeline_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF).checkpoint()
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before
    out = pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "taken", "copies"]
    rows = out.collect()
    assert 0 < len(rows) <= kept.count()
    assert all(0 < r["taken"] <= 2 * len(r["text"].split()) for r in rows)


def test_stages_named():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    assert pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("rows", [0, 1])
def test_stages_take_odd_tables(spark, rows):
    """Nulls in every column, repeated rows, no rows, and columns named as the stages' own."""
    extra = ["row", "id", "version", "key", "rid", "rv", "_n_removed", "n_removed", "taken", "_taken", "copies", "n", "h", "w"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the house is here", None, None, 17), (3, "the house is here", "en", "a", 17), (3, "the house is here", "en", "a", 17), (4, "la maison est ici", "fr", "b", 17), (5, "x " * 50_000, None, "b", 100_000)]
    docs = spark.createDataFrame([(*r, *["v"] * len(extra)) for r in odd * rows], schema)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.count() <= docs.count(), name


def test_stages_by_brute_force(spark, tmp_path):
    """Stages 2 to 5 against plain Python, each on the rows that the one before kept."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lor", "mip", "sun", "tav", "rek", "dol") for b in ("a", "en", "is", "or", "um")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    item = "how many red apples does the old farmer carry to the village market on a cold winter morning"
    rows = []
    for i in range(150):
        lines = [prose(rng.randrange(20, 40)) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "All rights reserved  by the publisher")
        if i % 5 == 0:
            lines.append("seldom seen line")  # on sources 0, 5 and 10 only
        if i % 17 == 3:
            lines[0] += " " + item + " " + prose(5)
        rows.append((i, "\n".join(lines), "en", f"s{i % 15}", 0))
    for i in range(150, 180):
        near = rows[rng.randrange(150)][1].split(" ")
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i, " ".join(near), "en", f"s{i % 15}", 0))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, item), (2, "what is the height of the stone tower beside the river in meters")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, docs = dict(pipeline.STAGES), spark.createDataFrame(rows, columns)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = stages["line_dedup"](spark, docs, str(tmp_path)).checkpoint()
    sites, first = defaultdict(set), {}
    for i, text, _, source, _ in rows:
        for line in text.split("\n"):
            key = " ".join(line.lower().split())
            sites[key].add(source)
            first.setdefault(key, i)
    plain = {}
    for i, text, *_ in rows:
        left = [x for x in text.split("\n") if len(sites[k := " ".join(x.lower().split())]) < 10 or first[k] == i]
        plain[i] = "\n".join(left)
    assert texts(kept) == plain

    kept = stages["near_dedup"](spark, kept, str(tmp_path)).checkpoint()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in plain.items() if (w := t.lower().split()) or True}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    plain = {i: t for i, t in plain.items() if find(i) == i}
    assert 100 < len(plain) < 175 and texts(kept) == plain

    kept = stages["decontamination"](spark, kept, str(tmp_path)).checkpoint()
    assert any(item in t for t in plain.values())
    plain = {i: t for i, t in plain.items() if item not in t}  # whole items or none were planted
    assert texts(kept) == plain

    mixed = stages["source_mix"](spark, kept, str(tmp_path)).collect()
    sizes = Counter()
    for r in kept.collect():
        sizes[r["source"]] += len(r["text"].split())
    goal, open_ = {}, sorted(sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(open_)}
    while open_:  # fill by weight, cap, share the excess again
        level = (1.5 * sum(sizes.values()) - sum(goal.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        goal |= {s: 2 * sizes[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in full] if full else []
    taken = Counter()
    for r in mixed:
        assert 0 < r["taken"] <= 2 * len(r["text"].split())
        taken[r["source"]] += r["taken"]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 2
