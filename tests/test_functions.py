"""Expressions against plain Python."""

import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tableproof.functions import dates, text, tokens
from tableproof.functions.similarity import scored, subsequence


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["v"] for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


WORDS = ["", " ", None, "NA", " n/a ", "null", "None", "-", "--", "nan", "NaN", "x", "0", " ", "\u001f", "none!", "---"]


def test_null_like(spark):
    plain = lambda v: v is None or v.strip().lower() in ("", "na", "n/a", "null", "none", "-", "--", "nan")
    assert column(spark, WORDS, tokens.null_like) == [plain(v) for v in WORDS]


def test_strip(spark):
    values = [" a ", " a b ", "\x1ca\x1f", "\t\n a", "a"]
    assert column(spark, values, tokens.strip) == [v.strip() for v in values]


NUMBERS = ["1", "+01", "-5", "007", "1.", ".5", "1e5", "1.2.3", "1,234.5", "1 234", "1.234", "1.234,50", "$1,234.50", "1d", "inf", "1_0", "١٢", "１", "NaN", "1E", "-.5e-3", "0", "00", "12a"]


@pytest.mark.parametrize("name, plain", [("INTEGER", r"^[+-]?\d+$"), ("LEADING_ZERO", r"^[+-]?0\d+$"), ("FLOAT", r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), ("LOOSE_NUMBER", r"^[+-]?\d{1,3}(?:[ .,]\d{3})*(?:[.,]\d+)?$")])
def test_number_shapes(spark, name, plain):
    assert column(spark, NUMBERS, lambda c: c.rlike(getattr(tokens, name))) == [bool(re.search(plain, v)) for v in NUMBERS]


def test_to_double_takes_literals_only(spark):
    assert column(spark, ["1d", "inf", "NaN", "1.5", ".5", "1e3", "x"], tokens.to_double) == [None, None, None, 1.5, 0.5, 1000.0, None]


DATES = {
    "2024-01-02": "2024-01-02",
    "2024-1-2 3:04": "2024-01-02 03:04:00",
    "2024-01-02T03:04": "2024-01-02 03:04:00",
    "2024/1/2": "2024-01-02",
    "5 Jan 2024": "2024-01-05",
    "05-Jan-2024": "2024-01-05",
    "Jan 5, 2024": "2024-01-05",
    "5 janv. 2024 10:30": "2024-01-05 10:30:00",
    "12 décembre 2024": None,
    "1 déc 99": "1999-12-01",
    "1 mai 070": "1970-05-01",
    "1 mai 69": "2069-05-01",
    "2024-02-30": None,
    "2023-02-29": None,
    "0000-01-01": None,
    "2024-01-01 24:00": None,
    "2024-01-01 10:00:60": None,
    "01.02.2024": None,
    "99-12-1": None,
    "": None,
    "x": None,
}


def test_dates(spark):
    assert column(spark, list(DATES), dates.unambiguous) == list(DATES.values())


def test_numeric_dates(spark):
    values = ["01.02.2024", "31/12/24", "13-01-2024 10:05", "01/02-2024", "31/02/2024", "1/2/99 1:02:03"]
    assert column(spark, values, dates.is_numeric) == [True, True, True, False, True, True]
    assert column(spark, values, lambda c: dates.ordered(c, F.lit("DMY"))) == ["2024-02-01", "2024-12-31", "2024-01-13 10:05:00", None, None, "1999-02-01 01:02:03"]
    assert column(spark, values, lambda c: dates.ordered(c, F.lit("MDY"))) == ["2024-01-02", None, None, None, None, "1999-01-02 01:02:03"]
    assert column(spark, values[:1], lambda c: dates.ordered(c, F.lit(None).cast("string"))) == [None]


def test_epoch_and_serial(spark):
    values = ["1700000000", "1700000000123", "1700000000123456", "45292", "45292.5", "2958466", "12"]
    want = []
    for v in values[:3]:
        seconds = int(v) / (1 if len(v) <= 10 else 1000 if len(v) <= 13 else 1_000_000)
        want.append(datetime.datetime.fromtimestamp(int(seconds), datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S") if len(v) <= 15 else None)
    got = column(spark, values, lambda c: dates.unambiguous(c, True))
    assert got == [*want, "2024-01-01", "2024-01-01 12:00:00", None, "1900-01-11"]
    assert column(spark, values, dates.unambiguous) == [None] * 7


def test_surface(spark):
    values = ["ﬁ　Ａé①", "  a \t b c ", "o'neil a-b 1st", "plain", "\x1fx\x1f"]
    plain = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v)).strip() for v in values]
    assert column(spark, values, text.surface) == plain
    for case in ("lower", "upper", "title"):
        assert column(spark, values, lambda c, case=case: text.surface(c, case)) == [getattr(v, case)() for v in plain]
    with pytest.raises(ValueError):
        text.surface(F.lit("x"), "camel")


def test_key(spark):
    df = spark.createDataFrame([("O'Neil,  A-B", "n/a"), (None, "x_1"), ("é!", "2")], "a string, b string")
    assert [r["k"] for r in df.select(text.row_key([F.col("a"), F.col("b")]).alias("k")).collect()] == ["o neil a b\x1f", "\x1fx_1", "é\x1f2"]


def plain_similarity(x, y):
    a, b = set(x.split()), set(y.split())
    if not a or not b:
        return 0.0
    both, p, q = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not p or not q):
        return 100.0
    table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, c in enumerate(p):
        for j, e in enumerate(q):
            table[i + 1][j + 1] = table[i][j] + 1 if c == e else max(table[i][j + 1], table[i + 1][j])
    assert table[-1][-1] == subsequence(p, q)
    s, f = len(both), 1 if both else 0
    indel = len(p) + len(q) - 2 * table[-1][-1]
    out = 100 - 100 * indel / (2 * s + 2 * f + len(p) + len(q))
    return max(out, 100 - 100 * (1 + len(p)) / (2 * s + 1 + len(p)), 100 - 100 * (1 + len(q)) / (2 * s + 1 + len(q))) if s else out


ANCHORS = [("new york", "new york city", 100), ("brand#2", "brand#22", 93.33), ("small ring", "small rod", 73.68), ("small ring\x1fbrand 2", "small rod\x1fbrand 2", 86.67), ("", "", 0)]


def test_similarity(spark):
    rng = random.Random(1)
    make = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(4)))
    rows = [(a, b) for a, b, _ in ANCHORS] + [(make(), make()) for _ in range(500)]
    got = [(r["x"], r["y"], r["similarity"]) for r in scored(spark.createDataFrame(rows, "x string, y string"), "x", "y").collect()]
    assert all(abs(v - plain_similarity(x, y)) < 1e-9 for x, y, v in got) and len(got) == len(rows)
    assert [round(plain_similarity(a, b), 2) for a, b, _ in ANCHORS] == [v for _, _, v in ANCHORS]
    close = scored(spark.createDataFrame(rows, "x string, y string"), "x", "y", least=70).count()
    assert close == sum(v >= 70 for _, _, v in got)
