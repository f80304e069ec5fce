"""The engine on small tables: every branch of inference, detectors, ledger, apply, reports, files and sessions."""

import json
import pathlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tableproof.operators import apply, coherence, dates, duplicates, inference, ledger, report, texts
from tableproof.plans.analysis import Options, analyse
from tableproof.plans.cells import first_rows
from tableproof.plans.held import hold
from tableproof.plans.rows import number_rows, preview, renumber
from tableproof.sources import csv_text, session


def frame(spark, **columns):
    names = list(columns)
    rows = [(i, *values) for i, values in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "row_index long, " + ", ".join(f"`{n}` string" for n in names))


def profile(spark, values, **options):
    row = inference.infer(frame(spark, c=values), **options).first()
    return row["dtype"], round(row["confidence"], 4), list(row["flags"]), row["thousands"], row["decimal"]


N20 = [str(i) for i in range(1, 20)]


@pytest.mark.parametrize(
    "values, want",
    [
        (["", "NA", None], ("string", 0.0, ["all_null"], None, None)),
        (["yes", "No", "oui", "vrai"], ("bool", 1.0, [], None, None)),
        ([*N20, "x"], ("int64", 0.95, [], None, None)),
        ([*N20[:18], "x", "y"], ("string", 1.0, [], None, None)),
        ([*N20, "007"], ("string", 1.0, ["leading_zeros_kept_as_string"], None, None)),
        (["1.5", "2.25", "3"], ("float64", 1.0, [], None, ".")),
        (["1.234,50", "2,5"], ("float64", 1.0, [], ".", ",")),
        (["$1,234.50", "2.5"], ("float64", 1.0, ["currency_or_spaces_stripped"], ",", ".")),
        (["1.234"], ("string", 1.0, ["numeric_locale_ambiguous"], None, None)),
        (["1,5", "1.5"], ("string", 1.0, ["numeric_locale_ambiguous"], None, None)),
        (["a@b.com"], ("string", 0.0, ["numeric_locale_ambiguous"], None, None)),
        (["01.02.2024"], ("string", 0.0, ["numeric_locale_ambiguous"], None, None)),
        (["01.02.24", "2024-01-01"], ("datetime", 1.0, [], None, None)),
        (["1 Jan 2024", "2/3/2024 10:00"], ("datetime", 1.0, [], None, None)),
        (["a", "a", "b", "b"], ("category", 1.0, ["low_cardinality"], None, None)),
        (["a", "a", "b"], ("string", 1.0, [], None, None)),
    ],
)
def test_cascade(spark, values, want):
    assert profile(spark, values) == want


def test_sample_cap(spark):
    values = ["1"] * 6 + ["x"] * 6
    assert profile(spark, values, max_sample=6) == ("int64", 1.0, ["sampled"], None, None)
    assert profile(spark, [None, *values], max_sample=12)[2] == ["low_cardinality"]
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1000)], "row_index long, g string")
    want = {"a": sorted(i for i in range(1000) if i % 3)[99], "b": 297}
    assert {r["g"]: r["last"] for r in first_rows(rows, ["g"], 100, step=16).collect()} == want


def test_samples_and_order(spark):
    rows = inference.infer(frame(spark, b=["z", "y", "z", " x", "w", "v", "u"], a=["1"] * 7)).orderBy("position").collect()
    assert [r["column"] for r in rows] == ["b", "a"] and list(rows[0]["samples"]) == ["z", "y", "x", "w", "v"]


def test_override(spark):
    profiles = inference.infer(frame(spark, a=["007", "008"]))
    changed, led = inference.override(profiles, inference.cast_changes(profiles), "a", "int64")
    assert changed.first()["dtype"] == "int64" and [(r["after"], r["confidence"]) for r in led.collect()] == [("int64", 1.0)]
    with pytest.raises(ValueError):
        inference.override(profiles, led, "a", "decimal")


def test_dates(spark):
    df = frame(spark, dmy=["13/01/2024", "02/03/2024", "2024-05-06", " 5 Jan 2024", "x"], open=["01/02/2024"] * 5, none=["x", "y", None, "", "z"])
    led, notes, gates = dates.normalize_dates(df, ["dmy", "open", "none"])
    assert {(r["column"], r["row_index"], r["before"], r["after"]) for r in led.collect()} == {("dmy", 0, "13/01/2024", "2024-01-13"), ("dmy", 1, "02/03/2024", "2024-03-02"), ("dmy", 3, "5 Jan 2024", "2024-01-05")}
    assert {(r["key"], r["params"]["col"], r["params"].get("count")) for r in notes.collect()} == {("warn_date_unparsed", "dmy", "1"), ("warn_date_ambiguous", "open", "5"), ("warn_date_unparsed", "none", "3"), ("warn_date_none", "none", None)}
    assert {r["column"]: r["blocked"] for r in gates.collect()} == {"dmy": True, "open": True, "none": False}
    assert not any(r["blocked"] for r in dates.normalize_dates(df, ["open"], ambig_blocks=False)[2].collect())
    mixed = frame(spark, d=["13/01/2024", "01/13/2024"])  # day first wins, the other row fails
    assert [r["after"] for r in dates.normalize_dates(mixed, ["d"])[0].collect()] == ["2024-01-13"]


def test_category_merge(spark):
    values = ["new york", "New York", "new york", "new york city", "boston", " boston "]
    led, notes = texts.normalize_text(frame(spark, c=values), [], ["c"], cat_threshold=90)
    got = {(r["kind"], r["row_index"], r["before"], r["after"], r["confidence"]) for r in led.collect()}
    assert got == {("cat_merge", 1, "New York", "new york", 1.0), ("cat_merge", 3, "new york city", "new york", 1.0), ("text_norm", 5, " boston ", "boston", 1.0)}
    assert [(r["params"]["members"], r["params"]["winner"]) for r in notes.collect()] == [("New York, new york, new york city", "new york")]


def test_coherence(spark):
    df = frame(spark, a=["1", "--", None, ""], b=["1", "-", "", "NA"], email=["x@y.z", "bad", "", "q@w.e"], qty=["-1", "2", "-3.5", "x"], d=["2030-01-01", "2020-01-01", "x", "13/01/2031"])
    rows = [{"column": c, "dtype": t, "flags": [], "null_like_rate": n, "thousands": None, "decimal": None} for c, t, n in (("a", "string", 0.75), ("b", "string", 0.5), ("email", "string", 0.25), ("qty", "float64", 0.0), ("d", "datetime", 0.0))]
    led, notes = coherence.run_checks(coherence.context(df, rows, today=date(2025, 1, 1)))
    assert {(r["column"], r["row_index"], r["before"]) for r in led.collect()} == {("a", 1, "--"), ("a", 2, "None"), ("b", 1, "-"), ("b", 3, "NA")}
    got = {(r["key"], r["params"].get("col") or r["params"]["col1"], r["params"].get("count")) for r in notes.collect()}
    assert got == {("warn_high_null", "a", None), ("warn_duplicate_columns", "a", None), ("warn_email_shape", "email", "1"), ("warn_negative_values", "qty", "2"), ("warn_future_dates", "d", "2")}
    taken = ledger.change(df.where("row_index = 1"), kind="text_norm", column=F.lit("a"), row=F.col("row_index"), before=F.lit(""), after=F.lit(""), rule=F.lit(""), confidence=F.lit(1.0))
    led, _ = coherence.null_unify(coherence.Context(df, rows, df, occupied=taken))
    assert ("a", 1) not in {(r["column"], r["row_index"]) for r in led.collect()}
    assert coherence.NON_NEGATIVE.search("total-price") and not coherence.NON_NEGATIVE.search("l_quantity")


def test_duplicates(spark):
    df = frame(spark, name=["Acme Inc", "acme, inc.", "Acme Inc Ltd", "Beta", None, "", "Acme Inc"], other=["", "x", "", "y", "z", "z", "x"])
    led, notes = duplicates.find_duplicates(df, ["name"])
    got = sorted((r["row_index"], r["before"], r["rule"], r["confidence"]) for r in led.collect())
    assert got == [(0, "acme inc", "dedup:g0", 1.0), (2, "acme inc ltd", "dedup:g0", 1.0), (6, "acme inc", "dedup:g0", 1.0)]  # row 1 is the first of the most complete
    assert [(r["key"], r["params"]["count"]) for r in notes.collect()] == [("warn_dup_groups", "1")]
    led, notes = duplicates.find_duplicates(df, ["name"], max_bucket=2)
    assert sorted(r["row_index"] for r in led.collect()) == [0] and "warn_dup_truncated" in {r["key"] for r in notes.collect()}
    led, notes = duplicates.find_duplicates(df, ["name", "nope"])
    assert led.count() == 0 and notes.first()["params"] == {"cols": "nope"}
    redone, told = duplicates.redetect(df, led, notes, ["name"])
    assert redone.count() == 3 and [r["key"] for r in told.collect()] == ["warn_dup_groups"]


def test_conflicts_and_decisions(spark):
    base = spark.range(3)
    make = lambda kind, rule: ledger.change(base, kind=kind, column=F.lit("c"), row=F.col("id"), before=F.lit("a"), after=F.lit(rule), rule=F.lit(rule), confidence=F.lit(0.7))
    led, notes = ledger.resolve(make("text_norm", "t").unionByName(make("date_norm", "d").where("row_index < 2")))
    assert sorted((r["row_index"], r["rule"]) for r in led.collect()) == [(0, "d"), (1, "d"), (2, "t")]
    assert {(r["params"]["kept"], r["params"]["dropped"]) for r in notes.collect()} == {("d", "t")}
    first = led.orderBy("row_index").first()["id"]
    said = spark.createDataFrame([(first, "accepted", datetime(2024, 1, 1)), (first, "rejected", datetime(2024, 1, 2))], ledger.DECISIONS)
    assert {r["row_index"]: r["status"] for r in ledger.decide(led, said).collect()} == {0: "rejected", 1: "pending", 2: "pending"}
    assert {r["status"]: r["n"] for r in ledger.counts_by_status(led).collect()} == {"accepted": 0, "pending": 3, "rejected": 0}
    with pytest.raises(ValueError):
        ledger.set_status(led, F.lit(True), "maybe")


def messy(spark):
    n = 40
    return frame(
        spark,
        day=[f"{i % 28 + 1:02d}/01/2024" for i in range(n)],
        city=["Paris", "paris ", "Lyon", "LYON"] * 10,
        price=[f"€ {i},50" for i in range(n)],
        note=[f"note {i}" if i % 2 else "--" for i in range(n)],
        name=[f"{c} shop" for c in "abcdefghijklmnopqrst"] * 2,
    )


def test_nothing_accepted_changes_nothing(spark):
    df = messy(spark)
    found = analyse(df, Options(dup_keys=("name",)))
    done = apply.apply_changes(df, found.ledger, found.profile_rows())
    assert sorted(map(tuple, done.df.collect())) == sorted(map(tuple, df.collect()))
    assert done.applied_by_kind == {} and done.rows_before == done.rows_after == 40


def test_accepted_changes_apply_once(spark):
    df = messy(spark)
    found = analyse(df, Options(dup_keys=("name",)))
    led = ledger.set_status(found.ledger, F.lit(True), "accepted").checkpoint()
    done = apply.apply_changes(df, led, found.profile_rows())
    assert done.rows_after == done.rows_before - done.applied_by_kind["dedup"] == 20
    rows = done.df.orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(20))
    assert rows[2]["day"] == "2024-01-03" and rows[3]["price"] == 3.5 and rows[1]["city"] in ("Paris", "paris")
    assert dict(done.df.dtypes)["price"] == "double" and done.mismatches.count() == 0
    clean = done.df.withColumn("price", F.format_string("%.2f", "price")).checkpoint()
    again = analyse(clean)
    assert again.ledger.where("kind in ('text_norm', 'cat_merge', 'coherence_fix')").count() == 0


def test_mismatch_is_told(spark):
    df = frame(spark, c=["a", "b"])
    led = ledger.change(df, kind="text_norm", column=F.lit("c"), row=F.col("row_index"), before=F.lit("a"), after=F.lit("z"), rule=F.lit("r"), confidence=F.lit(1.0))
    done = apply.apply_changes(df, ledger.set_status(led, F.lit(True), "accepted"), [])
    assert [tuple(r) for r in done.mismatches.collect()] == [("c", 1, "a", "b")] and {r["c"] for r in done.df.collect()} == {"z"}


def test_casts(spark):
    df = frame(spark, f=["1 234,5", "x", "", "1d"], i=["1", "2.0", "1.5", "99999999999999999999"], b=["Oui", "0", "maybe", None])
    got = df.select(apply.cast(F.col("f"), "float64", None, ",").alias("f"), apply.cast(F.col("i"), "int64", None, None).alias("i"), apply.cast(F.col("b"), "bool", None, None).alias("b")).collect()
    assert [tuple(r) for r in got] == [(1234.5, 1, True), (None, 2, False), (None, None, None), (None, None, None)]


def test_report_is_the_same_for_any_layout(spark):
    made = []
    for parts in (1, 4, 13):
        df = messy(spark).repartition(parts)
        found = analyse(df, Options(dup_keys=("name",), today=date(2025, 1, 1)))
        led = ledger.set_status(found.ledger, F.col("kind") != "text_norm", "accepted")
        done = apply.apply_changes(df, led, found.profile_rows())
        made.append(report.build_report(found.profiles, led, found.warnings, found.blocked, done))
    forms = [{f: report.export(m, f) for f in ("json", "md", "HTML")} for m in made]
    assert forms[0] == forms[1] == forms[2]
    assert json.loads(forms[0]["json"])["schema_version"] == 1 and "| accepted |" in forms[0]["md"] and "<table>" in forms[0]["HTML"]
    with pytest.raises(ValueError):
        report.export(made[0], "pdf")


def test_words():
    assert report.in_words("warn_high_null", {"col": "a", "rate": "0.666"}) == "column a has 67% missing-like values"
    assert report.in_words("warn_date_none", {"col": "a"}, "fr") == "colonne a : aucune date reconnaissable"
    assert report.in_words("warn_date_none", {}) == "warn_date_none" and report.in_words("other", {}) == "other"


CSV = {
    "bom": ("﻿a,b\n1,2\n".encode("utf-8"), {}, [("1", "2")], ["a", "b"]),
    "semicolon": (b"a;b\n1,5;2\n3;4\n", {}, [("1,5", "2"), ("3", "4")], ["a", "b"]),
    "tab": (b"a\tb\n1\t2\n", {"encoding": "utf-8"}, [("1", "2")], ["a", "b"]),
    "single": (b"a\nx\ny\n", {"encoding": "utf-8"}, [("x",), ("y",)], ["a"]),
    "short": (b"a,b\n1\n2,3\n", {"encoding": "utf-8"}, [("1", None), ("2", "3")], ["a", "b"]),
    "quoted": (b'a,b\n"x\ny","say ""hi"""\n', {"encoding": "utf-8"}, [("x\ny", 'say "hi"')], ["a", "b"]),
    "nulls": (b'a,b\nNA,""\nnull,-\n', {"encoding": "utf-8"}, [("NA", ""), ("null", "-")], ["a", "b"]),
    "repeated": (b"a,a,\n1,2,3\n", {"encoding": "utf-8", "sep": ","}, [("1", "2", "3")], ["a", "a.1", "Unnamed: 2"]),
    "header": (b"a,b\n", {"encoding": "utf-8"}, [], ["a", "b"]),
    "cp1252": ("a,b\né,ü\n".encode("cp1252"), {"encoding": "cp1252"}, [("é", "ü")], ["a", "b"]),
    "latin": ("a,b\né,ü\n".encode("latin-1"), {"encoding": "latin1"}, [("é", "ü")], ["a", "b"]),
}


@pytest.mark.parametrize("case", CSV)
def test_csv(spark, tmp_path, case):
    data, options, want, names = CSV[case]
    path = tmp_path / "t.csv"
    path.write_bytes(data)
    got = csv_text.read_csv(spark, str(path), **options)
    assert got.df.columns == ["row_index", *names]
    rows = got.df.orderBy("row_index").collect()
    assert [tuple(r)[1:] for r in rows] == want and [r[0] for r in rows] == list(range(len(want)))


def test_csv_limits_and_errors(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "\n".join(f"{i},x" for i in range(20)))
    got = csv_text.read_csv(spark, str(path), max_rows=5, encoding="utf-8")
    assert got.truncated and got.df.count() == 5
    assert not csv_text.read_csv(spark, str(path), max_rows=20, encoding="utf-8").truncated
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError):
        csv_text.read_csv(spark, str(path), encoding="utf-8")
    path.write_text("")
    with pytest.raises(ValueError):
        csv_text.read_csv(spark, str(path))


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 1.5, "x,y"), (0, None, None, None)], "row_index long, b boolean, f double, s string")
    csv_text.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.replace("b,f,s\n", "") == ',,\nTrue,1.5,"x,y"\n'
    with pytest.raises(PermissionError):
        csv_text.write_csv(df, str(tmp_path / "out2"), blocked=True)


def test_session(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert session.load(spark, folder) is None
    found = analyse(messy(spark))
    session.save(found, folder)
    kept = session.load(spark, folder)
    assert sorted(r["id"] for r in kept.ledger.collect()) == sorted(r["id"] for r in found.ledger.collect()) and kept.blocked == found.blocked
    session.decide_on(ledger.by_kind(kept.ledger, "type_cast"), "accepted", folder)
    assert {r["kind"] for r in ledger.accepted(session.load(spark, folder).ledger).collect()} == {"type_cast"}
    session.clear(spark, folder)
    assert session.load(spark, folder) is None


def test_rows(spark):
    df = spark.range(0, 100, 1, 7).withColumnRenamed("id", "x")
    assert sorted((r["row_index"], r["x"]) for r in number_rows(df).collect()) == [(i, i) for i in range(100)]
    kept = number_rows(df).where("x % 3 = 0")
    assert [(r["row_index"], r["x"]) for r in renumber(kept, step=8).orderBy("row_index").collect()] == [(i, 3 * i) for i in range(34)]
    assert [r["row_index"] for r in preview(number_rows(df), 3).collect()] == [0, 1, 2]


def test_stream(spark, tmp_path):
    from tableproof.streaming.stateless import proposals, start

    df = messy(spark).drop("price", "name")
    rows = inference.infer(df).orderBy("position").collect()
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = start(stream, rows, {"day": "DMY"}, str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["id"] for r in proposals(df, rows, {"day": "DMY"}).collect()) and len(got) > 40


def test_report_in_files_says_the_same(spark, tmp_path):
    """Change lines of a report in files are those of the report as one text, whatever stands in the cells."""
    rows = [(0, "a|b <i>"), (1, 'say "hi" & \'bye\''), (2, "N/A"), (3, "  é  ")]
    df = spark.createDataFrame(rows, "row_index long, word string")
    found = analyse(df)
    changes = ledger.set_status(found.ledger, F.col("row_index") > 2, "accepted").withColumn("confidence", F.coalesce(F.col("row_index") / 7, F.lit(0.25)))
    done = apply.apply_changes(df, changes, found.profile_rows())
    whole = report.build_report(found.profiles, changes, found.warnings, False, done)
    for form in ("md", "html", "json"):
        folder = str(tmp_path / form)
        summary = report.write_report(found.profiles, changes, found.warnings, False, done, folder, form)
        lines = [r["value"] for r in spark.read.text(f"{folder}/changes").collect()]
        if form == "json":
            assert [json.loads(x) for x in lines] == whole["changes"]
        else:
            text = report.export(whole, form)
            assert lines and all(x in text for x in lines)
        assert [r["value"] for r in spark.read.text(f"{folder}/warnings").collect()] == whole["warnings"]
        assert summary["counts_by_kind"] == whole["counts_by_kind"] and "changes" not in summary


@pytest.mark.parametrize("form", ["html", "md", "json"])
def test_document_of_any_size_is_the_report(spark, tmp_path, monkeypatch, form):
    """A document in files is the one that export() makes, lists and all; none of its lists comes to the driver."""
    rows = [(i, ("a|b <i>", 'say "hi" & \'bye\'', "N/A", "  é  ", f" w{i}  x\\")[i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_index long, word string")
    found = analyse(df)
    changes = ledger.set_status(found.ledger, F.col("row_index") % 2 == 0, "accepted").withColumn("before", F.when(F.col("row_index") % 3 == 0, "it's").otherwise(F.col("before")))
    # held in order and filtered: its first partitions are empty
    kept = hold(hold(changes.repartitionByRange(8, *ledger.report_order()).sortWithinPartitions(*ledger.report_order())).where(F.col("row_index") >= 90))
    notes = found.warnings.unionByName(spark.createDataFrame([("warn_ambiguous", {"col": f"c{i} 'é' <&>"}) for i in range(20)], ledger.WARNINGS))
    for at, (led, said) in {"all": (kept, notes), "none": (ledger.empty(spark), notes.limit(0))}.items():
        done = apply.apply_changes(df, led, found.profile_rows())
        want = report.build_report(found.profiles, led, said, False, done)
        assert len(want["changes"]) > 50 and len(want["warnings"]) >= 20 and len(want["apply_summary"]["mismatches"]) > 10 or at == "none"
        with monkeypatch.context() as m:
            m.delattr(report, "build_report")
            places = report.write_document(found.profiles, led, said, False, done, str(tmp_path / at), form)
        lines = "".join(part.read_text() for place in sorted(places) for part in sorted(pathlib.Path(place).glob("part-*")))
        if form == "json":
            assert json.loads(lines) == want
        else:
            assert lines == report.export(want, form) if form == "md" else lines.replace("\n", "") == report.export(want, form)
    with pytest.raises(ValueError):
        report.write_document(found.profiles, kept, notes, False, done, str(tmp_path / "no"), "pdf")


def test_flags_of_sampled_columns(spark):
    """A table of columns has flags as inference gives them, the report has them sorted."""
    df = frame(spark, word=["a", "b"] * 4)
    profiles, none = inference.infer(df, max_sample=4), ledger.empty(spark)
    assert report.report_columns(profiles, none).first()["flags"] == "sampled,low_cardinality"
    made = report.build_report(profiles, none, spark.createDataFrame([], ledger.WARNINGS), False, apply.apply_changes(df, none, []))
    assert made["columns"][0]["flags"] == ["low_cardinality", "sampled"]


def test_all_of_a_block_is_compared_without_a_cap(spark):
    df = spark.createDataFrame([(i, f"part {i % 40} of one" if i < 60 else "part nil") for i in range(62)], "row_index long, name string")
    few, told = duplicates.find_duplicates(df, ["name"], threshold=100, max_bucket=50)
    every, silent = duplicates.find_duplicates(df, ["name"], threshold=100, max_bucket=None)
    assert few.count() == 10 and every.count() == 21
    assert {r["key"] for r in told.collect()} == {"warn_dup_truncated", "warn_dup_groups"} and {r["key"] for r in silent.collect()} == {"warn_dup_groups"}


def test_unknown_column_is_no_override(spark):
    profiles = inference.infer(spark.createDataFrame([(0, "1")], "row_index long, a string"))
    with pytest.raises(ValueError):
        inference.override(profiles, inference.cast_changes(profiles), "b", "int64")


def test_csv_splits_keep_the_order(spark, tmp_path):
    """Rows of many splits and files are numbered in their order, in an encoding that is translated as well."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(("name;n\n" + "".join(f"é€ “{i}”;{k * 5000 + i}\n" for i in range(5000 - 1000 * k))).encode("cp1252"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = csv_text.read_csv(spark, str(tmp_path), encoding="cp1252")
        assert got.df.rdd.getNumPartitions() > 4 and got.delimiter == ";"
        rows = got.df.orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(f"é€ “{i}”", str(k * 5000 + i)) for k in range(3) for i in range(5000 - 1000 * k)]
    assert [(r["name"], r["n"]) for r in rows] == want and [r["row_index"] for r in rows] == list(range(len(want)))
