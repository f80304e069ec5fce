"""A query for each operator, over whole tables: their names are those of the operators they show."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.functions import dates as d
from tableproof.functions.text import CASES
from tableproof.functions.tokens import null_like
from tableproof.operators import apply, coherence, dates, duplicates, inference, ledger, report, texts
from tableproof.plans import fixtures as fx
from tableproof.plans.analysis import Options, analyse
from tableproof.plans.cells import ROW, cells, dictionary
from tableproof.plans.held import hold, shared_folder
from tableproof.plans.rows import number_rows, preview
from tableproof.session import table
from tableproof.sources import csv_text, session
from tableproof.streaming import stateless

AS_OF = date(1999, 1, 1)
#: Similarity from which part names link here: they have two words, so 85 would only link equal ones.
LINKED = 70
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _named(df: DataFrame, **names: str) -> DataFrame:
    for old, new in names.items():
        df = df.withColumnRenamed(old, new)
    return df


def _profile_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("column").alias("col_name"), "dtype", "confidence", "null_like_rate", F.col("distinct").alias("n_distinct"), F.array_join("flags", ",").alias("flags"), "thousands", "decimal")


def _changes(changes: DataFrame) -> DataFrame:
    return changes.select("kind", F.col("column").alias("col_name"), ROW, F.col("before").alias("old_value"), F.col("after").alias("new_value"), "rule", "confidence")


@query
def null_like_tokens(spark, sf):
    return cells(fx.dirty_orders(spark, sf)).where(null_like(F.col("raw"))).select(ROW, F.col("column").alias("col_name"), "raw")


@query
def profile_null_rate(spark, sf):
    return inference.infer(fx.dirty_orders(spark, sf)).select(F.col("column").alias("col_name"), "null_like_rate")


@query
def profile_distinct(spark, sf):
    return inference.infer(fx.dirty_orders(spark, sf)).select(F.col("column").alias("col_name"), F.col("distinct").alias("n_distinct"))


@query
def profile_orders(spark, sf):
    return _profile_rows(inference.infer(fx.dirty_orders(spark, sf)))


@query
def profile_events(spark, sf):
    return _profile_rows(inference.infer(fx.dirty_events(spark, sf)))


@query
def infer_bool_int_shares(spark, sf):
    both = [inference.shares(dictionary(f(spark, sf))) for f in (fx.dirty_orders, fx.dirty_events)]
    return both[0].unionByName(both[1]).select(F.col("column").alias("col_name"), "sampled", "bools", "ints")


@query
def leading_zero_guard(spark, sf):
    return inference.infer(fx.dirty_orders(spark, sf), columns=["code"]).select(F.col("column").alias("col_name"), "dtype", F.array_join("flags", ",").alias("flags"), "confidence")


@query
def locale_vote(spark, sf):
    return _profile_rows(inference.infer(fx.orders_extra(spark, sf)))


@query
def first_samples(spark, sf):
    return inference.first_values(dictionary(fx.dirty_orders(spark, sf), None, None)).select(F.col("column").alias("col_name"), "rank", "token")


@query
def sample_cap_profile(spark, sf):
    return _profile_rows(inference.infer(fx.text_lineitem(spark, sf), max_sample=50_000))


@query
def type_cast_proposals(spark, sf):
    return _changes(inference.cast_changes(inference.infer(fx.dirty_orders(spark, sf))))


@query
def type_override(spark, sf):
    profiles = inference.infer(fx.dirty_orders(spark, sf))
    _, changes = inference.override(profiles, inference.cast_changes(profiles), "code", "int64")
    return _changes(changes)


def _order_dates(spark, sf, column="order_date"):
    return dictionary(fx.dirty_orders(spark, sf), [column], None)


@query
def date_iso_parse(spark, sf):
    found = cells(fx.dirty_orders(spark, sf), ["order_date"]).where(F.col("raw").rlike("^[0-9]{4}[-/]"))
    return found.select(ROW, "raw", d.unambiguous(F.col("raw")).alias("iso"))


@query
def date_month_name(spark, sf):
    found = cells(fx.dirty_orders(spark, sf), ["order_date"]).where(F.col("raw").rlike("[A-Za-z]{3} [0-9]"))
    return found.select(ROW, "raw", d.unambiguous(F.col("raw")).alias("iso"))


@query
def date_vote(spark, sf):
    votes = dates.orders(dictionary(fx.dirty_orders(spark, sf), ["order_date", "us_date"], None))
    return votes.select(F.col("column").alias("col_name"), F.col("order").alias("vote"))


@query
def date_norm_changes(spark, sf):
    return _changes(dates.normalize_dates(fx.dirty_orders(spark, sf), ["order_date", "us_date"])[0])


def _low_days(spark, sf):
    """Orders of the first twelve days of a month: their order of day and month stays open."""
    return table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") <= 12).select(F.col("o_orderkey").alias(ROW), F.date_format("o_orderdate", "dd/MM/yyyy").alias("low_date"))


@query
def date_ambiguous(spark, sf):
    values = dictionary(_low_days(spark, sf), None, None)
    return dates.tallies(values, dates.orders(values)).withColumnRenamed("column", "col_name")


@query
def date_export_gate(spark, sf):
    orders = fx.dirty_orders(spark, sf).withColumn("worse", F.when(F.col(ROW) % 10 == 0, "not a date").otherwise(F.col("us_date")))
    _, _, gates = dates.normalize_dates(orders, ["order_date", "us_date", "worse"])
    _, _, low = dates.normalize_dates(_low_days(spark, sf), ["low_date"])
    return gates.unionByName(low).withColumnRenamed("column", "col_name")


@query
def date_warnings(spark, sf):
    orders = fx.dirty_orders(spark, sf).withColumn("worse", F.when(F.col(ROW) % 10 == 0, "not a date").otherwise(F.col("us_date")))
    _, notes, _ = dates.normalize_dates(orders, ["order_date", "worse", "priority"])
    return notes.select("key", F.col("params")["col"].alias("col_name"), F.coalesce(F.col("params")["count"].cast("long"), F.lit(0)).alias("n"))


@query
def date_epoch(spark, sf):
    found = cells(fx.dirty_events(spark, sf), ["epoch_s"])
    return found.select(ROW, "raw", d.unambiguous(F.col("raw"), True).alias("iso"))


@query
def date_excel(spark, sf):
    found = cells(fx.orders_extra(spark, sf), ["excel_serial"])
    return found.select(ROW, "raw", d.unambiguous(F.col("raw"), True).alias("iso"))


def _surface(case):
    def run(spark, sf):
        df = fx.dirty_orders(spark, sf)
        return _changes(texts.text_changes(df, ["priority"], texts.surfaces(df, ["priority"], case)))

    return run


for _case in CASES:
    QUERIES[f"text_surface_{_case}"] = _surface(_case)


def _priorities(spark, sf):
    return texts.surfaces(fx.dirty_orders(spark, sf), ["priority"])


@query
def value_frequency(spark, sf):
    return texts.frequencies(_priorities(spark, sf)).select(F.col("column").alias("col_name"), "surface", "n", "first_row")


def _brands(spark, sf):
    return texts.frequencies(texts.surfaces(fx.dirty_part(spark, sf), ["brand"]))


@query
def token_set_pairs(spark, sf):
    values = _brands(spark, sf)
    name = values.select("at", "surface")
    found = texts.links(values, 0).select("a", "b", "similarity")
    return found.join(name.select(F.col("at").alias("a"), F.col("surface").alias("left_value")), "a").join(name.select(F.col("at").alias("b"), F.col("surface").alias("right_value")), "b").select("left_value", "right_value", "similarity")


@query
def category_clusters(spark, sf):
    both = [texts.clusters(texts.frequencies(texts.surfaces(f(spark, sf), [c])), 90) for f, c in ((fx.dirty_part, "brand"), (fx.dirty_orders, "priority"))]
    return both[0].unionByName(both[1]).select(F.col("column").alias("col_name"), "surface", "cluster")


@query
def category_winner(spark, sf):
    return texts.clusters(_brands(spark, sf), 90).select("surface", "winner", "members")


@query
def cat_merge_changes(spark, sf):
    return _changes(texts.normalize_text(fx.dirty_orders(spark, sf), [], ["priority", "status"])[0])


def _context(spark, sf, view, **options):
    df = view(spark, sf)
    profiles = inference.infer(df).orderBy("position").collect()
    return coherence.context(df, profiles, **options)


@query
def null_unify_changes(spark, sf):
    df = fx.dirty_orders(spark, sf)
    taken = dates.date_changes(df, ["order_date"], dates.orders(_order_dates(spark, sf)))
    return _changes(coherence.null_unify(coherence.Context(df, [], df, occupied=taken))[0])


@query
def warn_locale(spark, sf):
    _, notes = coherence.locale_ambiguous(_context(spark, sf, fx.orders_extra))
    return notes.select("key", F.col("params")["col"].alias("col_name"))


@query
def warn_high_null(spark, sf):
    _, notes = coherence.high_null(_context(spark, sf, fx.dirty_events))
    return notes.select("key", F.col("params")["col"].alias("col_name"), F.col("params")["rate"].cast("double").alias("rate"))


@query
def duplicate_columns(spark, sf):
    return coherence.equal_columns(fx.dirty_customer(spark, sf))


@query
def future_dates(spark, sf):
    return _named(coherence.future_counts(dictionary(fx.dirty_orders(spark, sf), ["order_date", "us_date"], None), AS_OF), column="col_name")


@query
def email_shape(spark, sf):
    return _named(coherence.bad_emails(dictionary(fx.dirty_customer(spark, sf), ["email", "segment"], None)), column="col_name")


@query
def negative_values(spark, sf):
    return _named(coherence.negatives(dictionary(fx.orders_extra(spark, sf), ["amount"], None), None, "."), column="col_name")


def _parts(spark, sf, keys=("name",)):
    return duplicates.keyed(fx.dirty_part(spark, sf), list(keys))


@query
def dedup_keys(spark, sf):
    return duplicates.keyed(fx.dirty_part(spark, sf), ["name", "ptype"]).select(ROW, F.col("key").alias("row_key"), "sig", "completeness")


@query
def dedup_blocks(spark, sf):
    rows = duplicates.keyed(fx.dirty_customer(spark, sf), ["name"])
    return duplicates.compared(rows, duplicates.blocks(rows, 1500)).groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.max(ROW).alias("last_row"))


@query
def dedup_edges(spark, sf):
    rows = _parts(spark, sf)
    return duplicates.links(duplicates.distinct_keys(duplicates.compared(rows, duplicates.blocks(rows, 1500))), LINKED)


@query
def dedup_groups(spark, sf):
    rows = _parts(spark, sf)
    return duplicates.groups(duplicates.compared(rows, duplicates.blocks(rows, 1500)), LINKED).select(ROW, "gid")


@query
def dedup_losers(spark, sf):
    return _changes(duplicates.find_duplicates(fx.dirty_part(spark, sf), ["name"], threshold=LINKED)[0])


def _rival_changes(spark, sf):
    """Two or three changes for some cells of orders, as no detector would make them."""
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    make = lambda rows, kind, rule: ledger.change(rows, kind=kind, column=F.lit("status"), row=F.col("k"), before=F.lit("x"), after=F.concat(F.lit("y"), F.col("k").cast("string")), rule=F.lit(rule), confidence=F.lit(1.0))
    return make(base, "coherence_fix", "null:unify").unionByName(make(base.where("k % 2 = 0"), "text_norm", "text:surface")).unionByName(make(base.where("k % 3 = 0"), "date_norm", "date:iso"))


@query
def conflict_resolution(spark, sf):
    kept, notes = ledger.resolve(_rival_changes(spark, sf))
    a = kept.select(F.col(ROW), F.col("rule").alias("kept"), F.lit(None).cast("string").alias("dropped"))
    b = notes.select(F.col("params")["row"].cast("long").alias(ROW), F.col("params")["kept"].alias("kept"), F.col("params")["dropped"].alias("dropped"))
    return a.unionByName(b)


def _cleaning(spark, sf):
    df = fx.dirty_orders(spark, sf)
    moved = dates.date_changes(df, ["order_date"], dates.orders(_order_dates(spark, sf)))
    fixed, _ = coherence.null_unify(coherence.Context(df, [], df, occupied=moved))
    return df, moved.unionByName(fixed)


@query
def apply_cells(spark, sf):
    df, changes = _cleaning(spark, sf)
    return apply.apply_cells(df, ledger.set_status(changes, F.lit(True), "accepted"))


@query
def apply_casts(spark, sf):
    df = fx.dirty_orders(spark, sf).select(ROW, "price", "status").withColumn("flag", F.when(F.col(ROW) % 3 == 0, "Oui").when(F.col(ROW) % 3 == 1, "0").otherwise("maybe")).withColumn("whole", F.col(ROW).cast("string"))
    casts = spark.createDataFrame([("price", "float64"), ("flag", "bool"), ("whole", "int64")], "column string, dtype string")
    changes = ledger.set_status(inference.cast_changes(casts.withColumn("confidence", F.lit(1.0))), F.lit(True), "accepted")
    typed, _ = apply.apply_casts(df, changes, [{"column": "price", "thousands": None, "decimal": ","}])
    return typed


@query
def apply_dedup(spark, sf):
    df = fx.dirty_part(spark, sf)
    changes = ledger.set_status(duplicates.find_duplicates(df, ["name"], threshold=LINKED)[0], F.lit(True), "accepted")
    return apply.apply_dedup(df, changes)


def _decided(changes: DataFrame) -> DataFrame:
    status = F.when(F.col(ROW) % 3 == 0, "accepted").when(F.col(ROW) % 3 == 1, "rejected").otherwise("pending")
    return changes.withColumn("status", F.when(F.col(ROW).isNull(), "accepted").otherwise(status))


@query
def counts_by_kind_status(spark, sf):
    changes = _decided(_cleaning(spark, sf)[1])
    return changes.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def counts_by_status(spark, sf):
    return ledger.counts_by_status(_decided(_cleaning(spark, sf)[1]).where("status <> 'pending'"))


@query
def report_columns(spark, sf):
    df, changes = _cleaning(spark, sf)
    found = report.report_columns(inference.infer(df), _decided(changes))
    return _named(found, column="col_name", distinct="n_distinct")


@query
def ledger_ordered(spark, sf):
    changes = _cleaning(spark, sf)[1]
    ordered = changes.orderBy(*ledger.report_order())
    numbered = number_rows(hold(ordered.select(F.col(ROW).alias("cell_row"), F.col("column").alias("col_name"), "kind", F.col("after").alias("new_value"))))
    return _named(numbered, row_index="place")


@query
def apply_mismatches(spark, sf):
    df, changes = _cleaning(spark, sf)
    wrong = changes.withColumn("before", F.when(F.col(ROW) % 7 == 0, "else").otherwise(F.col("before")))
    found = apply.mismatches(df, ledger.set_status(wrong, F.lit(True), "accepted"))
    return found.select(F.col("column").alias("col_name"), ROW, F.col("before").alias("expected"), F.col("current").alias("met"))


@query
def apply_summary(spark, sf):
    df, changes = _cleaning(spark, sf)
    done = apply.apply_changes(df, _decided(changes), [])
    rows = [(k, v) for k, v in done.applied_by_kind.items()] + [("rows_before", done.rows_before), ("rows_after", done.rows_after)]
    return spark.createDataFrame(rows, "measure string, n long")


@query
def analysis_warnings(spark, sf):
    found = analyse(fx.dirty_part(spark, sf), Options(dup_keys=("name",), today=AS_OF))
    return found.warnings.select("key", F.coalesce(F.col("params")["col"], F.col("params")["cols"]).alias("col_name"), F.col("params")["winner"].alias("winner"), F.coalesce(F.col("params")["count"].cast("long"), F.lit(0)).alias("n"))


# -- forms of dates, text beyond ASCII -------------------------------------------------------------------------------


def _forms(column):
    def run(spark, sf):
        found = cells(fx.date_forms(spark, sf), [column])
        return found.select(ROW, "raw", d.unambiguous(F.col("raw")).alias("iso"))

    return run


QUERIES |= {"date_month_first": _forms("month_first"), "date_short_year": _forms("short_year"), "date_clock": _forms("clocked")}


def _wide(case):
    def run(spark, sf):
        df = fx.wide_text(spark, sf)
        return _changes(texts.text_changes(df, ["word"], texts.surfaces(df, ["word"], case)))

    return run


QUERIES |= {"text_wide_keep": _wide("keep"), "text_wide_title": _wide("title")}


# -- profiles, names, ledger -----------------------------------------------------------------------------------------


@query
def profile_table(spark, sf):
    return _named(inference.projection(inference.infer(fx.dirty_orders(spark, sf))), column="col_name", distinct="n_distinct")


@query
def negative_named(spark, sf):
    """The check picks its columns by their names: of three with the same values, one name promises none below zero."""
    df = fx.orders_extra(spark, sf).select(ROW, F.col("amount").alias("total amount"), F.col("amount").alias("balance"), F.col("amount").alias("discounted"))
    profiles = inference.infer(df).orderBy("position").collect()
    _, notes = coherence.negative_values(coherence.context(df, profiles))
    return notes.select("key", F.col("params")["col"].alias("col_name"), F.col("params")["count"].cast("long").alias("n"))


@query
def checks_registry(spark, sf):
    """A check of one's own beside the built-in ones."""
    df = fx.dirty_customer(spark, sf)

    def too_short(ctx):
        found = ctx.values.where(~F.col("missing") & (F.length("token") < 9)).groupBy("column").agg(F.sum("n").alias("n"))
        return None, ledger.warning(found, "warn_too_short", col=F.col("column"), count=F.col("n"))

    profiles = inference.infer(df).orderBy("position").collect()
    _, notes = coherence.run_checks(coherence.context(df, profiles), [*coherence.CHECKS, too_short])
    return notes.select("key", F.coalesce(F.col("params")["col"], F.col("params")["col1"]).alias("col_name"), F.coalesce(F.col("params")["count"].cast("long"), F.lit(0)).alias("n"))


@query
def ledger_by_kind(spark, sf):
    return _changes(ledger.by_kind(_rival_changes(spark, sf), "text_norm", "date_norm"))


@query
def ledger_canonical(spark, sf):
    """Places of the resolved changes: those of no cell first, then by row."""
    kept, _ = ledger.resolve(_rival_changes(spark, sf).unionByName(inference.cast_changes(spark.createDataFrame([("price", "float64", 1.0)], "column string, dtype string, confidence double"))))
    ordered = hold(kept.orderBy(*ledger.canonical_order()).select(F.col(ROW).alias("cell_row"), "kind"))
    return _named(number_rows(ordered), row_index="place")


@query
def ledger_page(spark, sf):
    first, total = ledger.page(ledger.resolve(_rival_changes(spark, sf))[0], 200)
    return first.select(F.col(ROW).alias("cell_row"), "kind", F.lit(total).cast("long").alias("total"))


@query
def confidence_badges(spark, sf):
    levels = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), (F.col("o_orderkey") % 11 / 10).alias("confidence"))
    return levels.select(ROW, ledger.confidence_badge(F.col("confidence")).alias("badge"))


@query
def preview_rows(spark, sf):
    return preview(fx.dirty_orders(spark, sf), 50)


@query
def dedup_unknown_key(spark, sf):
    changes, notes = duplicates.find_duplicates(fx.dirty_part(spark, sf), ["name", "colour", "size"])
    return notes.select("key", F.col("params")["cols"].alias("cols"), F.lit(changes.count()).cast("long").alias("n_changes"))


@query
def dedup_truncated(spark, sf):
    sized = duplicates.blocks(duplicates.keyed(fx.dirty_customer(spark, sf), ["name"]), 100)
    notes = duplicates.truncations(sized, 100)
    return notes.select("key", F.col("params")["sig"].alias("sig"), F.col("params")["count"].cast("long").alias("n"))


@query
def dedup_redetect(spark, sf):
    """Decided changes of an older search go, those of other kinds stay as they were decided."""
    df = fx.dirty_part(spark, sf)
    other = _rival_changes(spark, sf).where("kind = 'date_norm'")
    old, told = duplicates.find_duplicates(df, ["brand"], threshold=100)
    before = ledger.set_status(other.unionByName(old), F.lit(True), "accepted")
    after, notes = duplicates.redetect(df, before, told, ["name"], threshold=LINKED)
    counts = after.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(notes.where(F.col("key") == "warn_dup_groups").select(F.col("key").alias("kind"), F.lit("").alias("status"), F.col("params")["count"].cast("long").alias("n")))


@query
def apply_last_writer(spark, sf):
    """Of several accepted changes of one cell, the one of the last kind stands."""
    return apply.apply_cells(fx.dirty_orders(spark, sf).select(ROW, "status"), ledger.set_status(_rival_changes(spark, sf), F.lit(True), "accepted"))


@query
def apply_all_kinds(spark, sf):
    """Counts by kind of cells, casts and dropped rows, and the rows left."""
    df = fx.dirty_part(spark, sf)
    doubled, _ = duplicates.find_duplicates(df, ["name"], threshold=LINKED)
    casts = inference.cast_changes(spark.createDataFrame([("brand", "category", 1.0)], "column string, dtype string, confidence double"))
    fixed, _ = coherence.null_unify(coherence.Context(df, [], df))
    done = apply.apply_changes(df, hold(ledger.set_status(doubled.unionByName(casts).unionByName(fixed), F.lit(True), "accepted")), [])
    rows = [*done.applied_by_kind.items(), ("rows_before", done.rows_before), ("rows_after", done.rows_after), ("casts", len(done.casts)), ("clean_rows", done.df.count())]
    return spark.createDataFrame(rows, "measure string, n long")


@query
def export_gates(spark, sf):
    """Whether an analysis stops the export: with open dates, and without."""
    low, _, gates = dates.normalize_dates(_low_days(spark, sf), ["low_date"])
    fine = dates.normalize_dates(fx.dirty_orders(spark, sf), ["us_date"])[2]
    either = gates.unionByName(fine)
    of = lambda name, g: g.agg(F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("blocked")).select(F.lit(name).alias("dates"), "blocked")
    return of("open", gates).unionByName(of("sure", fine)).unionByName(of("both", either))


# -- sources, sinks, sessions, reports, streams ----------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf):
    """A clean file written in row order, scanned again with everything found by itself."""
    where = _folder(spark)
    csv_text.write_csv(fx.dirty_orders(spark, sf), where)
    return csv_text.read_csv(spark, where).df


@query
def csv_found(spark, sf):
    """Encoding, delimiter and rows of one file: semicolons, cp1252, quoted line breaks, and a cap on its rows."""
    where = _folder(spark)
    rows = table(spark, sf, "customer").orderBy("c_custkey").select(F.concat(F.lit('"'), "c_name", F.lit('\nn\u00e9";'), F.col("c_custkey").cast("string"), F.lit(";\u20ac5,\u00fc")).alias("line"))
    lines = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.split_part("line", F.lit(";"), F.lit(2)).cast("long").alias("k"), "line"))), lambda x: x["line"]), "\r\n").alias("all"))  # a file is one value here
    text = lines.select(F.concat(F.lit("name;key;price\r\n"), "all")).first()[0]
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where + "/one.csv")
    out = system.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(system)
    out.write(bytearray(text.encode("cp1252")))
    out.close()
    found = csv_text.read_csv(spark, where + "/one.csv", max_rows=100, encoding="cp1252")
    return found.df.select(ROW, F.col("name").alias("cust"), "key", "price", F.lit(found.truncated).alias("truncated"), F.lit(found.delimiter).alias("delimiter"))


def _saved(spark, sf):
    df = fx.dirty_orders(spark, sf).select(ROW, "order_date", "price", "status")
    return analyse(df, Options(today=AS_OF))


@query
def session_round_trip(spark, sf):
    """An analysis saved, decided on in two steps and loaded: the later decision on a change counts."""
    where = _folder(spark)
    session.save(_saved(spark, sf), where)
    changes = session.load(spark, where).ledger
    session.decide_on(changes.where(F.col(ROW).isNotNull()), "accepted", where)
    session.decide_on(changes.where(F.col(ROW) % 2 == 0), "rejected", where)
    loaded = session.load(spark, where).ledger.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
    kept = hold(loaded)
    session.clear(spark, where)
    return kept.withColumn("cleared", F.lit(session.load(spark, where) is None))


def _report(spark, sf) -> tuple:
    df, changes = _cleaning(spark, sf)
    changes = hold(_decided(changes))
    profiles = inference.infer(df)
    notes = spark.createDataFrame([("warn_high_null", {"col": "status", "rate": "0.512"}), ("warn_ambiguous", {"col": "price"})], ledger.WARNINGS)
    return profiles, changes, notes, True, apply.apply_changes(df, changes, [])


def _document(spark, sf, form: str) -> str:
    """The folder of the report as a document, which has a line a change."""
    where = _folder(spark)
    report.write_document(*_report(spark, sf), where, form)
    return where


def _sections(found: dict) -> list[tuple[str, str, str]]:
    done = found["apply_summary"]
    return [
        *(("kind", k, str(n)) for k, n in found["counts_by_kind"].items()),
        *(("status", k, str(n)) for k, n in found["counts_by_status"].items()),
        *(("rule", r, "") for r in found["rules_triggered"]),
        *(("applied", k, str(n)) for k, n in done["applied_by_kind"].items()),
        *(("column", c["name"], f"{c['dtype']} {c['distinct']} {c['changes_accepted']}") for c in found["columns"]),
        ("rows", "before", str(done["rows_before"])),
        ("rows", "after", str(done["rows_after"])),
        ("blocked", str(found["blocked_export"]).lower(), ""),
    ]


@query
def report_json(spark, sf):
    """What the JSON says, read back: its fixed texts without their lists are JSON too, of a few rows."""
    where = _document(spark, sf, "json")
    texts = spark.read.text(where + "/*-text", wholetext=True).select(F.input_file_name().alias("at"), "value").collect()  # a row a text around a list
    few = spark.createDataFrame(_sections(json.loads("".join(r["value"] for r in sorted(texts, key=lambda r: r["at"])))), "section string, name string, value string")
    items = lambda part, kind: spark.read.text(f"{where}/*-{part}").select(F.explode(F.from_json(F.concat(F.lit("["), F.regexp_replace("value", "^,", ""), F.lit("]")), f"array<{kind}>")).alias("x"))
    shown = lambda *names: F.concat_ws(" ", *[F.coalesce(F.col(f"x.{n}"), F.lit("None")) for n in names])
    changes = items("changes", "struct<kind: string, column: string, row_index: string, after: string, status: string>").select(F.lit("change").alias("section"), shown("row_index", "column").alias("name"), shown("kind", "after", "status").alias("value"))
    notes = items("warnings", "string").select(F.lit("warning").alias("section"), F.col("x").alias("name"), F.lit("").alias("value"))
    return few.unionByName(changes).unionByName(notes)


def _table_rows(lines: DataFrame, cells) -> DataFrame:
    """The first four cells of the lines of a table of changes."""
    return lines.select(cells.alias("_")).select(F.col("_")[2].alias("col_name"), F.col("_")[3].alias("cell_row"), F.col("_")[1].alias("kind"), F.col("_")[0].alias("status"))


@query
def report_markdown(spark, sf):
    """The rows of the table of changes, read back from the Markdown."""
    lines = spark.read.text(_document(spark, sf, "md") + "/*-changes")
    return _table_rows(lines, F.split(F.regexp_replace("value", r"^\| | \|$", ""), r" \| "))


@query
def report_html(spark, sf):
    """The rows of the table of changes, read back from the HTML."""
    lines = spark.read.text(_document(spark, sf, "html") + "/*-changes")
    return _table_rows(lines, F.transform(F.regexp_extract_all("value", F.lit("<td>(.*?)</td>"), F.lit(1)), report.unescaped))


@query
def report_files(spark, sf):
    """Lines of a report that is written as files: changes in the report's order, and warnings in words."""
    where = _folder(spark)
    df, changes = _cleaning(spark, sf)
    changes = hold(_decided(changes))
    notes = spark.createDataFrame([("warn_high_null", {"col": "status", "rate": "0.512"}), ("warn_ambiguous", {"col": "price"}), ("warn_of_ones_own", {})], ledger.WARNINGS)
    report.write_report(inference.infer(df), changes, notes, False, apply.apply_changes(df, changes, []), where, "md")
    read = lambda part: spark.read.text(f"{where}/{part}").select(F.lit(part).alias("part"), F.col("value").alias("line"))
    return read("changes").unionByName(read("warnings"))


@query
def stream_proposals(spark, sf):
    """The row-local rules over a stream of files, written once, under a profile and vote of the columns."""
    where = _folder(spark)
    df = fx.dirty_orders(spark, sf).select(ROW, "us_date", "priority", "status")
    df.write.parquet(where + "/in")
    stream = spark.readStream.schema(df.schema).parquet(where + "/in")
    profiles = [{"column": "us_date", "dtype": "datetime"}, {"column": "priority", "dtype": "category"}, {"column": "status", "dtype": "category"}]
    running = stateless.proposals(stream, profiles, {"us_date": "MDY"}).writeStream.format("parquet").option("path", where + "/out").option("checkpointLocation", where + "/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return _changes(spark.read.parquet(where + "/out"))
