"""Benchmark decontamination by template windows.

Texts are brought to templates: numbers, units and names become typed placeholders, everything else its lower-cased
words. Windows of five template tokens are hashed and joined with the windows of the benchmark's items, so questions
that came back with other numbers or names still meet their item. For documents that hold enough of an item's windows,
the placeholders' values are read again and checked for slot consistency: along the alignment with most windows, one
value of the item must always stand for one value of the document.

Items of under five tokens, or without a window of at least min_literals plain words, are found by their literal tokens,
values included, as one run of a text; those of under min_literals tokens ("4 + 4" has two) can't be found.

Everything is DataFrame functions. Nulls: a null text has no windows. Texts of under five tokens are one window. Rows
that repeat an id and a text share a verdict, rows with a null id and one text too; an empty table or benchmark flags
nothing. Other columns of the documents are passed over by judge() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.llm.common import broadcast_if, hold, let

#: Units of measure and money that follow a number.
UNITS = "kg g mg lb lbs oz km cm mm mi ft l ml h hr hrs min mins sec secs s kwh kw mph kmh km/h % percent degrees dollars dollar euros euro cents pounds meters metres miles feet inches hours minutes seconds days weeks months years liters litres grams kilograms".split()
#: Capitalised words that are no names: articles, pronouns, prepositions and question words.
PLAIN = "the a an and or but if in on at of to for from by with as is are was were be it its this that these those he she they we you i his her their what which who when where why how not no so then there each every all some one der die das und ist ein eine einer nicht von zu mit den dem des im auf für als auch sich wie was wer wenn le la les un une des du de et est que qui dans pour par sur avec il elle on ne pas el los las del y en se por con una su al lo como más pero".split()
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"


@dataclass(frozen=True)
class TemplateRules:
    width: int = 5
    min_literals: int = 3
    #: Share of an item's windows that a document must hold, and of its slots that must be consistent.
    containment: float = 0.5
    consistency: float = 0.7
    #: The benchmark's windows (16 bytes each) are broadcast up to so many, else both sides are shuffled.
    broadcast_windows: int = 500_000


def _marked(text: Column, values: bool, names: bool = True) -> Column:
    """The text in lower case with each number, unit and name as <n>, <u>, <a> (or <n:12>); names in a row are one.

    A name begins with a capital and has a small letter: words all in capitals are plain.

    Each pattern begins with a cheap look at the next character, so most places of a text are passed at once.
    """
    mark = lambda kind, group: f"<{kind}:${group}>" if values else f"<{kind}>"
    t = F.translate(F.coalesce(text, F.lit("")), "<>", "  ")
    units = "|".join(sorted((u.replace("%", "[%]") for u in UNITS), key=lambda u: (-len(u), u)))
    measured = F.regexp_replace(t, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}])({NUMBER})\x20?((?i:{units}))(?![\p{{L}}\p{{N}}])", f" {mark('n', 1)} {mark('u', 2)} ")
    numbered = F.regexp_replace(measured, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}:.,/])({NUMBER})(?![\p{{L}}\p{{N}}>])", f" {mark('n', 1)} ")
    t = F.when(t.rlike("[0-9]"), numbered).otherwise(t)
    if not names:
        return F.lower(t)
    plain = "|".join(PLAIN)
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}[\p{{L}}\p{{M}}'’-]*?\p{{Ll}})(?<![\p{{L}}\p{{N}}<:])(?!(?iu:{plain})(?![\p{{L}}\p{{N}}]))([\p{{L}}\p{{M}}'’-]+)", f" {mark('a', 1)} ")
    row = r"(<a:[^<>]*>)(?:\s+<a:[^<>]*>)+" if values else r"(<a>)(?:\s+<a>)+"
    return F.lower(F.regexp_replace(t, row, "$1"))


def template(text: Column, names: bool = True) -> Column:
    """Array of template tokens: words, <n>, <u> and <a>."""
    return F.regexp_extract_all(_marked(text, False, names), F.lit(r"<[nua]>|[\p{L}\p{N}]+"), F.lit(0))


def slots(text: Column, names: bool = True) -> Column:
    """The same tokens with the placeholders' values: <n:12>."""
    return F.regexp_extract_all(_marked(text, True, names), F.lit(r"<[nua]:[^<>]*>|[\p{L}\p{N}]+"), F.lit(0))


def windows(tokens: Column, width: int) -> Column:
    """Array of the windows' hashes, by their first token's place; a short text is one window."""

    def of(t: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(width)]))
        return F.when(F.size(t) >= width, several).when(F.size(t) > 0, F.array(F.xxhash64(F.array_join(t, " "), F.size(t)))).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, of)


def valued_windows(text: Column, width: int, names: bool = True) -> Column:
    """Array of struct(at, h, v): each window's place, hash and the values of its tokens."""

    def of(v: Column) -> Column:
        plain = F.transform(v, lambda x: F.regexp_replace(x, "^<([nua]):.*>$", "<$1>"))
        return F.transform(windows(plain, width), lambda h, i: F.struct(i.alias("at"), h.alias("h"), F.slice(v, i + 1, width).alias("v")))

    return let(slots(text, names), of)


def item_windows(items: DataFrame, rules: TemplateRules, id_column: str, text_column: str) -> DataFrame:
    """item, names, h, at, full, total (windows of the item that count): windows with enough plain words.

    Each item is taken with names as placeholders and, for texts all in capitals, without.
    """
    both = [items.select(F.col(id_column).alias("item"), F.lit(names).alias("names"), template(F.col(text_column), names).alias("t")) for names in (True, False)]
    tokens = both[0].unionByName(both[1]).withColumn("w", windows(F.col("t"), rules.width))
    rows = tokens.select("item", "names", "t", F.posexplode("w").alias("at", "h"))
    literals = F.size(F.filter(F.slice("t", F.col("at") + 1, rules.width), lambda x: ~x.startswith("<")))
    good = rows.where(literals >= rules.min_literals).select("item", "names", "h", "at", (F.size("t") >= rules.width).alias("full"))
    total = good.groupBy("item", "names").agg(F.countDistinct("h").alias("total"))
    return good.join(total, ["item", "names"])


def verbatim(named: DataFrame, items: DataFrame, bench: DataFrame, rules: TemplateRules, id_column: str, text_column: str) -> DataFrame | None:
    """id, version, item, share, consistency of the documents that hold, token by token, an item that windows can't find.

    None if there are no such items.
    """
    literal = items.select(F.col(id_column).alias("item"), slots(F.col(text_column), False).alias("t")).where(F.size("t") >= rules.min_literals)
    rest = literal.join(bench.where(F.col("names") & F.col("full")).select("item").distinct(), "item", "left_anti")
    # the first tokens find the places, the whole run decides
    exact = hold(rest.select("item", F.get(windows(F.col("t"), rules.min_literals), F.lit(0)).alias("h"), F.array_join("t", " ").alias("run")))
    if exact.isEmpty():
        return None
    tokens = slots(F.col("text"), False)
    places = named.select("id", "version", F.explode(F.array_distinct(windows(tokens, rules.min_literals))).alias("h"))
    some = hold(places.join(broadcast_if(exact, rules.broadcast_windows), "h").select("id", "version", "item", "run").distinct())
    whole = named.join(broadcast_if(some.select("id", "version").distinct(), 200_000), ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
    lines = whole.select("id", "version", F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("line"))
    held = lines.join(some, ["id", "version"]).where(F.contains("line", F.concat(F.lit(" "), F.col("run"), F.lit(" "))))
    return held.select("id", "version", "item", F.lit(1.0).alias("share"), F.lit(1.0).alias("consistency"))


def _key(id_column: str) -> Column:
    """The id as a join key: as a field of a struct, a null is a value like any other."""
    return F.struct(F.col(id_column).alias("id")).alias("id")


def holders(hits: DataFrame, bench: DataFrame, rules: TemplateRules) -> DataFrame:
    """id, version, item, names, share of the documents that hold enough of an item's windows. hits (held): id, version, h.

    A document that holds enough of an item's T windows has one of any T - needed + 1 of them: only windows that few
    items share propose items, so a preamble of a thousand items proposes none of them. All windows count afterwards.
    """
    of_item = bench.select("item", "names", "h", "total").distinct()
    uses = of_item.groupBy("h").agg(F.count(F.lit(1)).alias("uses"))
    by_use = Window.partitionBy("item", "names").orderBy("uses", "h")
    rare = of_item.join(uses, "h").withColumn("r", F.row_number().over(by_use)).where(F.col("r") <= F.col("total") - F.ceil(F.col("total") * rules.containment) + 1)
    proposed = hits.join(broadcast_if(hold(rare.select("h", "item", "names")), rules.broadcast_windows), "h").select("id", "version", "item", "names").distinct()
    windows_of = proposed.join(broadcast_if(hold(of_item), rules.broadcast_windows), ["item", "names"])
    counted = windows_of.join(hits, ["id", "version", "h"]).groupBy("id", "version", "item", "names").agg((F.count(F.lit(1)) / F.min("total")).alias("share"))
    return counted.where(F.col("share") >= rules.containment)


def consistent(meets: DataFrame) -> DataFrame:
    """id, version, item, share, consistency along the alignment with most windows.

    meets (held): id, version, item, names, share, offset (of the alignment) and pairs (iv, dv) of slots, a row for each
    window of an item that a document holds. The consistency is the share of distinct pairs whose item value has no
    other document value.
    """
    key = ["id", "version", "item"]
    along = meets.groupBy(*key, "names", "share", "offset").agg(F.count(F.lit(1)).alias("n"))
    best = along.groupBy(*key).agg(F.max(F.struct("n", "share", "names", (-F.col("offset")).alias("back"))).alias("best"))
    best = best.select(*key, F.col("best.share").alias("share"), F.col("best.names").alias("names"), (-F.col("best.back")).alias("offset"))
    pairs = meets.join(best.drop("share"), [*key, "names", "offset"]).select(*key, F.explode("pairs").alias("p")).select(*key, "p.iv", "p.dv").distinct()
    values = pairs.groupBy(*key, "iv").agg(F.count(F.lit(1)).alias("n"))
    kept = values.groupBy(*key).agg((F.sum((F.col("n") == 1).cast("long")) / F.sum("n")).alias("consistency"))
    return best.join(kept, key, "left").select(*key, "share", F.coalesce("consistency", F.lit(1.0)).alias("consistency"))


def contaminated(docs: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """id (struct of the id), version (hash of the text), item, share, consistency of the documents that hold an item: held."""
    bench = hold(item_windows(items, rules, item_column, item_text))
    wanted = hold(bench.select("h").distinct())
    named = docs.select(_key(id_column), F.xxhash64(F.col(text_column)).alias("version"), F.col(text_column).cast("string").alias("text"))
    hashes = named.select("id", "version", F.explode(F.array_distinct(windows(template(F.col("text")), rules.width))).alias("h"))
    hits = hold(hashes.join(broadcast_if(wanted, rules.broadcast_windows), "h").distinct())
    likely = hold(holders(hits, bench, rules))
    # slots are read only in documents that are likely to hold an item
    some = named.join(broadcast_if(hold(likely.select("id", "version").distinct()), 200_000), ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
    doc_side = some.select("id", "version", F.explode(valued_windows(F.col("text"), rules.width)).alias("w")).select("id", "version", F.col("w.at").alias("p"), F.col("w.h").alias("h"), F.col("w.v").alias("dv"))
    doc_side = doc_side.join(broadcast_if(wanted, rules.broadcast_windows), "h", "left_semi").join(likely, ["id", "version"])
    both = [items.select(F.col(item_column).alias("item"), F.lit(names).alias("names"), F.explode(valued_windows(F.col(item_text), rules.width, names)).alias("w")) for names in (True, False)]
    item_side = both[0].unionByName(both[1]).select("item", "names", F.col("w.h").alias("h"), F.col("w.at").alias("at"), F.col("w.v").alias("iv")).join(bench.select("item", "names", "h", "at"), ["item", "names", "h", "at"], "left_semi")
    pairs = F.filter(F.arrays_zip(F.col("iv").alias("iv"), F.col("dv").alias("dv")), lambda x: x["iv"].startswith("<"))
    meets = doc_side.join(broadcast_if(hold(item_side), rules.broadcast_windows), ["item", "names", "h"]).select("id", "version", "item", "names", "share", (F.col("p") - F.col("at")).alias("offset"), pairs.alias("pairs"))
    found = consistent(hold(meets)).where(F.col("consistency") >= rules.consistency)
    exact = verbatim(named, items, bench, rules, item_column, item_text)
    if exact is None:
        return hold(found)
    return hold(found.unionByName(exact).groupBy("id", "version", "item").agg(F.max("share").alias("share"), F.max("consistency").alias("consistency")))


def judge(docs: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, contaminated, item_id (the one held most, ties to the smallest), share, consistency, n_items for each row."""
    found = contaminated(docs, items, rules, id_column=id_column, text_column=text_column, item_column=item_column, item_text=item_text)
    by_doc = found.groupBy("id", "version").agg(F.min_by(F.struct("item", "share", "consistency"), F.struct(-F.col("share"), -F.col("consistency"), F.col("item"))).alias("best"), F.count(F.lit(1)).alias("n"))
    rows = docs.select(_key(id_column), F.xxhash64(F.col(text_column)).alias("version"))
    joined = rows.join(by_doc, ["id", "version"], "left")
    return joined.select(F.col("id.id").alias("doc_id"), F.col("best").isNotNull().alias("contaminated"), F.col("best.item").alias("item_id"), F.col("best.share").alias("share"), F.col("best.consistency").alias("consistency"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


def clean(docs: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that hold no item."""
    found = contaminated(docs, items, rules, id_column=id_column, text_column=text_column)
    gone = hold(found.select("id", "version").distinct())
    rows = docs.select(F.struct("*").alias("row"), _key(id_column), F.xxhash64(F.col(text_column)).alias("version"))
    kept = rows.join(broadcast_if(gone, 200_000), ["id", "version"], "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
