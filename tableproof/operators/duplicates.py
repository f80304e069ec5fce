"""Approximate duplicate rows: blocked by the first character of a key, linked by token-set similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableproof.functions.similarity import scored
from tableproof.functions.text import row_key, word_set
from tableproof.functions.tokens import null_like
from tableproof.operators.ledger import WARNINGS, change, empty, warning
from tableproof.plans.cells import ROW, columns_of, first_rows
from tableproof.plans.groups import components_in
from tableproof.plans.held import hold
from tableproof.plans.rows import number_by


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """row_index, key, sig (its block), completeness (cells of the row that aren't missing)."""
    full = sum(((~null_like(F.col(f"`{c}`").cast("string"))).cast("int") for c in columns_of(df)), F.lit(0))
    key = row_key([F.col(f"`{c}`").cast("string") for c in keys])
    return df.select(ROW, key.alias("key"), full.alias("completeness")).withColumn("sig", F.substring("key", 1, 1))


def blocks(rows: DataFrame, max_bucket: int | None) -> DataFrame:
    """sig, rows, last: each block's size and, for one of over max_bucket rows, the last row that is compared.

    With None every row is: equal keys collapse, tiles and length bounds do the rest.
    """
    sizes = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min(ROW).alias("block_first"))
    if max_bucket is None:
        return sizes.withColumn("last", F.lit(None).cast("long"))
    return sizes.join(first_rows(rows, ["sig"], max_bucket), "sig", "left")


def compared(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """The rows that take part: those of blocks with a partner, up to the block's last compared row."""
    joined = rows.join(sized.where(F.col("rows") > 1), "sig")
    return joined.where(F.col("last").isNull() | (F.col(ROW) <= F.col("last"))).drop("last", "rows")


def distinct_keys(members: DataFrame) -> DataFrame:
    """sig, key, kid (the first row with that key in its block)."""
    return members.groupBy("sig", "key").agg(F.min(ROW).alias("kid"))


def links(keys: DataFrame, threshold: float, tile: int = 256) -> DataFrame:
    """sig, a, b, similarity: distinct keys of one block that are similar enough.

    Blocks are few and uneven, so the left side goes in tiles and the right side to each of its block's tiles.
    """
    ranked = keys.withColumn("_tile", F.floor((F.row_number().over(Window.partitionBy("sig").orderBy("kid")) - 1) / tile).cast("int"))
    tiles = ranked.groupBy("sig").agg(F.max("_tile").alias("_last"))
    right = keys.join(tiles, "sig").select("sig", F.col("kid").alias("b"), F.col("key").alias("right"), F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_tile"))
    left = ranked.select("sig", "_tile", F.col("kid").alias("a"), F.col("key").alias("left"))
    pairs = left.join(right, ["sig", "_tile"]).where(F.col("a") < F.col("b"))
    return scored(pairs, "left", "right", least=threshold).select("sig", "a", "b", "similarity")


def groups(members: DataFrame, threshold: float) -> DataFrame:
    """members of groups of two rows or more, with root (the group's first key) and gid.

    Rows with equal keys link if the key has a word at all. Groups are numbered by their block's first row, then
    their own first row.
    """
    roots = components_in(links(distinct_keys(members), threshold), "sig").select("sig", F.col("node").alias("kid"), "root")
    placed = members.join(distinct_keys(members), ["sig", "key"]).join(roots, ["sig", "kid"], "left")
    words = F.size(word_set(F.col("key"))) > 0
    placed = placed.where(F.col("root").isNotNull() | words).withColumn("root", F.coalesce("root", "kid"))
    sizes = placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("size"), F.min(ROW).alias("group_first"), F.min("block_first").alias("block_first")).where(F.col("size") > 1)
    numbered = number_by(sizes, "block_first", "group_first").withColumnRenamed(ROW, "gid")
    return placed.drop("block_first").join(numbered.select("sig", "root", "gid", "size"), ["sig", "root"])


def losers(grouped: DataFrame) -> DataFrame:
    """row_index, key, gid, winner, winner_key, similarity: every row but the most complete (first) one of its group."""
    best = Window.partitionBy("sig", "root").orderBy(F.desc("completeness"), ROW)
    ranked = grouped.withColumn("_rank", F.row_number().over(best)).withColumn("winner", F.first(ROW).over(best)).withColumn("winner_key", F.first("key").over(best))
    lost = ranked.where(F.col("_rank") > 1).select(ROW, "key", "gid", "winner", "winner_key")
    return scored(lost, "key", "winner_key")


def truncations(sized: DataFrame, max_bucket: int | None) -> DataFrame:
    """A warning for each block of which only the first max_bucket rows are compared."""
    return warning(sized.where(F.col("rows") > F.lit(max_bucket).cast("long")), "warn_dup_truncated", sig=F.col("sig"), count=F.col("rows"), max=F.lit(max_bucket))


def find_duplicates(df: DataFrame, keys: list[str], *, threshold: float = 85, max_bucket: int | None = 1500) -> tuple[DataFrame, DataFrame]:
    """Ledger and warnings: a dedup change for each row that a more complete near copy makes superfluous.

    A block compares its first max_bucket rows, and a warning tells where there are more; with None it compares all.
    """
    spark = df.sparkSession
    missing = [c for c in keys if c not in columns_of(df)]
    if missing:
        note = spark.createDataFrame([("warn_dup_unknown", {"cols": ", ".join(missing)})], WARNINGS)
        return empty(spark), note
    rows = keyed(df, keys)
    sized = blocks(rows, max_bucket)
    grouped = hold(groups(compared(rows, sized), threshold))
    ledger = change(losers(grouped), kind="dedup", column=None, row=F.col(ROW), before=F.col("key"), after=None, rule=F.concat(F.lit("dedup:g"), F.col("gid").cast("string")), confidence=F.col("similarity") / 100)
    found = grouped.agg(F.count_distinct("gid").alias("n")).where(F.col("n") > 0)
    return ledger, truncations(sized, max_bucket).unionByName(warning(found, "warn_dup_groups", count=F.col("n"), cols=F.lit(", ".join(keys))))


def redetect(df: DataFrame, ledger: DataFrame, warnings: DataFrame, keys: list[str], *, threshold: float = 85, max_bucket: int | None = 1500) -> tuple[DataFrame, DataFrame]:
    """Ledger and warnings with the duplicates found anew; their decisions are open again."""
    fresh, notes = find_duplicates(df, keys, threshold=threshold, max_bucket=max_bucket)
    old = warnings.where(~F.col("key").startswith("warn_dup_"))
    return ledger.where(F.col("kind") != "dedup").unionByName(fresh), old.unionByName(notes)
