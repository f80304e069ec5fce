"""Cross-site boilerplate: lines that many distinct sites carry are removed, but for their first occurrence.

Each line hash gets a HyperLogLog sketch of the sites it stands on; sketches merge in partial aggregation, so a line
that half the corpus carries costs one sketch a task. Estimates clearly above or below the threshold decide; lines near
it get an exact distinct count. The first document (smallest id) with a boilerplate line keeps it, so a text that many
sites carry whole survives once.

Nulls: a null text has no lines and stays null; rows with a null site count as one site of their own. Blank lines are
never boilerplate. A line's key is its text lower-cased, trimmed and with runs of white space as one space. A document
that loses all its words this way is dropped; one that had none stays. Repeated rows are each cleaned; rows that share
an id share its first-occurrence right. A null id is no first document unless all of a line's ids are null. Other
columns are kept, whatever their names; the count's name is a parameter. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import WS, hold, join_hot, let


@dataclass(frozen=True)
class SpreadLimits:
    #: A line on so many distinct sites is boilerplate.
    min_sites: int = 10
    #: Base-2 logarithm of the sketch's registers; relative error is about 1.04 / sqrt(2 ** lg_k).
    lg_k: int = 11
    #: Estimates within so many standard errors (and one site) of the threshold are counted exactly.
    errors: float = 4.0
    #: Up to so many boilerplate lines (16 bytes each) are broadcast; more are joined over salted keys.
    broadcast_lines: int = 500_000

    @property
    def band(self) -> tuple[float, float]:
        width = max(1.0, self.errors * 1.04 / 2 ** (self.lg_k / 2) * self.min_sites)
        return self.min_sites - width, self.min_sites + width


def line_key(line: Column) -> Column:
    """64-bit key of a line; null if it is blank."""
    clean = F.trim(F.regexp_replace(F.lower(line), WS, " "))
    return F.when(clean != "", F.xxhash64(clean))


def lines_of(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """id, version (of the text), site, at (0-based), key: a row for each line that isn't blank."""
    text = F.col(text_column)
    parts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("version"), F.coalesce(F.col(site_column).cast("string"), F.lit("\u0000null")).alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return parts.select("id", "version", "site", "at", line_key(F.col("line")).alias("key")).where(F.col("key").isNotNull())


def boilerplate(lines: DataFrame, limits: SpreadLimits = SpreadLimits()) -> DataFrame:
    """key, first_id of each line that stands on limits.min_sites sites or more."""
    low, high = limits.band
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(limits.lg_k))).alias("sites"), F.min("id").alias("first_id")).where(F.col("sites") >= low)
    sure = spread.where(F.col("sites") > high).select("key", "first_id")
    near = spread.where(F.col("sites") <= high).select("key", "first_id")
    pairs = lines.select("key", "site").distinct().join(near, "key")
    exact = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("sites"), F.min("first_id").alias("first_id")).where(F.col("sites") >= limits.min_sites)
    return sure.unionByName(exact.select("key", "first_id"))


def remove_boilerplate(docs: DataFrame, limits: SpreadLimits = SpreadLimits(), *, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", drop_empty: bool = True, count_column: str = "_n_removed") -> DataFrame:
    """docs with their columns, the text without boilerplate lines, and the number of lines removed as count_column."""
    lines = hold(lines_of(docs, id_column, text_column, site_column))  # three passes read it; the texts are split once
    common = hold(boilerplate(lines, limits))
    gone = join_hot(lines, common, "key", ["id", "at"], limits.broadcast_lines).where(~F.col("id").eqNullSafe(F.col("first_id")))
    marked = gone.groupBy("id", "version").agg(F.collect_set("at").alias("places"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("rid"), F.xxhash64(F.col(text_column)).alias("rv"))
    joined = rows.join(marked, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rv") == F.col("version")), "left")
    text = F.col("row")[text_column]

    def rest(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("places"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    kept = F.when(F.col("places").isNull(), text).otherwise(let(F.split(text, "\n"), rest))
    out = joined.select("row", kept.alias("kept"), F.coalesce(F.size("places"), F.lit(0)).alias("n"))
    if drop_empty:
        out = out.where((F.col("n") <= 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col("kept").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns, F.greatest(F.col("n"), F.lit(0)).cast("long").alias(count_column))
