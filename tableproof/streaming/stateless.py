"""Streams: the row-local rules under a profile that was frozen on a batch.

Types, the order of day and month, and category winners look at whole columns, so they come from a batch; each arriving
row is then proposed the same changes as in a batch, without state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.functions import dates as d
from tableproof.functions.text import surface
from tableproof.functions.tokens import null_like, strip
from tableproof.operators.ledger import change
from tableproof.plans.cells import cells


def proposals(rows: DataFrame, profiles: list, orders: dict[str, str | None], case: str = "keep") -> DataFrame:
    """Changes of arriving rows (row_index and text columns). profiles: rows of a profile table; orders: by date column."""
    kinds = {p["column"]: p["dtype"] for p in profiles}
    long = cells(rows)
    column = F.col("column")
    pick = lambda *names: column.isin(*[c for c, k in kinds.items() if k in names]) if any(k in names for k in kinds.values()) else F.lit(False)
    token = strip(F.col("raw"))
    order = F.lit(None).cast("string")
    for name, value in orders.items():
        order = F.when(column == name, F.lit(value)).otherwise(order)
    iso = F.coalesce(d.unambiguous(token), d.ordered(token, order))
    missing, blank = null_like(F.col("raw")), token == ""
    shown = surface(F.col("raw"), case)
    date = ~missing & pick("datetime") & iso.isNotNull() & (iso != token)
    text = ~missing & pick("string", "category") & (shown != F.col("raw"))
    nothing = missing & F.col("raw").isNotNull() & ~blank
    said = long.withColumn("_kind", F.when(date, "date_norm").when(text, "text_norm").when(nothing, "coherence_fix")).withColumn("_iso", iso).withColumn("_shown", shown).withColumn("_token", token).where(F.col("_kind").isNotNull())
    after = F.when(F.col("_kind") == "date_norm", F.col("_iso")).when(F.col("_kind") == "text_norm", F.col("_shown")).otherwise("")
    before = F.when(F.col("_kind") == "date_norm", F.col("_token")).otherwise(F.col("raw"))
    rule = F.when(F.col("_kind") == "date_norm", "date:iso").when(F.col("_kind") == "text_norm", "text:surface").otherwise("null:unify")
    return change(said, kind=F.col("_kind"), column=column, row=F.col("row_index"), before=before, after=after, rule=rule, confidence=F.lit(1.0))


def start(stream: DataFrame, profiles: list, orders: dict[str, str | None], sink: str, checkpoint: str, case: str = "keep"):
    """Writes a stream's proposals as Parquet, exactly once, until stopped."""
    return proposals(stream, profiles, orders, case).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").start()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """act on every micro-batch, for rules that look at the batch as a whole."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).start()
