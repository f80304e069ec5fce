"""Connected components inside small groups: blocks of rows and columns' value lists, whose sizes are bounded."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _roots(pairs: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = sorted(parent)
    return pd.DataFrame({"part": pairs["part"].iloc[0], "node": nodes, "root": [root(n) for n in nodes]})


def components_in(links: DataFrame, part: str) -> DataFrame:
    """part, node, root (the smallest node of its component) of links (part, a, b); only linked nodes appear.

    A part must be bounded: its links are in one task. Blocks hold at most max_bucket rows, columns 50 categories.
    """
    narrow = links.select(F.col(part).cast("string").alias("part"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = narrow.groupBy("part").applyInPandas(_roots, "part string, node long, root long")
    return found.withColumnRenamed("part", part)
