"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and max_copies. Among all rates that take each source's target number of words,
those of greatest (bounded) entropy are wanted: by duality they are exponentially tilted in the document's size,
rate = max_copies / (1 + exp(-lambda * size / mean)), with one lambda a source. Distributed Newton iterations solve
the convex dual: each sums gradient and curvature over the histogram of sizes, and a bracket catches steps that would
leave it. All sums are of whole numbers, so reruns agree to the bit.

Rates become copies by systematic rounding along the sizes of a source, whose error is at most about one document; what
is then missing or too much is given to or cut from single documents in hash order, so a source's taken words meet its
target to the word. Running totals are taken bucket by bucket: no task holds a source.

Nulls: a null text has size 0, a null source is a source of its own, ordered last, a null id is an id. Rows that repeat
an id, a source and a text share one decision. An empty table gives an empty result. Other columns are passed over by
mix() and kept by mixed_documents(), whose added names are a parameter. Sources are ordered in one task, a row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.llm.common import hold, hold_fit, join_hot, word_count

UNIT = 1 << 20  # rates are counted in this fraction


@dataclass(frozen=True)
class MixSpec:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: Words the mix takes, as a share of all words.
    budget: float = 1.5
    max_copies: int = 2
    tolerance: float = 1e-7
    max_rounds: int = 40
    #: Newton steps between two looks at the residual.
    steps: int = 3
    #: Up to so many sources their table (under 100 bytes each) is broadcast; more are joined with salt.
    broadcast_sources: int = 50_000


def _src(source_column: str) -> Column:
    """The source as a key that is never null: null comes as "w", after all others ("v...")."""
    return F.coalesce(F.concat(F.lit("v"), F.col(source_column).cast("string")), F.lit("w"))


def units_of(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """A row for each distinct (id, source, text): src (never null), size and how many rows it stands for."""
    rows = docs.select(F.col(id_column).alias("id"), _src(source_column).alias("src"), F.xxhash64(F.col(text_column)).alias("version"), word_count(F.col(text_column)).alias("size"))
    return rows.groupBy("id", "src", "version", "size").agg(F.count(F.lit(1)).alias("m"))


def targets(by_source: DataFrame, spec: MixSpec) -> DataFrame:
    """src, source_size, target: the budget by weight, capped at max_copies times a source's size.

    The excess is reshared until no source is above: with sources ordered by cap / weight, those below the water
    level are capped and the rest share what is left by weight. One row a source; nothing here follows the documents.
    """
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    # the table has a row for each source, so one task orders it
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy("src")))
    ranked = ranked.withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(spec.weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * spec.max_copies)
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.sum("source_size").over(whole) * spec.budget - before) / after)
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("rank"), F.col("level").alias("level")))
    levels = levels.withColumn("water", F.min(fits).over(whole)["level"])
    target = F.least(F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return levels.select("src", "source_size", target.alias("target"))


def _rate(lam: Column, x: Column, spec: MixSpec) -> Column:
    """Rate in UNITs, a whole number."""
    return F.round(F.lit(float(spec.max_copies * UNIT)) / (1 + F.exp(-F.greatest(F.least(lam * x, F.lit(60.0)), F.lit(-60.0))))).cast("long")


def solve(histogram: DataFrame, goals: DataFrame, spec: MixSpec) -> DataFrame:
    """src, source_size, target, mean, lam: the dual's solution for each source. histogram: src, size, n."""
    state = goals.join(histogram.groupBy("src").agg(F.sum("n").alias("docs")), "src")
    state = state.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    # a source that is taken whole has no finite solution, nor has an empty one
    full = F.col("target") >= F.col("source_size") * spec.max_copies * (1 - 1e-12)
    state = state.withColumn("lam", F.when(full, F.lit(1e12)).otherwise(F.lit(0.0))).withColumn("low", F.lit(-1e7)).withColumn("high", F.lit(1e7)).withColumn("rest", F.when(full, F.lit(0.0)).otherwise(F.lit(1.0)))
    state = hold(state)
    few = state.count() <= spec.broadcast_sources
    for _ in range(spec.max_rounds):
        for _ in range(spec.steps):
            state = _newton(histogram, F.broadcast(state) if few else state, spec)
        state = hold(state)
        worst = state.agg(F.max("rest").alias("worst")).first()["worst"]
        if worst is None or worst <= spec.tolerance:
            break
    return state.select("src", "source_size", "target", "mean", "lam")


STATE = ("source_size", "target", "docs", "mean", "lam", "low", "high", "rest")


def _newton(histogram: DataFrame, state: DataFrame, spec: MixSpec) -> DataFrame:
    """One step: the gradient is words taken less target, the curvature its derivative by lambda."""
    x = F.col("size") / F.col("mean")
    rate = _rate(F.col("lam"), x, spec)
    share = rate / F.lit(float(spec.max_copies * UNIT))
    words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
    bend = F.round(share * (1 - share) * x * UNIT).cast("decimal(38,0)")
    sums = histogram.join(state, "src").groupBy("src").agg(F.sum((words * rate).cast("decimal(38,0)")).alias("taken"), F.sum((words * bend).cast("decimal(38,0)")).alias("bend"), *[F.max(c).alias(c) for c in STATE])
    over = F.col("taken").cast("double") / UNIT - F.col("target")
    low, high = F.when(over <= 0, F.col("lam")).otherwise(F.col("low")), F.when(over >= 0, F.col("lam")).otherwise(F.col("high"))
    step = F.col("lam") - over / F.greatest(F.col("bend").cast("double") / UNIT * spec.max_copies, F.lit(1e-300))
    inside = (step > low) & (step < high)
    done = (F.col("rest") <= spec.tolerance) | (F.abs(over) <= spec.tolerance * F.greatest(F.col("target"), F.lit(1.0)))
    rest = F.when(done, F.lit(0.0)).when(high - low <= 1e-13 * F.greatest(F.abs(high), F.lit(1e-9)), F.lit(0.0)).otherwise(F.abs(over) / F.greatest(F.col("target"), F.lit(1.0)))
    lam = F.when(done, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
    return sums.select("src", "source_size", "target", "docs", "mean", lam.alias("lam"), low.alias("low"), high.alias("high"), rest.alias("rest"))


def running(rows: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """rows (held: they are read several times) with the sum of value over all rows of the same keys before, as out.

    The order is by levels, then order. Each level's buckets are summed and only their sums ordered, so one task
    sees one bucket of rows, or the buckets of one level; keys, levels and order hold no nulls.
    """
    keys, levels = list(keys), list(levels)
    offsets = None
    for i in range(len(levels)):
        sums = rows.groupBy(*keys, *levels[: i + 1]).agg(F.sum(value).alias("_sum"))
        before = Window.partitionBy(*keys, *levels[:i]).orderBy(levels[i]).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*keys, *levels[: i + 1], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(f"_offset{i}"))
        offsets = sums if offsets is None else sums.join(offsets, [*keys, *levels[:i]])
    start = sum((F.col(f"_offset{i}") for i in range(len(levels))), F.lit(0))
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets.select(*keys, *levels, start.alias("_start")), [*keys, *levels])
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start")


def _with_sources(units: DataFrame, sources: DataFrame, spec: MixSpec) -> DataFrame:
    """units joined with their source's row."""
    return join_hot(units, sources, "src", ["id", "version"], spec.broadcast_sources)


def mix_units(units: DataFrame, spec: MixSpec) -> DataFrame:
    """units (held) with source_size, target and taken (words of each of the unit's rows)."""
    histogram = hold_fit(units.groupBy("src", "size").agg(F.sum("m").alias("n")))
    by_source = histogram.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = hold(solve(histogram, targets(by_source, spec), spec))
    rated = _with_sources(units, sources, spec)
    mark = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "version")
    rated = hold(rated.select("id", "src", "version", "size", "m", _rate(F.col("lam"), F.col("size") / F.col("mean"), spec).alias("rate"), mark.alias("mark"), F.pmod(mark, F.lit(64)).alias("bucket")))
    # systematic rounding along the sizes: a copy falls due whenever the running sum of rates passes a whole number
    summed = running(rated, ["src"], ["size", "bucket"], ["mark", "id"], "rate", "before")
    start = F.col("before") + F.pmod(F.xxhash64("src"), F.lit(UNIT))
    copies = F.floor((start + F.col("rate")) / UNIT) - F.floor(start / UNIT)
    copied = hold(summed.select("id", "src", "version", "size", "m", "mark", F.pmod(F.shiftright(F.col("mark"), 8), F.lit(1024)).alias("bucket"), (copies * F.col("size")).cast("long").alias("whole")))
    # what each source lacks goes to the first documents in hash order that have room, what it has too much is cut
    got = copied.groupBy("src").agg(F.sum(F.col("whole") * F.col("m")).alias("got"))
    lacks = sources.join(got, "src").select("src", "source_size", "target", (F.round("target").cast("long") - F.col("got")).alias("lack"))
    filled = _with_sources(copied, hold(lacks), spec)
    room = F.when(F.col("lack") >= 0, F.col("size") * spec.max_copies - F.col("whole")).otherwise(F.col("whole")) * F.col("m")
    filled = running(hold(filled.withColumn("room", room)), ["src"], ["bucket"], ["mark", "id", "version"], "room", "before")
    moved = F.least(F.greatest(F.abs("lack") - F.col("before"), F.lit(0)), F.col("room"))
    taken = F.col("whole") + F.signum(F.col("lack").cast("double")).cast("long") * F.floor(moved / F.col("m")).cast("long")
    return filled.select("id", "src", "version", "size", "m", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken, copies (whole ones)."""
    mixed = mix_units(hold(units_of(docs, id_column, text_column, source_column)), spec)
    rows = mixed.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", copies.alias("copies"))


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec(), *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", added: tuple[str, str] = ("_taken", "_copies")) -> DataFrame:
    """The rows of docs that the mix takes words of, with words taken and whole copies as the added columns."""
    mixed = mix_units(hold(units_of(docs, id_column, text_column, source_column)), spec).where(F.col("taken") > 0)
    chosen = mixed.select("id", "src", "version", "taken", F.floor(F.col("taken") / F.col("size")).cast("long").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("rid"), _src(source_column).alias("rs"), F.xxhash64(F.col(text_column)).alias("rv"))
    joined = rows.join(chosen, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rs") == F.col("src")) & (F.col("rv") == F.col("version")))
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("taken").alias(added[0]), F.col("copies").alias(added[1]))
