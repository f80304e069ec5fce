"""The whole chain: text table to profiles, ledger, warnings and gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.operators import coherence, dates, duplicates, inference, texts
from tableproof.operators.ledger import resolve
from tableproof.plans.cells import columns_of
from tableproof.plans.held import hold


@dataclass(frozen=True)
class Options:
    threshold: float = 0.95
    case: str = "keep"
    cat_threshold: float = 90
    unify_nulls: bool = True
    dup_keys: tuple[str, ...] = ()
    dup_threshold: float = 85
    max_bucket: int | None = 1500
    max_sample: int | None = 50_000
    allow_epoch_excel: bool = False
    fail_rate: float = 0.05
    ambig_blocks: bool = True
    today: date | None = None


@dataclass
class Analysis:
    df: DataFrame
    profiles: DataFrame
    ledger: DataFrame
    warnings: DataFrame
    gates: DataFrame
    options: Options = field(default_factory=Options)

    @property
    def blocked(self) -> bool:
        return bool(self.gates.agg(F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("b")).first()["b"])

    def profile_rows(self) -> list:
        """The profiles on the driver: a row a column."""
        return self.profiles.orderBy("position").collect()


def analyse(df: DataFrame, options: Options = Options()) -> Analysis:
    """Profiles, ledger and warnings of a table of text columns with row_index.

    The types decide which expressions the detectors are made of, so the profiles (a row a column) are collected once.
    Detectors read df itself, never each other's proposals. Ledger and warnings are held: reports and appliers read them
    again and again.
    """
    spark = df.sparkSession
    found = inference.infer(df, threshold=options.threshold, max_sample=options.max_sample)
    rows = found.orderBy("position").collect()
    profiles = spark.createDataFrame(rows, found.schema)
    of = lambda *kinds: [r["column"] for r in rows if r["dtype"] in kinds]
    ledger = inference.cast_changes(profiles)
    moved, notes, gates = dates.normalize_dates(df, of("datetime"), allow_epoch_excel=options.allow_epoch_excel, fail_rate=options.fail_rate, ambig_blocks=options.ambig_blocks)
    worded, merged = texts.normalize_text(df, of("string"), of("category"), case=options.case, cat_threshold=options.cat_threshold)
    ledger = ledger.unionByName(moved).unionByName(worded)
    more = {} if options.today is None else {"today": options.today}
    fixed, coherent = coherence.run_checks(coherence.context(df, rows, occupied=ledger, unify_nulls=options.unify_nulls, **more))
    ledger, notes = ledger.unionByName(fixed), notes.unionByName(merged).unionByName(coherent)
    if options.dup_keys:
        doubled, told = duplicates.find_duplicates(df, list(options.dup_keys), threshold=options.dup_threshold, max_bucket=options.max_bucket)
        ledger, notes = ledger.unionByName(doubled), notes.unionByName(told)
    final, conflicts = resolve(hold(ledger))
    return Analysis(df, profiles, hold(final), hold(notes.unionByName(conflicts)), gates, options)


def text_table(df: DataFrame, index: str | None = None) -> DataFrame:
    """A table with every column as text; index names the column of row numbers, where it has one."""
    names = [c for c in columns_of(df) if c != index]
    row = F.col(index).cast("long").alias("row_index") if index else F.col("row_index")
    return df.select(row, *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
