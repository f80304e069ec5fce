"""Type inference: one aggregate over the value dictionary, then a cascade of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.functions import tokens as t
from tableproof.operators.ledger import change
from tableproof.plans.cells import columns_of, dictionary

#: Limits of the category type, types that can be cast.
MAX_CATEGORIES = 50
MAX_CATEGORY_SHARE = 0.5
CASTABLE = ("bool", "int64", "float64", "category")
SAMPLES = 5
#: Decimal and thousands signs a column's numbers may be read by.
LOCALES = ((None, None), (".", None), (".", ","), (",", None), (",", "."))


def tokens_seen(values: DataFrame) -> DataFrame:
    """column, token, first_row: a row for each distinct token."""
    return values.where(~F.col("missing")).groupBy("column", "token").agg(F.min("first_row").alias("first_row"))


def first_values(values: DataFrame, k: int = SAMPLES) -> DataFrame:
    """column, rank, token: each column's first k distinct tokens in row order."""
    ranked = tokens_seen(values).withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("first_row")))
    return ranked.where(F.col("rank") <= k).select("column", "rank", "token")


def shares(values: DataFrame) -> DataFrame:
    """A row a column: counts and marks that the cascade looks at, weighted by how often values are in the sample."""
    w, token = F.col("sampled"), F.col("token")
    seen = ~F.col("missing") & (w > 0)
    digits = F.col("_digits")  # numbers and dates have one: words are passed by a cheap look
    count = lambda test: F.coalesce(F.sum(F.when(seen & test, w)), F.lit(0))
    some = lambda test: F.coalesce(F.bool_or(seen & test), F.lit(False))
    floats = [count(digits & t.clean_number(token, thousands, decimal).rlike(t.FLOAT)).alias(f"float_{i}") for i, (decimal, thousands) in enumerate(LOCALES)]
    distinct = tokens_seen(values).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    counted = values.withColumn("_digits", token.rlike(r"\p{Nd}")).groupBy("column").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(~F.col("missing"), F.col("n")).otherwise(0)).alias("present"),
        F.sum("sampled").alias("sampled"),
        count(t.bool_word(token)).alias("bools"),
        count(digits & token.rlike(t.INTEGER)).alias("ints"),
        some(digits & token.rlike(t.LEADING_ZERO)).alias("leading"),
        some(token.rlike("[.,]")).alias("separated"),
        some(token.contains(".")).alias("dots"),
        some(token.contains(",")).alias("commas"),
        some(digits & token.rlike(r"(?U)\.\d{1,2}$")).alias("decimal_dot"),
        some(digits & token.rlike(r"(?U),\d{1,2}$")).alias("decimal_comma"),
        some(t.without_currency(token) != token).alias("stripped"),
        count(digits & t.without_currency(token).rlike(t.LOOSE_NUMBER)).alias("loose"),
        count(digits & token.rlike(t.DATEISH)).alias("dates"),
        *floats,
    )
    return counted.join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def cascade(counted: DataFrame, threshold: float) -> DataFrame:
    """column, dtype, confidence, null_like_rate, distinct, flags, thousands, decimal of each column of shares()."""
    n = F.col("sampled")
    share = lambda name: F.col(name) / n
    ambiguous = (F.col("decimal_dot") & F.col("decimal_comma")) | (F.col("separated") & ~F.col("decimal_dot") & ~F.col("decimal_comma"))
    decimal = F.when(~ambiguous & F.col("decimal_dot"), ".").when(~ambiguous & F.col("decimal_comma"), ",")
    thousands = F.when((decimal == ".") & F.col("commas"), ",").when((decimal == ",") & F.col("dots"), ".")
    rate: Column = F.lit(0.0)
    for i, (d, th) in enumerate(LOCALES):
        rate = F.when(decimal.eqNullSafe(F.lit(d)) & thousands.eqNullSafe(F.lit(th)), share(f"float_{i}")).otherwise(rate)
    few = (F.col("distinct") <= MAX_CATEGORIES) & (F.col("distinct") / n <= MAX_CATEGORY_SHARE)
    pick = lambda dtype, confidence, flag=None, numeric=False: F.struct(F.lit(dtype).alias("dtype"), confidence.cast("double").alias("confidence"), (F.array(F.lit(flag)) if isinstance(flag, str) else flag if flag is not None else F.array().cast("array<string>")).alias("flags"), F.lit(numeric).alias("numeric"))
    stripped = F.when(F.col("stripped"), F.array(F.lit("currency_or_spaces_stripped"))).otherwise(F.array().cast("array<string>"))
    chosen = (
        F.when(n == 0, pick("string", F.lit(0.0), "all_null"))
        .when(share("bools") >= threshold, pick("bool", share("bools")))
        .when((share("ints") >= threshold) & F.col("leading"), pick("string", share("ints"), "leading_zeros_kept_as_string"))
        .when(share("ints") >= threshold, pick("int64", share("ints")))
        .when(ambiguous, pick("string", share("loose"), "numeric_locale_ambiguous"))
        .when(rate >= threshold, pick("float64", rate, stripped, True))
        .when(share("dates") >= threshold, pick("datetime", share("dates")))
        .when(few, pick("category", F.lit(1.0), "low_cardinality"))
        .otherwise(pick("string", F.lit(1.0)))
    )
    sampled = F.when(F.col("present") > n, F.array(F.lit("sampled"))).otherwise(F.array().cast("array<string>"))
    out = counted.withColumn("_", chosen)
    return out.select(
        "column",
        F.col("_.dtype").alias("dtype"),
        F.col("_.confidence").alias("confidence"),
        F.when(F.col("total") > 0, F.col("missing") / F.col("total")).otherwise(0.0).alias("null_like_rate"),
        F.col("distinct").cast("long").alias("distinct"),
        F.concat(sampled, F.col("_.flags")).alias("flags"),
        F.when(F.col("_.numeric"), thousands).alias("thousands"),
        F.when(F.col("_.numeric"), decimal).alias("decimal"),
    )


def infer(df: DataFrame, *, threshold: float = 0.95, max_sample: int | None = 50_000, columns: list[str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """The profile of each column: position, what cascade() gives, and the first samples as an array."""
    names = columns_of(df) if columns is None else columns
    values = dictionary(df, names, max_sample) if values is None else values
    samples = first_values(values).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("samples"))
    spark = df.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "column string, position int")
    found = order.join(cascade(shares(values), threshold), "column", "left").join(samples, "column", "left")
    nothing = F.array().cast("array<string>")
    return found.select(
        "column",
        "position",
        F.coalesce("dtype", F.lit("string")).alias("dtype"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("null_like_rate", F.lit(0.0)).alias("null_like_rate"),
        F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
        F.coalesce("samples", nothing).alias("samples"),
        F.coalesce("flags", F.array(F.lit("all_null"))).alias("flags"),
        "thousands",
        "decimal",
    )


def projection(profiles: DataFrame) -> DataFrame:
    """The profiles as a table to read: by name, shares with three digits, flags joined or "-"."""
    flags = F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("-")
    shown = profiles.select("column", "dtype", F.round("confidence", 3).alias("confidence"), F.round("null_like_rate", 3).alias("missing"), "distinct", flags.alias("flags"))
    return shown.orderBy("column")


def cast_changes(profiles: DataFrame) -> DataFrame:
    """A type_cast change for each column of a type that can be cast."""
    chosen = profiles.where(F.col("dtype").isin(*CASTABLE))
    return change(chosen, kind="type_cast", column=F.col("column"), row=None, before=F.lit("string"), after=F.col("dtype"), rule=F.concat(F.lit("cast:"), F.col("dtype")), confidence=F.col("confidence"))


def override(profiles: DataFrame, ledger: DataFrame, column: str, dtype: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and ledger with one column's type set by hand; its cast is proposed anew, nothing is detected again."""
    if profiles.where(F.col("column") == column).isEmpty():
        raise ValueError(f"there is no column {column!r}")
    known = ("string", "int64", "float64", "bool", "category", "datetime")
    if dtype not in known:
        raise ValueError(f"type is one of {known}, not {dtype!r}")
    changed = profiles.withColumn("dtype", F.when(F.col("column") == column, F.lit(dtype)).otherwise(F.col("dtype")))
    others = ledger.where(~((F.col("kind") == "type_cast") & (F.col("column") == column)))
    sure = changed.where(F.col("column") == column).withColumn("confidence", F.lit(1.0))
    return changed, others.unionByName(cast_changes(sure))
