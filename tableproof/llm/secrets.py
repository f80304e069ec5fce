"""Secret scan: three base patterns, and a battery of randomness tests for whatever else looks like a key.

Candidates are long runs of key characters that hold a letter and a digit. Each gets an encoding (hexadecimal, base32,
base64) and, over that alphabet, a chi-squared test of uniformity, a runs test about the median and a lag-one serial
correlation. Fisher's method joins the three to one p-value of being random. How well natural strings of the same
length and alphabet could look as uniform by chance is a second p-value; per length class the Benjamini-Hochberg
procedure over all candidates of the corpus picks its threshold, from a histogram of p-values of bounded size. A
secret is what the battery doesn't reject as random and the procedure rejects as natural.

Everything is DataFrame functions; positions are code points, end exclusive. Nulls: a null text counts as empty.
Repeated rows and null ids are each scanned; an empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import hold, let

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Maximal runs of key characters with a digit inside.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: k * sum(p^2) - 1 of natural strings over each alphabet: how fast their chi-squared grows with length. Decimal digits
#: in hexadecimal: 16 / 10 - 1; letters at the frequencies of English in base32: 32 * 0.0655 - 1, less for digits; words
#: of such letters with a third of digits, capitals and joining characters in base64: 64 * (0.667 ** 2 * 0.0655 + 0.015) - 1.
NATURAL = {"hex": 0.6, "base32": 1.0, "base64": 1.8}


@dataclass(frozen=True)
class SecretRules:
    #: The battery rejects randomness below this.
    random_level: float = 1e-3
    #: False-discovery rate among what is called secret, for each length class.
    fdr: float = 0.01
    #: P-values are binned by so many bins to a power of ten, up to bins in all.
    bins_a_decade: int = 8
    bins: int = 256


def occurrences(text: Column, pattern: str, quick: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Array of struct(start, end, kind, value) of the pattern's matches, left to right without overlap.

    Matches whose group has under least characters are dropped. Places come from the gaps that split() leaves between
    matches. Texts without a match of the cheap pattern quick aren't scanned.
    """
    shape = "array<struct<start:int,end:int,kind:string,value:string>>"
    empty = F.array().cast(shape)

    def walk(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["match"])
            here = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
            return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(parts, start, step, lambda acc: acc["found"])

    matches, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.arrays_zip(matches.alias("match"), values.alias("value")), F.split(text, pattern), lambda m, gap: F.struct(gap.alias("gap"), m["match"].alias("match"), m["value"].alias("value")))
    parts = F.filter(parts, lambda x: x["match"].isNotNull())
    return F.when(text.rlike(quick), walk(parts)).otherwise(empty)


def base_spans(text: Column) -> list[Column]:
    return [
        occurrences(text, ASSIGN, r"(?i:pass|secret|token|key)", "assign", group=1, least=8),
        occurrences(text, ACCESS, "AKIA[A-Z0-9]", "access", least=16),
        occurrences(text, HEX, "[0-9a-f]{32}", "hex"),
    ]


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a fixed polynomial good to seven digits; z is read several times, so it should be a bound value."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) * 0.3989422804014327
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def encoding_of(value: Column) -> Column:
    return F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(value.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")


def _sums(codes: Column, half: Column) -> Column:
    """One pass over the codes: their sum, sum of squares, sum of products of neighbours, how many reach half, changes."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("total"), zero.alias("squares"), zero.alias("products"), zero.alias("high"), zero.alias("changes"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        changed = (acc["last"] >= half) != (x >= half)
        return F.struct(
            (acc["total"] + x).alias("total"),
            (acc["squares"] + x * x).alias("squares"),
            (acc["products"] + F.coalesce(acc["last"] * x, zero)).alias("products"),
            (acc["high"] + (x >= half).cast("double")).alias("high"),
            (acc["changes"] + F.coalesce(changed.cast("double"), zero)).alias("changes"),
            x.alias("last"),
        )

    return F.aggregate(codes, start, step)


def battery(value: Column) -> Column:
    """struct(code, n, p_random, p_natural) of one candidate; the work grows in proportion to its length."""
    code = encoding_of(value)
    plain = F.rtrim(F.when(code == "hex", F.lower(value)).otherwise(F.translate(value, "-_", "+/")), F.lit("="))
    by_code = lambda s, of: F.when(s["code"] == "hex", of["hex"]).when(s["code"] == "base32", of["base32"]).otherwise(of["base64"])
    sizes = {name: float(len(alphabet)) for name, alphabet in ALPHABETS.items()}

    def counted(s: Column) -> Column:
        alphabet = by_code(s, ALPHABETS)
        chars = F.split(s["plain"], "")
        often = F.transform(F.array_distinct(chars), lambda c: (F.length(s["plain"]) - F.length(F.replace(s["plain"], c, F.lit("")))).cast("double"))
        codes = F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(codes, lambda x: F.struct(s["code"].alias("code"), by_code(s, sizes).alias("k"), F.size(x).cast("double").alias("n"), x[0].alias("first"), F.aggregate(often, F.lit(0.0), lambda acc, c: acc + c * c).alias("repeats"), _sums(x, by_code(s, sizes) / 2).alias("sums")))

    def scored(t: Column) -> Column:
        n, k, sums = t["n"], t["k"], t["sums"]
        chi, mean = t["repeats"] * k / n - n, k - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / mean, F.lit(1 / 3)) - (1 - 2 / (9 * mean))) / F.sqrt(2 / (9 * mean))
        high = sums["high"]
        runs_mean = 2 * high * (n - high) / n + 1
        runs_var = F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), F.lit(1e-9))
        z_runs = F.abs(sums["changes"] + 1 - runs_mean) / F.sqrt(runs_var)
        middle = sums["total"] / n
        spread = F.greatest(sums["squares"] - n * middle * middle, F.lit(1e-9))
        beside = sums["products"] - middle * (2 * sums["total"] - t["first"] - sums["last"]) + (n - 1) * middle * middle
        z_serial = F.abs(beside / spread + 1 / n) * F.sqrt(n)
        growth = by_code(t, NATURAL)
        z_natural = (chi - (mean + n * growth)) / F.sqrt(2 * mean + 4 * n * growth)
        return F.transform(F.array(z_chi, z_runs, z_serial, z_natural), normal_tail)

    def judged(t: Column, p: Column) -> Column:
        half = -(F.log(p[0]) + F.log(F.least(2 * p[1], F.lit(1.0))) + F.log(F.least(2 * p[2], F.lit(1.0))))
        fisher = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        return F.struct(t["code"].alias("code"), t["n"].cast("int").alias("n"), fisher.alias("p_random"), F.greatest(1 - p[3], F.lit(1e-300)).alias("p_natural"))

    return let(F.struct(code.alias("code"), plain.alias("plain")), lambda s: let(counted(s), lambda t: let(scored(t), lambda p: judged(t, p))))


def length_class(n: Column) -> Column:
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).when(n < 96, 3).otherwise(4)


def thresholds(candidates: DataFrame, rules: SecretRules) -> DataFrame:
    """One row: map of length class to the highest bin that counts as found. candidates: cls, bin.

    The bin b holds p-values of about 10 ** -(b / bins_a_decade); at most 5 * bins rows are ordered.
    """
    from pyspark.sql import Window

    bins = candidates.groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    steps = bins.withColumn("found", F.sum("n").over(down)).withColumn("tested", F.sum("n").over(Window.partitionBy("cls")))
    good = steps.where(F.pow(F.lit(10.0), -F.col("bin") / rules.bins_a_decade) * F.col("tested") <= rules.fdr * F.col("found"))
    lowest = good.groupBy("cls").agg(F.min("bin").alias("bin"))
    return lowest.agg(F.map_from_entries(F.collect_list(F.struct("cls", "bin"))).alias("limits"))


def joined_spans(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind in the order of kinds."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: SecretRules = SecretRules(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base (spans of the base patterns), added (spans of the method) for every row of docs."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    found = source.select("doc_id", F.concat(*base_spans(F.col("text"))).alias("base"), occurrences(F.col("text"), CANDIDATE, "[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]", "random").alias("maybe"))

    def free(c: Column) -> Column:
        overlaps = F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return ~overlaps & c["value"].rlike("[A-Za-z]")

    def tested(c: Column) -> Column:
        def packed(b: Column) -> Column:
            bin_ = F.least(F.floor(-F.log10(b["p_natural"]) * rules.bins_a_decade), F.lit(rules.bins - 1)).cast("int")
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value"), b["code"].alias("code"), b["p_random"].alias("p_random"), length_class(b["n"]).alias("cls"), bin_.alias("bin"))

        return let(battery(c["value"]), packed)

    found = hold(found.withColumn("maybe", F.transform(F.filter("maybe", free), tested)))
    limits = thresholds(found.select(F.explode("maybe").alias("c")).select("c.cls", "c.bin"), rules)  # one row of a bounded map
    secret = lambda c: (c["p_random"] >= rules.random_level) & F.coalesce(c["bin"] >= F.col("limits")[c["cls"]], F.lit(False))
    return found.join(F.broadcast(limits)).select("doc_id", "base", F.filter("maybe", secret).alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of scan()'s rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(joined_spans(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined_spans(F.concat(plain(F.col("base")), plain(F.col("added"))), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
