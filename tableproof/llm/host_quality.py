"""Quality rules of documents, and what they say about the hosts that documents come from.

Every document is measured by array and string functions inside its own row. Failures of the soft rules are then
counted by host; the counts of all hosts give a beta prior (method of moments), each host's failure rate is shrunk
towards it, and the host's verdict (trusted, suspect, blocked) goes back to its documents by a join. How many soft
failures a document may have depends on its host's verdict.

Nulls: a null text has no words; a null host is a host of its own. Repeated rows and null ids are each judged; an empty table
gives an empty result. Columns of the input other than those named are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import WS, hold, join_hot, let, words


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_mean_chars: float = 2.0
    max_mean_chars: float = 20.0
    max_symbols_a_word: float = 0.2
    max_dup_lines: float = 0.3
    soft_repeat_percent: int = 30
    #: A host with this shrunken share of failing documents or more is suspect, or blocked.
    suspect_rate: float = 0.5
    blocked_rate: float = 0.9
    #: A document goes with so many soft failures, by its host's verdict.
    trusted_fails: int = 2
    suspect_fails: int = 1
    blocked_fails: int = 0
    #: Up to so many hosts' verdicts (under 100 bytes each) are broadcast; more are joined over salted keys.
    broadcast_hosts: int = 100_000


#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """How many words stand in windows of so many words that the text has twice or more.

    Windows are compared by 64-bit hash: sorted with their places, equal ones stand side by side.
    """

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        at = lambda i: F.get(ordered, i)["h"]
        twin = F.transform(
            ordered,
            lambda x, i: F.when(((i > 0) & (at(i - 1) == x["h"])) | ((i < last) & (at(i + 1) == x["h"])), x["i"]),
        )
        places = F.filter(twin, lambda p: p.isNotNull())
        spread = F.flatten(F.transform(places, lambda p: F.sequence(p, p + (width - 1))))
        return F.size(F.array_distinct(spread))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        return F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))))

    return F.when(F.size(tokens) <= width, F.lit(0)).otherwise(let(windows(tokens), covered)).cast("long")


def measures(text: Column) -> Column:
    """Struct of a text's counts; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column, parts: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, WS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(parts) - F.size(F.array_distinct(parts))).cast("long").alias("n_dup_lines"),
            F.size(parts).cast("long").alias("n_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda w: let(lines, lambda parts: of(w, parts)))


def soft_failures(m: Column, rules: QualityRules) -> Column:
    """How many soft rules the measures break."""
    n = F.greatest(m["n_words"], F.lit(1))
    mean = m["word_chars"] / n
    broken = [
        (mean < rules.min_mean_chars) | (mean > rules.max_mean_chars),
        m["n_symbols"] / n > rules.max_symbols_a_word,
        m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)) > rules.max_dup_lines,
        100 * m["n_repeat_words"] > rules.soft_repeat_percent * m["n_words"],
    ]
    return sum((b.cast("int") for b in broken), F.lit(0))


def host_verdicts(judged: DataFrame, rules: QualityRules) -> DataFrame:
    """host, n_docs, n_failed, rate, verdict: the shrunken failure rate of every host.

    The prior's mean and variance are those of the hosts' rates, each host weighing the same, less the binomial
    variance the rates have anyway; with no variance left to explain the prior is as heavy as all documents.
    """
    by_host = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    moments = by_host.agg(
        F.avg(F.col("n_failed") / F.col("n_docs")).alias("mean"),
        F.coalesce(F.var_pop(F.col("n_failed") / F.col("n_docs")), F.lit(0.0)).alias("spread"),
        F.avg(1.0 / F.col("n_docs")).alias("inverse"),
        F.sum("n_docs").alias("all_docs"),
    )
    m, binomial = F.col("mean"), F.col("mean") * (1 - F.col("mean")) * F.col("inverse")
    left = F.col("spread") - binomial
    strength = F.when((m > 0) & (m < 1) & (left > 0), F.least(F.greatest(m * (1 - m) / left - 1, F.lit(0.0)), F.col("all_docs").cast("double"))).otherwise(F.col("all_docs").cast("double"))
    prior = moments.select(m.alias("prior_mean"), strength.alias("prior_n"))
    rate = (F.col("n_failed") + F.col("prior_mean") * F.col("prior_n")) / (F.col("n_docs") + F.col("prior_n"))
    verdict = F.when(F.col("rate") >= rules.blocked_rate, "blocked").when(F.col("rate") >= rules.suspect_rate, "suspect").otherwise("trusted")
    # the prior is a single row by construction
    return by_host.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate")).withColumn("verdict", verdict)


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), *, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """A row for each row of docs: id, host, the measures, base_failed, soft, host_rate, host_verdict, kept."""
    m = F.col("m")
    base = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    measured = docs.select(F.col(id_column).alias("doc_id"), F.col(host_column).cast("string").alias("host"), measures(F.col(text_column)).alias("m"))
    judged = hold(measured.select("doc_id", "host", "m.*", base.alias("base_failed"), soft_failures(m, rules).alias("soft")))
    verdicts = host_verdicts(judged.select("host", (F.col("base_failed") | (F.col("soft") > 0)).alias("failed")), rules)
    allowed = F.when(F.col("host_verdict") == "blocked", rules.blocked_fails).when(F.col("host_verdict") == "suspect", rules.suspect_fails).otherwise(rules.trusted_fails)
    # a null host is a host: as a field of a struct it is a key like any other
    held = hold(verdicts.select(F.struct("host").alias("key"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict")))
    joined = join_hot(judged.withColumn("key", F.struct("host")), held, "key", ["doc_id"], rules.broadcast_hosts)
    return joined.select(*judged.columns, "host_rate", "host_verdict", (~F.col("base_failed") & (F.col("soft") < allowed)).alias("kept"))
