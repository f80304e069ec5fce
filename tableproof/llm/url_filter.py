"""Weighted URL vocabulary: one Aho-Corasick automaton finds strict and soft terms, and list rules override it.

A url is rejected on one strict term or on several distinct soft ones. A term counts only where it stands between
boundaries: no letter or digit before or after it.

Nulls and urls without "://" have an empty host and path, fit no rule and are allowed. Repeated rows and null ids are
each judged; an empty table gives an empty result. Other columns of the input are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import ship

ship(__name__)

#: The vocabulary. Strict terms reject alone.
STRICT = ("porn", "xxx", "casino", "viagra", "cialis", "spam", "cheap-pills", "free-bets", "escort", "warez", "phishing", "adult-x", "sexcam", "jackpot")
#: Soft terms, with the weight each distinct one adds.
SOFT = {"adult": 1.0, "bet": 1.0, "bets": 1.0, "poker": 1.0, "pills": 1.0, "pill": 1.0, "cheap": 1.0, "free": 0.5, "win": 0.5, "ads": 1.0, "track": 0.5, "click": 0.5, "promo": 0.5, "dating": 1.0, "loan": 1.0, "loans": 1.0, "crack": 1.0, "torrent": 1.0, "farm": 0.5, "sex": 1.0, "nude": 1.0, "lottery": 1.0, "slots": 1.0, "bonus": 0.5}


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())
    #: Soft weight of distinct terms from which a url is rejected.
    soft_limit: float = 1.5
    #: How many distinct soft terms that takes at least.
    soft_terms: int = 2


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule], of: str) -> Column:
    """The name or verdict of the longest rule that fits host and path; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first: it is wrapped last
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, of))).otherwise(found)
    return found


_BUILT: dict = {}


def _automaton(vocabulary: Vocabulary):
    """The vocabulary's automaton, built once a process."""
    import ahocorasick

    if vocabulary in _BUILT:
        return _BUILT[vocabulary]
    found = _BUILT[vocabulary] = ahocorasick.Automaton()
    for term, weight in vocabulary.soft:
        found.add_word(term, (term, weight))
    for term in vocabulary.strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def terms(url: str | None, vocabulary: Vocabulary = Vocabulary()) -> tuple[list[str], list[str], float]:
    """Distinct strict terms, distinct soft terms and the soft ones' weight in a url."""
    if not url or not (vocabulary.strict or vocabulary.soft):
        return [], [], 0.0
    text, strict, soft = url.lower(), set(), {}
    for end, (term, weight) in _automaton(vocabulary).iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return sorted(strict), sorted(soft), float(sum(soft.values()))


def judge_urls(urls: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules: Sequence[UrlRule] = RULES, *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, url, host, path, strict and soft terms, weight, rule, verdict (allow or block) for every row."""

    @F.pandas_udf("strict array<string>, soft array<string>, weight double, method string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch:
                strict, soft, weight = terms(url, vocabulary)
                bad = strict or (len(soft) >= vocabulary.soft_terms and weight >= vocabulary.soft_limit)
                rows.append((strict, soft, weight, "block" if bad else "allow"))
            yield pd.DataFrame(rows, columns=["strict", "soft", "weight", "method"])

    base = urls.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    scored = base.withColumn("s", score("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = (rule_of(F.col("host"), F.col("path"), rules, of) for of in ("name", "verdict"))
    return scored.select("page_id", "url", "host", "path", F.col("s.strict").alias("strict"), F.col("s.soft").alias("soft"), F.col("s.weight").alias("weight"), rule.alias("rule"), F.coalesce(verdict, F.col("s.method")).alias("verdict"))
