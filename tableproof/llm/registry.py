"""The operators' queries over the standard tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.llm import oracles
from tableproof.llm.common import benchmark, documents, pages
from tableproof.llm.crf_langid import held_out, identify
from tableproof.llm.decontaminate import judge as judge_leaks
from tableproof.llm.host_quality import judge
from tableproof.llm.html_template import extract
from tableproof.llm.line_spread import remove_boilerplate
from tableproof.llm.mixing import mix
from tableproof.llm.near_dedup import NearDupRules, near_duplicates
from tableproof.llm.pii_segments import find as find_pii
from tableproof.llm.secrets import digest as secret_digest
from tableproof.llm.secrets import scan
from tableproof.llm.url_filter import judge_urls


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op4_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op5_segment_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")
    return judge(documents(spark, sf_dir)).select(*columns)


def op7_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir)).select("page_id", "url", "text", "n_chars")


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(documents(spark, sf_dir)).select("doc_id", "text", F.col("_n_removed").alias("n_removed"))


def op9_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan(documents(spark, sf_dir)))


def op10_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), NearDupRules(width=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_templates": op2_templates,
    "op3_url_vocabulary": op3_url_vocabulary,
    "op4_chain_field": op4_chain_field,
    "op5_segment_field": op5_segment_field,
    "op6_host_rules": op6_host_rules,
    "op7_page_templates": op7_page_templates,
    "op8_line_spread": op8_line_spread,
    "op9_secret_battery": op9_secret_battery,
    "op10_min_max": op10_min_max,
}
ORACLES: dict[str, str] = {
    "op3_url_vocabulary": oracles.url_vocabulary(),
    "op6_host_rules": oracles.HOST_RULES,
    "op8_line_spread": oracles.LINE_SPREAD,
    "op10_min_max": oracles.NEAR_COPIES,
}
