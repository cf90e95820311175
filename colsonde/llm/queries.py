"""The registered query of each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colsonde.llm import chat_format, decontaminate, line_runs, ngram_join, packing, quality_model, quality_rules, secret_links, span_dedup, warc
from colsonde.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.digest(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(table(spark, sf_dir, "conversations"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_span_dedup,
        op3_chat_format,
        op4_ngram_join,
        op5_line_dedup,
        op6_quality_rules,
        op7_secret_links,
        op8_packing,
        op9_decontaminate,
        op10_warc,
    )
}

#: Queries without an entry are not expressible in SQL, or too slow in it on whole tables; they
#: are tested against brute force, exact round trips or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op2_span_dedup": span_dedup.SQL,
    "op3_chat_format": chat_format.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op5_line_dedup": line_runs.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op7_secret_links": secret_links.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_warc": warc.SQL,
}
