"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage reads all its predecessor kept, written as Parquet, and all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsonde.llm import common, decontaminate, line_runs, ngram_join, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the adaptive thresholds reject go."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines found in many documents; n_chars follows."""
    out = line_runs.dedup_lines(docs)
    text = F.col("kept_text")
    return out.withColumns({"text": text, "n_chars": F.char_length(text).cast("bigint")}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs, n=5, per_cent=80, is_scan=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover too much go; others are left as they are."""
    items = common.table(spark, sf_dir, "benchmark")
    return decontaminate.judge(docs, items).where(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Packing and tokenising are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each settled in the shared folder before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
