"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result as Parquet to the shared folder and reads it again for the
next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordscan.llm.common import lean, settle, table
from recordscan.llm.decontaminate import decontaminate
from recordscan.llm.langid import keep_identified
from recordscan.llm.linededup import replace_lines
from recordscan.llm.packing import pack_documents
from recordscan.llm.simhash import keep_representatives


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    lean(spark)
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that nothing is left of goes."""
    return replace_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; contaminated ones go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, with its token ids."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Language profiles, fingerprints, word windows and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}", drop=docs)
    return docs
