"""From raw documents to token ids: five stages, each written and read again before the next.

Every stage but the last returns the columns of documents. A stage works on all rows that the one
before it kept: quality rules reject rows, near-duplicates leave one row a class, repeated passages
and benchmark passages go from the texts (a mostly-benchmark document goes whole), and what is left
is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankflow.llm import decontaminate, near, pieces, quality, suffixes
from rankflow.llm.common import table
from rankflow.session import store


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that pass the base rules and the fences of their language and source."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the least doc_id."""
    return near.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the bytes that repeat a document of smaller doc_id."""
    return suffixes.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of the benchmark go from the texts; a document that is mostly benchmark goes whole."""
    return decontaminate.remove_contamination(docs, table(spark, folder, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens, round_trip, parity."""
    return pieces.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL has no tokenizer and no signatures; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
