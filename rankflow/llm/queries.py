"""Registered corpus queries and, where SQL can say the same, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankflow.llm import chat, decontaminate, html, near, pieces, pii, quality, resample, suffixes, toxicity, url_filter, variants, warc
from rankflow.llm.common import table


URL_RULES: list[url_filter.Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES)


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids (as a hash), checked against the library's own and decoded again."""
    return pieces.digest(pieces.encode(table(spark, folder, "documents").select("doc_id", "text")))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{control}'), (-7L, 1L, 'assistant', '{control}')")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return chat.digest(chat.read_back(chat.render(chat.fold(chat.log_of(rows)))))


def op5_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest(suffixes.find_repeats(table(spark, folder, "documents").select("doc_id", "text")))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the least doc_id of its class of near-duplicates."""
    return near.digest(near.classes(table(spark, folder, "documents")))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.digest(found)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_echo_words",
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.isnull("error").alias("valid")
    )


def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, a letter taken from about one run in 97, with their forms and roots."""
    return variants.group(variants.observed(table(spark, folder, "documents"), noise=97))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    ranked = resample.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_format": op4_chat_format,
    "op5_html_extract": op5_html_extract,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_variants": op11_variants,
    "op12_pii": op12_pii,
    "op13_resample": op13_resample,
}
SQL: dict[str, str] = {
    "op1_quality_rules": quality.SQL, "op4_chat_format": chat.SQL, "op8_decontaminate": decontaminate.SQL, "op10_warc": warc.SQL,
    "op11_variants": variants.SQL, "op13_resample": resample.SQL,
}
