"""Quality rules whose thresholds follow the corpus.

Fixed base rules reject texts of fewer than 20 words and texts of which over 30 % of the
words stand in an 8-word window that occurs twice. The other rules compare five rates of a
text, in thousandths, with fences of its language and source. The rates of all rows that pass
the base rules go into mergeable quantile sketches: counts over log-linear buckets of integers
(exact below 64, then 32 buckets an octave, so a quantile is at most 1/32 too low). Sketches
of a group merge by adding counts, so Spark combines them map-side and a hot source costs
nothing; a group of fewer than `MIN_GROUP` rows takes the merged sketch of its language, and a
language of so few the sketch of all rows. A fence lies `REACH` interquartile ranges beyond the
quartile, an interquartile range counting at least the rate's `SLACK`. Verdicts come from a
join with the fences on language and source, salted against hot sources.

Null texts have no words and fail the base rules. Null languages and sources count as ''.
Repeated rows are judged each; null doc_ids stay. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankflow.llm.common import by_batch, fresh, salted, stored

MIN_WORDS, MOST_REPEATED_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
MIN_GROUP = 50
REACH = 3
#: Least interquartile range of a rate, in thousandths, and whether low values are rejected too.
SLACK = {
    "symbol_rate": (20, False), "word_length": (1000, True), "dup_line_rate": (200, False),
    "repeat_rate": (100, False), "echo_rate": (50, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words"]


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words in windows of eight that occur twice or more; ranks of 1, 2, 4 and 8 words, each from the last."""
    n = len(ids)
    if n <= window:
        return 0
    ranks, width = ids.astype(np.int64), 1
    while width < window:
        ranks = ranks[:-width] * np.int64(n + 1) + ranks[width:]
        _, ranks, counts = np.unique(ranks, return_inverse=True, return_counts=True)
        if counts.max() < 2:  # nothing this short repeats, so nothing longer does
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(n + 1, dtype=np.int32)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    seen = [line for line in raw.split(b"\n") if line.strip()]
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    return (
        len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(seen) - len(set(seen)),
        repeated_words(ids), len(seen), int((ids[1:] == ids[:-1]).sum()),
    )


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, lang, source, the counts, rates in thousandths and base_failed of every row."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("row_key"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text",
    )
    keys = ["doc_id", "row_key", "lang", "source"]
    schema = pa.schema([*((k, pa.int64()) for k in keys[:2]), *((k, pa.string()) for k in keys[2:]), *((c, pa.int64()) for c in COUNTS)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = np.array([counts_of(t) for t in batch.column("text").to_pylist()], dtype=np.int64).T
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, counted)], schema=schema)

    told = "doc_id long, row_key long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    rate = lambda top, under: F.expr(f"1000 * {top} div greatest({under}, 1)")
    return by_batch(rows, work, told).withColumns(
        {
            "symbol_rate": rate("n_symbols", "n_words"), "word_length": rate("word_chars", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
            "echo_rate": rate("n_echo_words", "n_words"),
            "base_failed": F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"),
        }
    )


def row_key(documents: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text", "lang", "source")


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the rates' log-linear histograms of the rows that pass the base rules."""
    pairs = ", ".join(f"'{r}', {r}" for r in SLACK)
    long = measured.where("NOT base_failed").selectExpr("lang", "source", f"stack({len(SLACK)}, {pairs}) AS (rule, v)")
    bucket = F.expr("if(v < 64, v, 32 * (length(bin(v)) - 6) + shiftright(v, length(bin(v)) - 6))").cast("long")
    return long.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketched: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) with a low and a high fence for each rule, from the narrowest sketch of enough rows."""
    low_end = F.expr("if(bucket < 64, bucket, shiftleft(bucket - 32 * (bucket div 32 - 1), cast(bucket div 32 - 1 as int)))")
    levels = sketched.withColumn("level", F.explode(F.array(*map(F.lit, range(3)))))
    merged = levels.groupBy(
        "level", "rule", "bucket",
        F.when(F.col("level") < 2, F.col("lang")).otherwise("").alias("lang"),
        F.when(F.col("level") < 1, F.col("source")).otherwise("").alias("source"),
    ).agg(F.sum("n").alias("n"))
    group = ["level", "lang", "source", "rule"]
    upto = Window.partitionBy(*group).orderBy("bucket")
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*group)), "value": low_end})
    first = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    spans = ranked.groupBy(*group).agg(first(1).alias("q1"), first(3).alias("q3"), F.max("total").alias("total"))
    slack = F.element_at(F.create_map(*(F.lit(x) for r, (s, _) in SLACK.items() for x in (r, s))), F.col("rule"))
    wide = spans.withColumn("width", REACH * F.greatest(F.col("q3") - F.col("q1"), slack))
    found = wide.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("rule") == r, F.col("q3") + F.col("width"))).alias(f"most_{r}") for r in SLACK),
        *(F.max(F.when(F.col("rule") == r, F.col("q1") - F.col("width"))).alias(f"least_{r}") for r, (_, both) in SLACK.items() if both),
    )
    limits = [c for c in found.columns if c.startswith(("most_", "least_"))]
    at = lambda k, keys: found.where(F.col("level") == k).select(*keys, F.struct("total", *limits).alias(f"at{k}"))
    narrow = at(0, ["lang", "source"]).join(at(1, ["lang"]), "lang").withColumn("all", F.lit(1)).join(
        at(2, []).withColumn("all", F.lit(1)), "all"
    )
    use = F.when(F.col("at0.total") >= min_group, F.col("at0")).when(F.col("at1.total") >= min_group, F.col("at1")).otherwise(F.col("at2"))
    return narrow.select("lang", "source", use.alias("use")).select("lang", "source", *(f"use.{c}" for c in limits))


def judge(documents: DataFrame) -> DataFrame:
    """What `measure` gives, each row's fences, and `kept`."""
    measured = stored(measure(documents), "quality")
    joined = salted(measured, fences(sketch(measured)), ["lang", "source"], F.col("row_key"))
    inside = " AND ".join(
        [f"{r} <= most_{r}" for r in SLACK] + [f"{r} >= least_{r}" for r, (_, both) in SLACK.items() if both]
    )
    return joined.withColumn("kept", F.expr(f"NOT base_failed AND coalesce({inside}, true)"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that pass, all columns as they were."""
    key = fresh(documents.columns, "_row_key")
    rejected = judge(documents).where("NOT kept").select(F.col("row_key").alias(key)).distinct()
    return documents.withColumn(key, row_key(documents)).join(rejected, key, "left_anti").drop(key)


SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
w AS (
  SELECT rid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT rid, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM rows)),
w8 AS (
  SELECT *, lag(word) OVER o AS before, count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS size,
    string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos, word, before, size = 8 AND count(*) OVER (PARTITION BY rid, win) > 1 AS twice FROM w8),
covered AS (
  SELECT rid, word, before, max(twice::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
  FROM again),
by_word AS (
  SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(hit)::BIGINT AS n_repeat_words,
    count(*) FILTER (word = before) AS n_echo_words
  FROM covered GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows)
  WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY rid),
counted AS (
  SELECT rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_echo_words, 0) AS n_echo_words
  FROM rows LEFT JOIN by_word USING (rid) LEFT JOIN lines USING (rid)),
rated AS (
  SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * word_chars // greatest(n_words, 1) AS word_length,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
    1000 * n_echo_words // greatest(n_words, 1) AS echo_rate,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted),
long AS (
  SELECT lang, source, unnest(['symbol_rate', 'word_length', 'dup_line_rate', 'repeat_rate', 'echo_rate']) AS rule,
    unnest([symbol_rate, word_length, dup_line_rate, repeat_rate, echo_rate]) AS v
  FROM rated WHERE NOT base_failed),
hist AS (
  SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)::BIGINT) END AS bucket, count(*) AS n
  FROM long GROUP BY ALL),
levels AS (
  SELECT 0 AS level, lang, source, rule, bucket, n FROM hist
  UNION ALL SELECT 1, lang, '', rule, bucket, sum(n) FROM hist GROUP BY lang, rule, bucket
  UNION ALL SELECT 2, '', '', rule, bucket, sum(n) FROM hist GROUP BY rule, bucket),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, rule) AS total,
    CASE WHEN bucket < 64 THEN bucket ELSE (bucket - 32 * (bucket // 32 - 1)) << (bucket // 32 - 1) END AS value
  FROM levels),
spans AS (
  SELECT level, lang, source, rule, min(value) FILTER (upto * 4 >= total) AS q1, min(value) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS total
  FROM ranked GROUP BY ALL),
fence AS (
  SELECT level, lang, source, rule, total, q3 + 3 * greatest(q3 - q1, slack) AS most, q1 - 3 * greatest(q3 - q1, slack) AS least
  FROM spans JOIN (VALUES ('symbol_rate', 20), ('word_length', 1000), ('dup_line_rate', 200), ('repeat_rate', 100), ('echo_rate', 50)) s(rule, slack) USING (rule)),
used AS (
  SELECT a.lang, a.source, a.rule,
    CASE WHEN a.total >= 50 THEN a.most WHEN b.total >= 50 THEN b.most ELSE c.most END AS most,
    CASE WHEN a.total >= 50 THEN a.least WHEN b.total >= 50 THEN b.least ELSE c.least END AS least
  FROM fence a JOIN fence b ON b.level = 1 AND b.lang = a.lang AND b.rule = a.rule
    JOIN fence c ON c.level = 2 AND c.rule = a.rule
  WHERE a.level = 0),
wide AS (
  SELECT lang, source, max(most) FILTER (rule = 'symbol_rate') AS m_symbol, max(most) FILTER (rule = 'word_length') AS m_length,
    max(least) FILTER (rule = 'word_length') AS l_length, max(most) FILTER (rule = 'dup_line_rate') AS m_line,
    max(most) FILTER (rule = 'repeat_rate') AS m_repeat, max(most) FILTER (rule = 'echo_rate') AS m_echo
  FROM used GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol_rate <= m_symbol AND word_length <= m_length AND word_length >= l_length
    AND dup_line_rate <= m_line AND repeat_rate <= m_repeat AND echo_rate <= m_echo, true) AS kept,
  n_lines, n_echo_words
FROM rated LEFT JOIN wide USING (lang, source)
"""
