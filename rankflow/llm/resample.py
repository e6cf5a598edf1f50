"""Importance resampling of documents towards a target distribution, on hashed word runs.

Features of a text are its runs of one to three consecutive words, joined by one space (words:
lower-case runs of ASCII letters, digits and code points from 0x80 up; only A-Z are lowered). A
feature's bucket is the CRC-32 of its UTF-8 bytes modulo `BUCKETS`. The gain of a bucket is
1000 times the logarithm of its smoothed share in the target over its share in the source, rounded
down; a document's weight is the sum of the gains of its features. Adding Gumbel noise from a hash
of the doc_id and keeping the highest scores draws without replacement, in proportion to the
weights.

CRCs are computed by length. Texts of a batch are flattened to one buffer of words with single
spaces between them, so each feature is a slice of it. The features of one length make a
two-dimensional array of bytes; its distinct rows are found by dictionary encoding, their CRCs
are updated together, a column at a time, and the buckets go back to every row through the
dictionary. A feature longer than `LONGEST` bytes (one giant word) is rare and goes through zlib.

The bucket numbers are stored once per document, counted by partition and summed in Spark; what
reaches the driver are the `BUCKETS` gains, whatever the size of the corpus. Scores are ranked by a
range partitioning of small rows, not in one task.

Null texts and texts without words have no features and weight 0. A null doc_id is hashed as an
empty one and comes last among equal scores. Repeated rows are separate rows with equal scores.
Without a target text all gains follow the source alone; an empty document table gives an empty
result. Other columns of the tables are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankflow.functions.ordered import with_sequential_id
from rankflow.llm.common import stored, tidy

BUCKETS = 10_000
#: Words of the longest feature.
RUN = 3
#: Words whose features are in memory as matrices at a time.
PIECE = 30_000
#: Bytes of a feature up to which a column-by-column update pays.
LONGEST = 256
#: No bucket number: the run would cross the end of its text.
NONE = 0xFFFF

_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8
)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null text is empty."""
    texts = texts.cast(pa.large_string())
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            return flat_bytes(texts.fill_null(""))
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words of all texts, one space after each: (buffer, start of each word, its length, its text)."""
    folded = _FOLD[raw]
    inside = folded != 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    last = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - begins
    starts = np.cumsum(lengths + 1) - lengths - 1
    kept = np.flatnonzero(inside)
    buffer = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    buffer[np.arange(len(kept)) + np.repeat(np.arange(len(lengths)), lengths)] = folded[kept]
    return buffer, starts, lengths, np.searchsorted(offsets, begins, "right") - 1


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_slices(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of slices of a buffer, all slices of one length together, each distinct one once."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, at = np.unique(lengths[order], return_index=True)
    for size, group in zip(sizes.tolist(), np.split(order, at[1:]), strict=True):
        begin = starts[group]
        if size > LONGEST:
            out[group] = [zlib.crc32(buffer[b : b + size]) for b in begin.tolist()]
            continue
        rows = buffer[begin[:, None] + np.arange(size)]
        encoded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode()
        distinct = np.frombuffer(encoded.dictionary.buffers()[1], np.uint8)[: len(encoded.dictionary) * size]
        out[group] = crc_rows(distinct.reshape(-1, size))[np.asarray(encoded.indices)]
    return out


def buckets_of(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature in text order, features per text, words per text)."""
    buffer, starts, lengths, text = words_of(raw, offsets)
    words, n = np.bincount(text, minlength=len(offsets) - 1), len(starts)
    found = np.full((n, RUN), NONE, np.uint16)
    for low in range(0, n, PIECE):
        at, first, size = [], [], []
        for k in range(RUN):
            i = np.arange(low, min(low + PIECE, n - k))
            i = i[text[i] == text[i + k]]
            at.append(i * RUN + k)
            first.append(starts[i])
            size.append(starts[i + k] + lengths[i + k] - starts[i])
        crc = crc_slices(buffer, np.concatenate(first), np.concatenate(size))
        found.reshape(-1)[np.concatenate(at)] = crc % np.uint32(buckets)
    features = np.bincount(text, (found != NONE).sum(1), minlength=len(offsets) - 1).astype(np.int64)
    flat = found.reshape(-1)
    return flat[flat != NONE], features, words


def hashed(docs: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """`key`, `n_words`, `n_features`, `buckets` (of all features, repeats included, two bytes each)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, features, words = buckets_of(*flat_bytes(batch.column(1)), buckets)
            ends = np.concatenate(([0], np.cumsum(features))).astype(np.int32) * 2
            numbers = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), numbers],
                names=[key, "n_words", "n_features", "buckets"],
            )

    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, buckets binary")


def numbers_of(column: pa.Array) -> np.ndarray:
    """The bucket numbers of all rows of a batch."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint16)[ends[0] // 2 : ends[-1] // 2] if data is not None and data.size else np.zeros(0, np.uint16)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`bucket`, `n`: one histogram a partition, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            count += np.bincount(numbers_of(batch.column(0)), minlength=buckets)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held])], names=["bucket", "n"])

    parts = features.select("buckets").mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`bucket`, `gain`: 1000 log ratios of the smoothed shares, rounded down, for every bucket."""
    spark = source.sparkSession
    both = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .fillna(0)
    )
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = f"((t + 1D) * (all_s + {buckets}D)) / ((s + 1D) * (all_t + {buckets}D))"
    return both.join(F.broadcast(totals)).selectExpr("bucket", f"CAST(floor(1000 * ln({ratio})) AS BIGINT) AS gain")


def noise(key: str, seed: int) -> Column:
    """Gumbel noise times 1000, rounded down, from a hash of the seed and the key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """`key`, `n_words`, `n_features`, `weight`, `score` of every document."""
    features = stored(hashed(docs, key, buckets), "features")
    wanted = hashed(target.select(F.lit(None).cast("string").alias("none"), "text"), "none", buckets)
    table = gains_of(bucket_counts(features, buckets), bucket_counts(wanted, buckets), buckets)
    gains = np.zeros(buckets, np.int64)
    with tidy(docs.sparkSession):
        for row in table.collect():  # `buckets` rows
            gains[row.bucket] = row.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(2)))
            sums = np.concatenate(([0], np.cumsum(gains[numbers_of(batch.column(3))])))
            upto = sums[np.concatenate(([0], ends))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(upto), pa.int64())], names=[key, "n_words", "n_features", "weight"]
            )

    kind = docs.schema[key].dataType.simpleString()
    weighed = features.mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(key, seed))


def rank(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """`key`, `n_words`, `n_features`, `weight`, `score` and `rank` (1, 2, 3 ... of those drawn, else null).

    `percent` of the documents with `least_words` words or more are drawn, highest scores first,
    ties to the smaller key.
    """
    weighed = stored(weigh(docs, target, key, seed), "weighed")
    able = F.col("n_words") >= least_words
    drawn = weighed.where(able).count() * percent // 100
    # Equal rows differ in `_tie` alone, so that no slice of the order holds more than its share.
    tied = weighed.where(able).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("_tie")]
    placed = with_sequential_id(tied, order, "rank").drop("_tie")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(weighed.where(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; rows with an equal key are drawn together."""
    ranked = rank(docs, target, key, **options).where("rank IS NOT NULL").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(ranked, docs[key].eqNullSafe(F.col("_drawn")), "left_semi")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql() -> str:
    runs = " UNION ALL ".join(
        f"SELECT kind, rid, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS f FROM word WHERE len(ws) >= {k}"
        for k in range(1, RUN + 1)
    )
    return rf"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 's' AS kind, row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
word AS MATERIALIZED (SELECT kind, rid, doc_id,
  regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
runs AS MATERIALIZED (SELECT kind, rid, f, count(*) AS n FROM ({runs}) GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs)),
coded AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2),
  lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, tab),
hits AS MATERIALIZED (SELECT kind, rid, bucket, sum(n) AS n FROM runs JOIN coded USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (kind = 's'), 0) AS all_s, coalesce(sum(n) FILTER (kind = 't'), 0) AS all_t FROM hits),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + {BUCKETS})) / ((s + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (kind = 's'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM hits GROUP BY bucket), totals),
weights AS (SELECT rid, sum(n * gain) AS weight FROM hits JOIN gains USING (bucket) WHERE kind = 's' GROUP BY rid),
scored AS (SELECT rid, doc_id, len(ws) AS n_words, len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS n_features,
  coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
  / 4294967296)))::BIGINT AS score FROM word LEFT JOIN weights USING (rid) WHERE kind = 's'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
  count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM placed
"""


SQL = _sql()
