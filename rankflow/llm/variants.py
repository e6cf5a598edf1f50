"""Grouping of spelling variants: words one edit apart, found through Bloom filters.

Words are maximal runs of Latin letters (`[A-Za-z\\u00C0-\\u00FF]+`, A-Z lowered) of at least
`LEAST_CHARS` letters that occur `LEAST_TIMES` times or more in all texts. Two words are near if
one inserted, deleted or replaced letter makes one of the other. A word's form is its most
frequent near word, if that is at least twice as frequent; following forms leads to its root.

A word's neighbourhood is generated, not searched for: every deletion, and every replacement by a
later letter that the vocabulary has (an insertion is a deletion of the other word, a replacement by an
earlier letter is one of the other word by a later letter, so each pair arises once). Letters are
single bytes, and a polynomial hash of an edited word follows from sums over its parts without
spelling it out. The hashes are probed against blocked Bloom filters of the vocabulary, one shard
a word length: a word owns one 64-bit block and four bits in it. The filters are built by
Spark (bitwise or per block) and broadcast: at most `SLOTS` blocks of 8 bytes; a larger
vocabulary is filtered in several rounds, one hash part of it a round. Only positives are
shuffled, as pairs of hashes with the edit; joins with the vocabulary spell the edit out and
compare it, so neither false positives nor equal hashes are left.

Null texts have no words; a null doc_id is treated as any other. Repeated rows count again. Without
words the result is empty. Other columns of the documents are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rankflow.llm.common import stored

LEAST_CHARS = 5
LEAST_TIMES = 3
#: Blocks of all filters of a round (8 bytes each): the bound of what is broadcast.
SLOTS = 1 << 21
#: Bits of a filter a word; four are set.
BITS = 16
#: Words longer than this share one shard.
LAST_SHARD = 64
#: What a word may hold once A-Z are lowered, in code-point order.
LETTERS = bytes(range(97, 123)) + bytes(range(0xC0, 0x100))

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = np.uint64(0xD1342543DE82EF95)


def _salt(size: int) -> np.uint64:
    return np.uint64(size * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _BASE
    return np.cumprod(out, dtype=np.uint64)


def raw_hash(letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of one length, given as rows of Latin-1 bytes; `_mixed` finishes them."""
    n = letters.shape[1]
    return (_LETTER[letters] * _powers(n)[::-1]).sum(1, dtype=np.uint64) + _salt(n)


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows of Latin-1 bytes) of the words of each length."""
    sizes = np.asarray(pc.utf8_length(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        text = "".join(words.take(pa.array(group)).to_pylist()).encode("latin-1")
        yield group, np.frombuffer(text, np.uint8).reshape(len(group), -1)


def edits(letters: np.ndarray, alphabet: bytes = LETTERS) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(rows, position, letter or -1 for a deletion, unfinished hash) of the edits of words of one length.

    At each position the words are put in the order of their letter there, so that those with an
    earlier letter than a given one are a slice. A finished hash is `_mixed` of an unfinished one.
    """
    n = letters.shape[1]
    power, own = _powers(n + 1), _LETTER[letters]
    whole = (own * power[:n][::-1]).sum(1, dtype=np.uint64)
    before = np.zeros(len(letters), np.uint64)  # hash of what precedes the position
    for i in range(n):
        rest = power[n - 1 - i]
        upto = before * _BASE + own[:, i]
        # Of equal neighbours only the first is deleted: the result is the same.
        rows = np.arange(len(letters)) if i == 0 else np.flatnonzero(letters[:, i] != letters[:, i - 1])
        yield rows, i, -1, (before * rest + whole - upto * rest + _salt(n - 1))[rows]
        order = np.argsort(letters[:, i], kind="stable")
        without = (whole - own[:, i] * rest + _salt(n))[order]
        ends = np.searchsorted(letters[order, i], np.frombuffer(alphabet, np.uint8))
        for letter, end in zip(alphabet, ends.tolist(), strict=True):
            if end:
                yield order[:end], i, letter, without[:end] + np.multiply(_LETTER[letter : letter + 1], rest)
        before = upto


_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


def place_of(raw: np.ndarray, slots: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, the product that its bits come from) of unfinished hashes in a filter of `slots` blocks."""
    product = raw * _SPREAD
    return ((product >> np.uint64(40)) * np.asarray(slots, np.uint64)) >> np.uint64(24), product


def bits_of(product: np.ndarray) -> np.ndarray:
    one, mask = np.uint64(1), np.uint64(63)
    bits = one << ((product >> np.uint64(34)) & mask)
    for shift in (28, 22, 16):
        bits |= one << ((product >> np.uint64(shift)) & mask)
    return bits


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(hashes) % np.uint64(parts)).astype(np.int64)


def observed(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """`word`, a row for every run of `LEAST_CHARS` letters or more, A-Z lowered.

    With `noise`, runs whose CRC with their doc_id it divides lose a letter: typing errors to be found.
    """
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}"), F.lit(0))
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(found).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ascii_only = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", upper, lower)).alias("word"))
    if noise is None:
        return low.select("word")
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    worn = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return low.withColumn("h", h).select(F.when(F.col("h") % noise == 0, worn).otherwise(F.col("word")).alias("word")).where(
        F.length("word") >= LEAST_CHARS
    )


def vocabulary(words: DataFrame) -> DataFrame:
    """`word`, `n`, `size` (code points) and `hash` of the words that occur often enough; stored."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
            for group, letters in by_length(batch.column(0)):
                hashes[group], sizes[group] = raw_hash(letters), letters.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes), pa.array(hashes.view(np.int64))], names=["word", "n", "size", "hash"]
            )

    return stored(counted.select("word", "n").mapInArrow(run, "word string, n long, size int, hash long"), "vocabulary")


def shard_of(size: int) -> int:
    return min(size, LAST_SHARD)


def filters_of(known: DataFrame, slots: dict[int, int], part: int, parts: int) -> dict[int, np.ndarray]:
    """The filters of one part of the vocabulary by word length, at most `SLOTS` blocks in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = np.asarray(batch.column(1)).view(np.uint64), np.minimum(np.asarray(batch.column(0)), LAST_SHARD)
            mine = part_of(hashes, parts) == part
            hashes, sizes = hashes[mine], sizes[mine]
            block, product = place_of(hashes, np.array([slots[s] for s in sizes.tolist()], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(block.view(np.int64)), pa.array(bits_of(product).view(np.int64))],
                names=["shard", "block", "bits"],
            )

    blocks = known.select("size", "hash").mapInArrow(run, "shard int, block long, bits long")
    merged = blocks.groupBy("shard", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    shard, block, bits = (np.asarray(merged.column(c).combine_chunks()) for c in ("shard", "block", "bits"))
    out = {}
    for s, n in slots.items():
        table = np.zeros(n, np.uint64)
        table[block[shard == s]] = bits[shard == s].view(np.uint64)
        out[s] = table
    return out


#: Words of one length whose edits are hashed together.
PIECE = 16_384


def letters_of(known: DataFrame) -> bytes:
    """The letters that words of the vocabulary have, at most those of `LETTERS`: no other can be put in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(256, bool)
        for batch in batches:
            for _, letters in by_length(batch.column(0)) if batch.num_rows else ():
                held[letters.reshape(-1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held), pa.int32())], names=["letter"])

    return bytes(sorted(r.letter for r in known.select("word").mapInArrow(run, "letter int").distinct().collect()))


def positives(known: DataFrame, filters, part: int, parts: int, alphabet: bytes) -> DataFrame:
    """`source`, `target` (hashes), `at`, `letter` (null: deletion) of edits that the filters let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = filters.value
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = np.asarray(batch.column(1)).view(np.uint64)
            for group, letters in by_length(batch.column(0)):
                for low in range(0, len(group), PIECE):
                    yield from found(hashes[group[low : low + PIECE]], letters[low : low + PIECE], tables)

    def found(own: np.ndarray, letters: np.ndarray, tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        n = 0
        for rows, at, letter, target in edits(letters, alphabet):
            table = tables.get(shard_of(letters.shape[1] - (letter < 0)))
            if table is None or not len(rows):
                continue
            block, product = place_of(target, len(table))
            block = table[block]
            # Most edits fail on the first bit; the other three are looked up for the rest.
            hit = np.flatnonzero((block >> ((product >> np.uint64(34)) & np.uint64(63))) & np.uint64(1))
            bits = bits_of(product[hit])
            hit = hit[(block[hit] & bits) == bits]
            if parts > 1:
                hit = hit[part_of(target[hit], parts) == part]
            if len(hit):
                kept.append((own[rows[hit]], target[hit], at, letter))
                n += len(hit)
            if n >= 100_000:
                yield batch_of(kept)
                kept, n = [], 0
        if kept:
            yield batch_of(kept)

    def batch_of(kept: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
        sizes = [len(k[0]) for k in kept]
        letters = np.repeat([k[3] for k in kept], sizes)
        text = pa.array([None if x < 0 else chr(x) for x in letters.tolist()], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([k[0] for k in kept]).view(np.int64)),
                pa.array(np.concatenate([k[1] for k in kept]).view(np.int64)),
                pa.array(np.repeat([k[2] for k in kept], sizes), pa.int32()), text,
            ],
            names=["source", "target", "at", "letter"],
        )

    # Few bytes a word are many probes, so the number of tasks doesn't follow the bytes.
    width = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = known.select("word", "hash").repartition(2 * width, "hash")
    return spread.mapInArrow(run, "source long, target long, at int, letter string")


def links(known: DataFrame) -> DataFrame:
    """`word`, `n`, `other`, `n_other`: every pair of near words of a stored vocabulary, once."""
    spark = known.sparkSession
    sizes = {r.shard: r.n for r in known.groupBy(F.least("size", F.lit(LAST_SHARD)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    parts = max(1, -(-sum(sizes.values()) * BITS // (64 * SLOTS)))
    slots = {s: max(1, -(-n * BITS // (64 * parts))) for s, n in sizes.items()}
    found = []
    alphabet = letters_of(known)
    for part in range(parts):
        filters = spark.sparkContext.broadcast(filters_of(known, slots, part, parts))
        found.append(stored(positives(known, filters, part, parts, alphabet), "positives"))
        filters.unpersist()
    if not found:
        found = [spark.createDataFrame([], "source long, target long, at int, letter string")]
    edited = functools.reduce(DataFrame.unionAll, found)
    targets = known.select(F.col("hash").alias("target"), F.col("word").alias("other"), F.col("n").alias("n_other"))
    sources = known.select(F.col("hash").alias("source"), "word", "n")
    spelled = F.concat(
        F.substring("word", F.lit(1), F.col("at")), F.coalesce("letter", F.lit("")), F.substring("word", F.col("at") + 2, F.length("word"))
    )
    return edited.join(targets, "target").join(sources, "source").where(spelled == F.col("other")).select("word", "n", "other", "n_other")


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root`: the end of each chain `word` -> `form` (no cycles), each round looking twice as far."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "forms")
    done: list[DataFrame] = []
    while True:
        next_one = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        for part in done:
            next_one = next_one.unionAll(part.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        step = stored(ahead.join(next_one, "root", "left").select("word", "root", "_next"), "roots")
        done.append(step.where("_next IS NULL").select("word", "root"))
        ahead = step.where("_next IS NOT NULL").select("word", F.col("_next").alias("root"))
        if ahead.isEmpty():
            return functools.reduce(DataFrame.unionAll, done)


def group(words: DataFrame) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` of every word of the vocabulary."""
    known = vocabulary(words)
    pairs = links(known)
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("n_other").alias("n"), F.col("word").alias("other"), F.col("n").alias("n_other")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), F.col("other").alias("w"))).alias("best")
    )
    joined = known.select("word", "n").join(best, "word", "left")
    more = -F.col("best.m") >= 2 * F.col("n")
    formed = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(more, F.col("best.w")).alias("form"), F.when(more, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def replace(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """`word`, `root` of the words that have another root: the table to rewrite texts by."""
    return groups.where(F.col("root") != F.col("word")).select("word", "root")


SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
hexed AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x
  FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2),
  lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM hexed, tab),
worn AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM coded),
known AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM worn WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM known)),
pairs AS (SELECT l.word, l.n, r.word AS other, r.n AS m FROM gaps l JOIN gaps r ON l.i = r.i AND l.a = r.a AND l.b = r.b AND l.word <> r.word
  UNION SELECT g.word, g.n, k.word, k.n FROM gaps g JOIN known k ON k.word = g.a || g.b
  UNION SELECT k.word, k.n, g.word, g.n FROM gaps g JOIN known k ON k.word = g.a || g.b),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM known LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS tip, 1 AS k FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(tip, k) AS root FROM chain GROUP BY word)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM forms LEFT JOIN ends USING (word)
"""
