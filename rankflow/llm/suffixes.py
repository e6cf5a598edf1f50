"""Exact repeats across documents, by a blockwise suffix order with a difference cover.

Every byte that lies in a string of `MATCH` bytes which also starts in a document of a smaller
doc_id is removed. Texts are UTF-8 bytes, strings never cross documents, and all strings are
judged on the input.

The bytes are laid out in parts of whole documents, parts in the order of doc_id, in a table
bucketed by part: every pass reads it without a shuffle of texts. Positions of a part that lie in
a difference cover modulo `PERIOD` are its cover sample: of any two equal strings of `MATCH` bytes
some position at the same distance below `PERIOD` is sampled in both, wherever they stand. So

1. the `SEED` bytes at each sampled position are ranked, which leaves the samples whose seed stands
   in two documents (the cover's ranks);
2. the suffixes at those samples are sorted to `MATCH` bytes. On a long tie of two documents the
   cover has a pair at least every `PERIOD` positions, so these strings cover all of it but its ends;
3. all suffixes that start less than `PERIOD` bytes before a live sample are ranked: those
   that could still remove a byte (the ends of ties, and short ones) and those that may be what
   these repeat, which leaves the strings that stand in two documents and that one still asks for;
4. the suffixes that are left are sorted.

Each pass sorts one suffix bucket at a time: a bucket is a range of string hashes, as narrow as the
data needs, so memory is bounded by the bucket and the part. A part asks once for each of its
different strings, however often it holds them, sends hashes in order as compressed differences,
and gets one bit for each: whether a smaller part (in passes 1 and 3 any other) has the string. So
a passage of all documents costs each bucket one entry a part. Hashes have 64 bits (in passes 1
and 3 the bucket and 32 bits: a chance match there only costs work).

A null text is empty. A null doc_id comes before all others; rows of equal doc_id never remove
from each other. A document is never split, so a task holds about 40 times the bytes of the largest part.
Empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from rankflow.llm.common import fresh, stored, tidy
from rankflow.session import new_folder

MATCH = 50
#: A perfect difference set: each residue but 0 is one difference of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SEED = MATCH - PERIOD + 1
PART_BYTES, BUCKET_STRINGS, LEAST_PARTS = 6 << 20, 2 << 20, 64

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def encode(sorted_keys: np.ndarray) -> bytes:
    """Ascending unsigned integers as compressed differences, byte planes apart."""
    steps = np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))
    planes = steps.view(np.uint8).reshape(len(steps), steps.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def decode(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


class Strings:
    """The different strings at some positions of a part, in the order of their hashes."""

    def __init__(self, part: Part, at: np.ndarray, length: int, asks: np.ndarray | None = None):
        self.at = at
        hashes = part.hashes(at, length)
        self.order = np.argsort(hashes)
        hashes = hashes[self.order]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        self.keys = hashes[begin]
        self.group = np.cumsum(new) - 1
        owners = part.owner(at)[self.order]
        self.owners = owners
        self.least = np.minimum.reduceat(owners, begin) if len(at) else owners
        if asks is None or not len(at):
            self.asked = np.ones(len(begin), bool)
            self.inner = self.least != (np.maximum.reduceat(owners, begin) if len(at) else owners)
        else:
            asks = asks[self.order]
            self.asked = np.logical_or.reduceat(asks, begin)
            self.inner = np.logical_or.reduceat(asks & (owners > self.least[self.group]), begin)

    def questions(self, part: int, bits: int, short: bool) -> list[dict]:
        """A row for each bucket that has strings."""
        buckets = (self.keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        rows = []
        for a, b in zip([0, *cuts], [*cuts, len(buckets)], strict=True):
            if b > a:
                keys = self.keys[a:b]
                if short:
                    keys = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                rows.append({"bucket": int(buckets[a]), "part": part, "n": b - a, "keys": encode(keys), "inner": np.packbits(self.inner[a:b]).tobytes(), "asked": np.packbits(self.asked[a:b]).tobytes()})
        return rows

    def having(self, yes: np.ndarray) -> np.ndarray:
        """The positions of the strings for which the answer is yes."""
        return self.at[self.order[yes[self.group]]]

    def repeated(self, smaller: np.ndarray) -> np.ndarray:
        """At each position: does its string also start in a document of smaller doc_id?"""
        out = np.empty(len(self.at), dtype=bool)
        out[self.order] = (self.owners > self.least[self.group]) | smaller[self.group]
        return out


class Part:
    """The documents of a part, in the order of doc_id, as one run of bytes."""

    def __init__(self, table: pa.Table, ids: str, data: str):
        order = pc.sort_indices(table[ids], null_placement="at_start")
        self.table = table.take(order).combine_chunks()
        column = pa.concat_arrays(self.table[data].chunks) if self.table[data].num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.edges = offsets - offsets[0]
        self.size = len(raw)
        self.bytes = np.r_[raw, np.zeros(8, np.uint8)]
        self.words = np.ndarray((self.size + 1,), "<u8", self.bytes, strides=(1,))
        keys = self.table[ids].to_pylist()
        self.rank = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])[: len(keys)].astype(np.int32)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, at, "right") - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        return self.rank[self.document(at)]

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the positions, those whose string of this length ends in the same document."""
        return at[at + length <= self.edges[self.document(at) + 1]]

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            h = (h ^ self.words[at + k]) * _G
            h = (h ^ (h >> np.uint64(29))) * _M1
        h = (h ^ (h >> np.uint64(32))) * _M2
        return h ^ (h >> np.uint64(29))

    def seeds(self) -> Strings:
        turns = np.arange(0, self.size, PERIOD, dtype=np.int64)
        at = (turns[:, None] + np.array(COVER, dtype=np.int64)).ravel()
        return Strings(self, self.whole(at[at < self.size], SEED), SEED)

    def ties(self, alive: np.ndarray) -> Strings:
        return Strings(self, self.whole(alive, MATCH), MATCH)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        edges = np.zeros(self.size + 1, dtype=np.int32)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + MATCH, -1)
        return np.cumsum(edges[:-1]) > 0

    def near(self, alive: np.ndarray, covered: np.ndarray) -> Strings:
        """Suffixes that a live sample follows closely; those that would still remove a byte ask."""
        edges = np.zeros(self.size + 1, dtype=np.int32)
        first = np.maximum(alive - (PERIOD - 1), self.edges[self.document(alive)])
        np.add.at(edges, first, 1)
        np.add.at(edges, alive + 1, -1)
        at = self.whole(np.flatnonzero(np.cumsum(edges[:-1]) > 0), MATCH)
        upto = np.r_[0, np.cumsum(covered, dtype=np.int64)]
        return Strings(self, at, MATCH, upto[at + MATCH] - upto[at] < MATCH)


class State:
    """A part before pass `turn` (5: after all): what it asks then, and what it has to remember until the answers come.

    `answers` are those to the pass before, with what was remembered.
    """

    def __init__(self, part: Part, answers: pa.Table, turn: int):
        rows = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["bits"].to_pylist(), strict=True))
        notes = pickle.loads(rows[0][2]) if rows and rows[0][0] < 0 else {}
        told = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for k, n, b in rows if k >= 0]
        said = np.concatenate(told).astype(bool) if told else np.zeros(0, bool)
        alive, left = (decode(notes[k], np.uint32).astype(np.int64) if k in notes else np.zeros(0, np.int64) for k in ("alive", "left"))
        covered = np.unpackbits(np.frombuffer(_unzip(notes["covered"]), np.uint8), count=part.size).astype(bool) if "covered" in notes else np.zeros(part.size, bool)
        if turn == 1:
            self.asked = part.seeds()
        if turn == 2:
            alive = np.sort(part.seeds().having(said))
            self.asked = part.ties(alive)
        if turn == 3:
            ties = part.ties(alive)
            covered = part.covered(ties.at[ties.repeated(said)])
            self.asked = part.near(alive, covered)
        if turn == 4:
            left = np.sort(part.near(alive, covered).having(said))
            self.asked = Strings(part, left, MATCH)
        if turn == 5:
            rest = Strings(part, left, MATCH)
            covered |= part.covered(rest.at[rest.repeated(said)])
        self.covered = covered
        self.notes = {
            2: {"alive": encode(alive.astype(np.uint32))}, 4: {"left": encode(left.astype(np.uint32)), "covered": _zip(np.packbits(covered).tobytes())},
            3: {"alive": encode(alive.astype(np.uint32)), "covered": _zip(np.packbits(covered).tobytes())},
        }.get(turn)

    def questions(self, part: int, bits: int, short: bool) -> list[dict]:
        rows = self.asked.questions(part, bits, short)
        if self.notes:
            rows.append({"bucket": -1 - part, "part": part, "n": 0, "keys": pickle.dumps(self.notes), "inner": b"", "asked": b""})
        return rows


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


QUESTION = "bucket int, part long, n int, keys binary, inner binary, asked binary"
#: Passes that send 32 bits of a hash and look for any other document.
SHORT = (1, 3)
ANSWER = "pass int, part long, bucket int, n int, bits binary"


def _table(rows: list[dict], told: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[k]) for n, k in (x.split() for x in told.split(", "))]))


def _ask(turn: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's questions, given the answers so far."""

    def work(documents: pa.Table, answers: pa.Table) -> pa.Table:
        if not documents.num_rows:  # answers to a part there is not
            return _table([], QUESTION)
        state = State(Part(documents, "id", "data"), answers, turn)
        return _table(state.questions(documents["part"][0].as_py(), bits, turn in SHORT), QUESTION)

    return work


def _answer(turn: int) -> Callable[[pa.Table], pa.Table]:
    """Sort one bucket's strings; for each part's, tell whether a smaller part (in short passes any other) has them."""

    def work(bucket: pa.Table) -> pa.Table:
        rows = sorted(bucket.to_pylist(), key=lambda r: r["part"])
        if rows[0]["bucket"] < 0:  # what a part has found so far goes along with its answers
            return _table([{"pass": turn, "part": r["part"], "bucket": -1, "n": 0, "bits": r["keys"]} for r in rows], ANSWER)
        keys = [decode(r["keys"], np.uint32 if turn in SHORT else np.uint64) for r in rows]
        sizes = np.array([r["n"] for r in rows])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")  # equal strings in the order of their parts
        same = every[order][1:] == every[order][:-1]
        begin = np.flatnonzero(np.r_[True, ~same])
        if turn in SHORT:
            flags = lambda c: np.concatenate([np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["n"]) for r in rows])[order].astype(bool)
            wanted = flags("inner") | flags("asked") & np.r_[False, same]
            yes = np.repeat(np.logical_or.reduceat(wanted, begin), np.diff(np.r_[begin, len(every)]))
        else:
            yes = np.r_[False, same]
        out = np.empty(len(every), dtype=bool)
        out[order] = yes
        parts = np.split(out, np.cumsum(sizes)[:-1])
        made = [{"pass": turn, "part": r["part"], "bucket": r["bucket"], "n": r["n"], "bits": np.packbits(p).tobytes()} for r, p in zip(rows, parts, strict=True)]
        return _table(made, ANSWER)

    return work


def mark(documents: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The bucketed parts, the answers to the last pass, and the parts' columns: part, data, doc_id, then the given ones."""
    spark = documents.sparkSession
    columns = documents.columns
    part, data, ids = (fresh(columns, c) for c in ("_part", "_data", "_id"))
    key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // PART_BYTES))
    # cuts between parts: few numbers, as many as parts
    cuts = documents.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    place = fresh(columns, "_place")
    keyed = documents.withColumns({ids: key, data: text, place: F.coalesce(key.cast("double"), F.lit(-1.7e308))})
    dealt = Bucketizer(splits=splits, inputCol=place, outputCol=part).transform(keyed).withColumn(part, F.col(part).cast("long"))
    name = "parts_" + new_folder(spark, "p").rsplit("-", 1)[1]
    rest = [c for c in columns if c.lower() != "text"]
    with tidy(spark):
        dealt.select(part, data, ids, *rest).repartition(parts, part).write.bucketBy(parts, part).option("path", new_folder(spark, "parts")).option(
            "compression", "zstd"
        ).saveAsTable(name)
    table = spark.table(name)
    bits = max(6, int(np.ceil(np.log2(max(total * len(COVER) / PERIOD / BUCKET_STRINGS, 1)))))
    answers = spark.createDataFrame([], ANSWER)
    slim = table.select(F.col(part).alias("part"), F.col(ids).alias("id"), F.col(data).alias("data"))
    for turn in (1, 2, 3, 4):
        asked = slim.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_ask(turn, bits), QUESTION)
        answers = stored(asked.groupBy("bucket").applyInArrow(_answer(turn), ANSWER), "answers")
    return table, answers, [part, data, ids, *rest]


def find_repeats(documents: DataFrame) -> DataFrame:
    """Every row's columns but text, and: n_bytes, spans (byte ranges removed, end exclusive), kept (the other bytes)."""
    table, answers, (part, data, ids, *rest) = mark(documents)
    n, spans, kept = (fresh(rest, c) for c in ("n_bytes", "spans", "kept"))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Part(left, ids, data)
        covered = State(held, right, 5).covered
        found, left_over = [], []
        for a, b in zip(held.edges[:-1].tolist(), held.edges[1:].tolist(), strict=True):
            own = covered[a:b]
            edges = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0])).reshape(-1, 2)
            found.append([{"begin": x, "end": y} for x, y in edges.tolist()])
            left_over.append(held.bytes[a:b][~own].tobytes())
        made = [pa.array(np.diff(held.edges)), pa.array(found, span), pa.array(left_over, pa.binary())]
        return pa.Table.from_arrays([*(held.table[c] for c in rest), *made], names=[*rest, n, spans, kept])

    told = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in rest]
    told += [f"`{n}` long", f"`{spans}` array<struct<begin: bigint, end: bigint>>", f"`{kept}` binary"]
    return table.groupBy(part).cogroup(answers.groupBy("part")).applyInArrow(finish, ", ".join(told))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.begin)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """All columns as they were, text without its repeated bytes (and without what is left of cut characters)."""
    found = find_repeats(documents)
    given = documents.columns
    rest = [c for c in given if c.lower() != "text"]
    spans, kept = found.columns[-2:]

    def letters(batches):
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in batch.column(kept).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), batch.column(spans)], [*rest, "text", "_letters", "_spans"])

    told = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest]
    made = found.mapInArrow(letters, ", ".join([*told, "text string, _letters long, _spans array<struct<begin: bigint, end: bigint>>"]))
    if "n_chars" in given:
        cut = F.size("_spans") > 0
        made = made.withColumn("n_chars", F.when(cut, F.col("_letters")).otherwise(F.col("n_chars")))
    return made.select(*given)
