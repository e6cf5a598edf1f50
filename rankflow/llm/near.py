"""Near-duplicates by DartMinHash over weighted five-word shingles.

A text's elements are its shingles of five words (lower-case runs of ASCII letters, digits and
code points from 0x80 up; a shorter text is one shingle), weighted by how often they occur. Each
unit of an element's weight is a region into which hashed darts fall as a Poisson process over
rank, one expected dart a unit of rank, the same darts in every text; darts ranked beyond
(ln k + 2) k / weight are never thrown. Each dart has a coordinate out of k; the earliest dart of
a coordinate is its signature value, so two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. A text with an empty coordinate gets darts of twice the range.

Texts of equal words are one node (128 bits of their words). Nodes that agree in a band of
signature values share a bucket. No bucket emits its pairs: each component with members in it is
tried, by its most central member, against the bucket's most central member (the node whose
buckets hold most nodes: the text that others were copied from) and against a second one fixed by
hash. Tried pairs are checked exactly (similarity of the shingle multisets at least `LEAST`);
components grow by accepted pairs. Between rounds, buckets of one component or two nodes drop out. When hubs
give nothing more, the buckets left are dealt out into cells of two shards. A cell compares the
signatures of all its pairs of different components, each pair in the least bucket it shares; what
may be similar is checked exactly inside the cell, on the elements of the members concerned, and only
links that connect components leave it, so rows never grow with the pairs. Counts and hubs are aggregates, adaptive execution splits the joins with hot buckets and classes, and components are labels propagated in
Spark; nothing about all documents reaches the driver.

Null texts count as empty. Texts without words are in one class only if they are equal. Repeated
doc_ids and null doc_ids are classed by their texts; a class whose doc_ids are all null has a null
class_id. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankflow.llm.common import by_batch, fresh, stored
from rankflow.llm.decontaminate import words_of

SHINGLE, LEAST = 5, 0.8
#: 24 bands of 5 values: a pair at 0.8 shares none with probability 7e-5.
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
#: Nodes of a bucket in a shard.
SHARD = 64
#: Signature values that a pair must agree in to be checked after the hubs: at 0.8 fewer agree with probability 2e-10.
AGREE = 66
#: Different elements of a cell compared at a time.
COLUMNS = 4096
#: Texts sketched at a time.
TOGETHER = 1000

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included; `known` remembers word hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mix(out * _G + h[k : k + n])
    return out


def elements(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different elements in order, and their weights."""
    return np.unique(hashes, return_counts=True)


def signatures(texts: list[np.ndarray]) -> np.ndarray:
    """Signature values (texts x SIZE) of texts given as shingle hashes; a text without any has zeros."""
    cells, owner = [], []
    for i, hashes in enumerate(texts):
        if len(hashes):
            found, weights = elements(hashes)
            # one cell a unit of weight, in texts without repeats too: their darts must be the same
            unit = np.arange(len(hashes)) - np.repeat(np.cumsum(weights) - weights, weights)
            found = mix(np.repeat(found, weights) + unit.astype(np.uint64) * _G)
            cells.append(found)
            owner.append(np.full(len(found), i, dtype=np.int64))
    out = np.zeros((len(texts), SIZE), dtype=np.uint32)
    if not cells:
        return out
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    weight = np.bincount(owner, minlength=len(texts))
    reach = SIZE * (np.log(SIZE) + 2) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight)
    while len(todo):
        here = np.isin(owner, todo) if len(todo) < len(texts) else slice(None)
        found = _throw(cells[here], owner[here], reach, len(texts))
        full = (found[todo] > 0).all(axis=1)
        out[todo[full]] = found[todo[full]]
        todo = todo[~full]
        reach[todo] *= 2
    return out


def _throw(cells: np.ndarray, owner: np.ndarray, reach: np.ndarray, n: int) -> np.ndarray:
    """The earliest dart of each coordinate within the texts' reach; 0 where there is none."""
    slots, ranks, marks = [], [], []
    rank, turn = np.zeros(len(cells)), 0
    limit = reach[owner]
    while len(cells):
        dart = mix(cells + np.uint64((turn + 1) * int(_G) % 2**64))
        rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        live = rank < limit
        cells, owner, rank, limit, dart = cells[live], owner[live], rank[live], limit[live], dart[live]
        other = mix(dart + _G)
        slots.append(owner * SIZE + (other % np.uint64(SIZE)).astype(np.int64))
        ranks.append(rank)
        marks.append((other >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
        turn += 1
    slots, ranks, marks = np.concatenate(slots), np.concatenate(ranks), np.concatenate(marks)
    order = np.lexsort((ranks, slots))
    slots = slots[order]
    first = np.r_[True, slots[1:] != slots[:-1]] if len(slots) else np.zeros(0, bool)
    out = np.zeros(n * SIZE, dtype=np.uint32)
    out[slots[first]] = marks[order][first]
    return out.reshape(n, SIZE)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """64-bit bucket keys (texts x BANDS)."""
    parts = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _G) + np.zeros((len(signature), 1), dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out + parts[:, :, k] * _G)
    return out.view(np.int64)


def node_of(words: list[bytes], text: str | None) -> bytes:
    """128 bits that equal texts share: of the words, or of the text where there are none."""
    return hashlib.blake2b(b" ".join(words) if words else b"\n" + (text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def sketch(documents: DataFrame) -> DataFrame:
    """row, mark (of the text), doc_id, node, size, signature and bands (none for texts without words) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, nodes, bands = batch.column("text").to_pylist(), [], []
        sizes, signed = [], []
        for at in range(0, len(texts), TOGETHER):
            known: dict[bytes, int] = {}
            split = [words_of(t) for t in texts[at : at + TOGETHER]]
            nodes += [node_of(w, t) for w, t in zip(split, texts[at : at + TOGETHER], strict=True)]
            hashes = [shingles(w, known) for w in split]
            found = signatures(hashes)
            sizes += map(len, hashes)
            signed += [s.tobytes() for s in found]
            made = bands_of(found).tolist()
            bands += [b if w else [] for b, w in zip(made, split, strict=True)]
        kept = ["row", "mark", "doc_id"]
        made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "node", "size", "signature", "bands"])

    rows = documents.select(row_id().alias("row"), F.xxhash64("text").alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_batch(rows, work, "row long, mark long, doc_id long, node binary, size long, signature binary, bands array<long>")


def element_table(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, keys, weights): the elements of the wanted (row, node), once a node."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, keys, weights = [], [], []
        known: dict[bytes, int] = {}
        for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True):
            words = words_of(text)
            if node_of(words, text) == node:
                found, counts = elements(shingles(words, known))
                nodes.append(node)
                keys.append(found.tobytes())
                weights.append(counts.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (nodes, keys, weights)], ["node", "keys", "weights"])

    rows = documents.select(row_id().alias("row"), "text").join(wanted, "row")
    return by_batch(rows, work, "node binary, keys binary, weights binary").dropDuplicates(["node"])


def similarity(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    """Weighted Jaccard similarity of two texts' elements."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    p, q = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(p[i], q[j]).sum())
    return shared / max(int(p.sum()) + int(q.sum()) - shared, 1)


def check(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """(a, b, good): whether the pair is similar enough."""
    one = lambda s: table.select(F.col("node").alias(s), F.col("keys").alias(f"k{s}"), F.col("weights").alias(f"w{s}"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(c).to_pylist() for c in ("ka", "wa", "kb", "wb"))
        good = [similarity(*x) >= least - 1e-12 for x in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])

    # elements are too large to repeat for salts: adaptive execution splits the rows of a hub in these joins
    met = pairs.join(one("a"), "a").join(one("b"), "b")
    return by_batch(met, work, "a binary, b binary, good boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component; labels spread along edges and jump along labels.

    The joins are on plain keys, one row a key on the side of the labels: adaptive execution splits what
    is hot, and nothing is copied for keys that are not.
    """
    both = stored(edges.unionAll(edges.select("b", "a")).toDF("node", "near").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        seen = both.join(labels.toDF("near", "l"), "near").groupBy("node").agg(F.min("l").alias("l"))
        least = labels.join(seen, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = least.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label"), "old")
        after = stored(after, "labels")
        labels = after.drop("old")
        if after.where("label != old").isEmpty():
            return labels


def grown(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, label) after new edges (a, b): known components are single nodes of what is left to connect."""
    if labels is None:
        return components(edges)
    heads = edges
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("label").alias("_l"))
        heads = heads.join(known, side, "left").withColumn(side, F.coalesce("_l", side)).drop("_l")
    joined = components(heads.where("a != b").select("a", "b").distinct())
    over = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label", "left")
    old = over.select("node", F.coalesce("_next", "label").alias("label"))
    return stored(old.unionAll(joined.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def hub_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): of each bucket's components a member against the most central one, another against one fixed by hash."""
    order = F.struct("score", "node")
    heads = placed.groupBy("bucket", "label").agg(F.max(order).alias("head"), F.max(F.struct(F.xxhash64("node"), "node")).alias("other"))
    heads = stored(heads.select("bucket", "head", "other"), "heads")
    hubs = heads.groupBy("bucket").agg(F.max("head").alias("hub"), F.max("other").alias("hub2"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = heads.join(hubs, "bucket")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = met.select(F.explode(F.array(pair(F.col("head.node"), F.col("hub.node")), pair(F.col("other.node"), F.col("hub2.node")))).alias("p"))
    return pairs.select("p.a", "p.b").where("a != b").distinct()


def cell_pairs(cell: list[tuple], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of a cell (rows of bucket, i, j, side, node, label, size, signature) that may be similar enough, and how many values agree."""
    bucket, i, j = cell[0][:3]
    _, _, _, side, _, label, size, signed = zip(*cell, strict=True)
    side, size, label = np.array(side), np.array(size), _numbers(label)
    signature = np.frombuffer(b"".join(signed), np.uint32).reshape(-1, SIZE)
    bands = bands_of(signature)
    a, b = np.triu_indices(len(cell), 1)
    live = (label[a] != label[b]) & ((side[a] != side[b]) | (j == -1 - i))
    live &= np.minimum(size[a], size[b]) >= (least - 1e-12) * np.maximum(size[a], size[b])
    a, b = a[live], b[live]
    shared = np.where(bands[a] == bands[b], bands[a], np.iinfo(np.int64).max).min(axis=1)
    a, b = a[shared == bucket], b[shared == bucket]
    agree = (signature[a] == signature[b]).sum(axis=1)
    return a[agree >= AGREE], b[agree >= AGREE], agree[agree >= AGREE]


def _numbers(labels: Iterable[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(x, len(number)) for x in labels])


def named_pairs(cell: list[tuple], least: float, likeliest: bool) -> list[tuple[bytes, bytes]]:
    """(a, b): nodes of the pairs of a cell, all or the likeliest of each two components."""
    a, b, agree = cell_pairs(cell, least)
    nodes, label = [row[4] for row in cell], _numbers(row[5] for row in cell)
    if likeliest:
        x, y = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        order = np.argsort(-agree, kind="stable")
        first = order[np.unique((x * len(cell) + y)[order], return_index=True)[1]]
        a, b = a[first], b[first]
    return [tuple(sorted((nodes[x], nodes[y]))) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def cell_mates(cell: list[tuple], least: float) -> list[tuple]:
    """(bucket, i, j, place, node, label, mates) of the members that have pairs; mates is a bit for each later place."""
    a, b, _ = cell_pairs(cell, least)
    met = np.zeros((len(cell), len(cell)), dtype=bool)
    met[a, b] = True
    bits = np.packbits(met, axis=1)
    return [(*cell[k][:3], k, *cell[k][4:6], bits[k].tobytes()) for k in np.flatnonzero(met.any(axis=0) | met.any(axis=1)).tolist()]


def overlaps(keys: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """What the elements of each two texts have in common (sum of the lesser weights), by products of 0-1 matrices for each step of weight."""
    n = len(keys)
    owner = np.repeat(np.arange(n), [len(k) for k in keys])
    _, column, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    weight = np.concatenate(weights).astype(np.int64)
    order = np.argsort(column, kind="stable")
    order = order[held[column[order]] > 1]
    owner, column, weight = owner[order], column[order], weight[order]
    out = np.zeros((n, n), dtype=np.int64)
    below = 0
    for level in np.unique(weight).tolist():
        live = weight >= level
        owner, column, weight = owner[live], column[live], weight[live]
        dense = np.cumsum(np.r_[False, column[1:] != column[:-1]])
        last = int(dense[-1]) + 1
        for at in range(0, last, COLUMNS):
            here = slice(*np.searchsorted(dense, [at, at + COLUMNS]))
            held_by = np.zeros((n, min(COLUMNS, last - at)), dtype=np.float32)
            held_by[owner[here], dense[here] - at] = 1
            out += (level - below) * (held_by @ held_by.T).astype(np.int64)
        below = level
    return out


def cell_links(cell: list[tuple], least: float) -> list[tuple[bytes, bytes]]:
    """Links that connect what the similar pairs of a cell (rows of bucket, i, j, place, node, label, mates, keys, weights) connect."""
    cell = list({row[3]: row for row in cell}.values())
    _, _, _, place, nodes, label, mates, keys, weights = zip(*cell, strict=True)
    keys, weights = [np.frombuffer(k, np.uint64) for k in keys], [np.frombuffer(w, np.uint32) for w in weights]
    met = np.unpackbits(np.frombuffer(b"".join(mates), np.uint8).reshape(len(cell), -1), axis=1)[:, list(place)].astype(bool)
    shared, size = overlaps(keys, weights), np.array([int(w.sum()) for w in weights])
    good = met & (shared / np.maximum(size[:, None] + size - shared, 1) >= least - 1e-12)
    up = list(range(len(cell)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    made, label = [], _numbers(label).tolist()
    for a, b in np.argwhere(good).tolist():
        x, y = find(label[a]), find(label[b])
        if x != y:
            up[x] = y
            made.append(tuple(sorted((nodes[a], nodes[b]))))
    return made


def open_cells(placed: DataFrame, signed: DataFrame) -> DataFrame:
    """(bucket, i, j, side, node, label, size, signature): members of buckets with several components, dealt out into cells.

    Buckets of two nodes are left out: hubs have tried these. In a large bucket the greatest component is
    shards of its own, which meet the shards of the others but not one another.
    """
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    shards = lambda n: F.ceil(n / SHARD).cast("int")
    large = F.col("n") > 2 * SHARD
    split = split.where("parts > 1 AND n > 2").select(
        "bucket", F.when(large, F.col("main.label")).alias("main"), F.when(large, shards(F.col("main.n"))).otherwise(0).alias("n_main"),
        F.when(large, shards(F.col("n") - F.col("main.n"))).otherwise(1).alias("n_rest"),
    )
    rows = placed.select("node", "bucket", "label").join(stored(split, "contested"), "bucket")
    inner = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("node", "bucket"), F.when(inner, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    to = lambda n, i, j: F.expr(f"transform(filter(sequence(0, {n}), k -> k < {n}), k -> struct(int({i}) AS i, int({j}) AS j))")
    met = F.concat(to("n_main", "shard", "k"), to("n_rest", "least(shard, k)", "-1 - greatest(shard, k)"))
    rows = rows.withColumns({"cells": F.when(inner, to("n_rest", "k", "shard")).otherwise(met), "side": F.when(inner, -1).otherwise(F.col("shard"))})
    cells = rows.join(signed, "node").withColumn("cell", F.explode("cells"))
    return cells.select("bucket", "cell.i", "cell.j", "side", "node", "label", "size", "signature")


def by_cell(cells: DataFrame, work: Callable[[list[tuple]], list[tuple]], schema: pa.Schema, told: str) -> DataFrame:
    """The rows that `work` makes of each cell (the rows of one bucket, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[tuple] = []
        made: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [()] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)
            made.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell and cell[0][:3] != row[:3]:
                    made += work(cell)
                    cell.clear()
                    if len(made) > 10_000:
                        yield rows()
                cell.append(row)
        if cell:
            made += work(cell)
        yield rows()

    return cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, told)


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_MATE = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("node", pa.binary()), ("label", pa.binary()), ("mates", pa.binary())])


def open_pairs(placed: DataFrame, signed: DataFrame, least: float, likeliest: bool) -> DataFrame:
    """(a, b): pairs of different components in a bucket, all or the likeliest of each two components in a cell."""
    return by_cell(open_cells(placed, signed), lambda cell: named_pairs(cell, least, likeliest), _PAIR, "a binary, b binary")


def open_links(placed: DataFrame, signed: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """(a, b): links among the components that share buckets, no more than a cell has members.

    Of a cell whose signatures allow pairs, the members of such pairs get their elements; every pair is
    checked there, and pairs are never rows. A cell's links connect what all its similar pairs connect.
    """
    mates = by_cell(open_cells(placed, signed), lambda cell: cell_mates(cell, least), _MATE, "bucket long, i int, j int, place int, node binary, label binary, mates binary")
    met = stored(mates, "mates").join(table, "node")
    met = met.select("bucket", "i", "j", "place", "node", "label", "mates", "keys", "weights")
    return by_cell(met, lambda cell: cell_links(cell, least), _PAIR, "a binary, b binary")


def contested(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than two nodes and several components; the others have nothing left to try."""
    many = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 AND low != high")
    return placed.join(many.select("bucket"), "bucket", "left_semi")


def classes(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """row, mark, doc_id, node, label (of the component) and class_id (its least doc_id) of every row."""
    sketched = stored(sketch(documents), "sketch")
    per_node = sketched.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"))
    first = stored(per_node, "nodes")
    reps = sketched.select("row", F.col("node").alias("its"), "bands").join(first.select("row", "node"), "row").where("its = node")
    banded = reps.select("node", F.explode("bands").alias("bucket")).distinct()
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(sizes, "bucket"), "members")
    scores = members.groupBy("node").agg(F.sum("n").alias("score"))
    members = stored(members.select("node", "bucket").join(scores, "node"), "members")
    wanted = first.select("row", "node").join(scores.select("node"), "node", "left_semi")
    table = stored(element_table(documents, wanted), "elements")
    labels, tried = None, None
    placed = members.withColumn("label", F.col("node"))
    while True:  # hubs; what they leave is checked cell by cell
        pairs = hub_pairs(placed)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        checked = stored(check(pairs, table, least), "checked", "8m")  # a pair brings the elements of both texts
        if checked.where("good").isEmpty():
            break
        tried = checked if tried is None else tried.unionAll(checked)
        labels = grown(labels, checked.where("good").select("a", "b"))
        after = placed.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = stored(contested(after), "members")
    left = stored(contested(placed).select("node").distinct(), "left")
    signed = sketched.select("node", "size", "signature").join(left, "node", "left_semi").dropDuplicates(["node"])
    found = stored(open_links(placed, stored(signed, "signed"), table, least), "links", "8m")
    if not found.isEmpty():
        labels = grown(labels, found.distinct())
    named = first.select("node", "doc_id", F.col("node").alias("label"))
    if labels is not None:
        named = first.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    per_node = named.drop("doc_id").join(ids, "label", "left")
    return sketched.select("row", "mark", "doc_id", "node").join(per_node, "node", "left")


def keep_one(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class, that of the least doc_id; all columns as they were."""
    row, mark, number = (fresh(documents.columns, c) for c in ("_row", "_mark", "_number"))
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "row", "mark")).alias("first")
    kept = classes(documents, least).groupBy("label").agg(first).select(F.col("first.row").alias(row), F.col("first.mark").alias(mark))
    joined = documents.withColumns({row: row_id(), mark: F.xxhash64("text")}).join(kept, [row, mark])
    numbered = joined.withColumn(number, F.row_number().over(Window.partitionBy(row, mark).orderBy(row)))
    return numbered.where(F.col(number) == 1).select(*documents.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "class_id")
