"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and code points from 0x80 up.
An item of ten or more words guards each window of ten of its words; a shorter item guards
itself as a whole; an item without words guards nothing.

The automaton of a block of items (at most `BLOCK_WORDS` words, so its broadcast has a fixed
bound; a larger benchmark takes several passes, one a block) reads a document's words as a
stream and tracks the longest match that ends at each word. Where that match is at least as
long as a window, the words it covers are hit. Words whose pair with the next word stands in
no item are skipped without visiting the automaton: no match crosses them.

Null texts have no words. Repeated doc_ids stay separate rows. Repeated item_ids count once.
An empty benchmark hits nothing; an empty document table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankflow.llm.common import by_batch, fresh

#: Words of an item that make a window.
WINDOW = 10
#: Most words of the items in one broadcast automaton (about 200 bytes each).
BLOCK_WORDS = 2_000_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows each state stands for."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = sorted({str(i) for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        pairs, self.single = set(), set()
        self.shortest = window
        sequences = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if words:
                sequences.append((number[str(item)], words))
                self._add(words)
                pairs.update(zip(words, words[1:], strict=False))
                self.shortest = min(self.shortest, len(words))
        # (state, length) of a window -> the items that have it
        self.windows: dict[int, list[tuple[int, set[int]]]] = {}
        for k, words in sequences:
            size = min(window, len(words))
            for state in self._ends(words, size):
                spans = self.windows.setdefault(state, [])
                for length, owners in spans:
                    if length == size:
                        owners.add(k)
                        break
                else:
                    spans.append((size, {k}))
        # nearest state at or above on the suffix links that stands for a window
        self.above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[state] = state if state in self.windows else self.above[self.link[state]]
        self.base = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)

    def _add(self, words: list[int]) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for w in words:
            if w in step[last]:
                q = step[last][w]
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def _ends(self, words: list[int], size: int) -> set[int]:
        """States that stand for the stretches of `size` words."""
        found, state, matched = set(), 0, 0
        for w in words:
            state, matched = self.step[state][w], matched + 1
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
                matched = self.length[state]
            if matched >= size:
                found.add(state)
        return found

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items whose windows occur."""
        n = len(words)
        mask = np.zeros(n + 1, dtype=np.int32)
        owners: set[int] = set()
        if not n or not len(self.windows):
            return mask[:n] > 0, owners
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=n)
        if len(self.pairs):
            keys = ids[:-1] * self.base + ids[1:]
            at = np.searchsorted(self.pairs, keys)
            at[at == len(self.pairs)] = 0
            known = self.pairs[at] == keys
        else:
            known = np.zeros(n - 1, dtype=bool)
        # stretches in which each pair of neighbours stands in some item
        edge = np.flatnonzero(~known)
        begin, end = np.r_[0, edge + 1], np.r_[edge + 1, n]
        far = (end - begin >= self.shortest) & (ids[begin] > 0)
        step, link, length, above, windows = self.step, self.link, self.length, self.above, self.windows
        for b, e in zip(begin[far].tolist(), end[far].tolist(), strict=True):
            state = matched = 0
            for i, w in enumerate(ids[b:e].tolist(), b):
                while state and w not in step[state]:
                    state = link[state]
                    matched = length[state]
                state = step[state].get(w, 0)
                matched = matched + 1 if state else 0
                s = above[state] if state else -1
                while s > 0:
                    for size, who in windows[s]:
                        if size <= matched:
                            mask[i - size + 1] += 1
                            mask[i + 1] -= 1
                            owners |= who
                    s = above[link[s]]
        return np.cumsum(mask[:n]) > 0, owners


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[int, Iterator[list[tuple[object, str | None]]]]:
    """How many blocks of a bounded number of words (a longer item is a larger block), and their items, fetched one block at a time."""
    gaps = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = F.size(F.split(F.coalesce("text", F.lit("")), gaps))
    items = benchmark.select("item_id", "text", words.cast("long").alias("_n"))
    total = items.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, -(-2 * total // block_words)) if total > block_words else 1
    numbered = items.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    return parts, (
        [(r.item_id, r.text) for r in numbered.where(F.col("_b") == b).select("item_id", "text").collect()]
        for b in range(parts)
    )


SPANS = "array<struct<begin: bigint, end: bigint>>"


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row a document: doc_id, n_words, spans (word ranges that are hit, end exclusive), item_ids (sorted as strings)."""
    spark = documents.sparkSession
    parts, blocks = _blocks(benchmark, block_words)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts > 1:  # a row's results of several passes meet again by its key and text
        docs = docs.withColumn("t", F.xxhash64("text"))
    keys = [c for c in docs.columns if c != "text"]
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = {"n_words": pa.int64(), "spans": span, "item_ids": pa.list_(pa.string())}
    told = ", ".join([*(f"{k} long" for k in keys), f"n_words long, spans {SPANS}, item_ids array<string>"])
    schema = pa.schema([*((k, pa.int64()) for k in keys), *kinds.items()])

    def one_pass(items) -> DataFrame:
        shared = spark.sparkContext.broadcast(Automaton(items, window))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            machine, counts, spans, owned = shared.value, [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                mask, owners = machine.hits(words)
                counts.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in stretches(mask)])
                owned.append(sorted(machine.ids[k] for k in owners))
            made = [pa.array(x, t) for x, t in zip((counts, spans, owned), kinds.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], schema=schema)

        return by_batch(docs, work, told)

    passes = [one_pass(block) for block in blocks]
    if len(passes) == 1:
        return passes[0]
    together = functools.reduce(DataFrame.unionAll, passes).groupBy(*keys).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        (F.count("*") / len(passes)).cast("int").alias("copies"),
    )
    merged = F.expr(
        f"aggregate(spans, cast(array() as {SPANS}), (a, x) -> if(size(a) > 0 and x.begin <= element_at(a, -1).end, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, "
        "'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
    )
    again = F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    return together.select("doc_id", "n_words", merged.alias("spans"), "item_ids", again).drop("copy")


def stretches(mask: np.ndarray) -> list[list[int]]:
    """Begin and end (exclusive) of the runs that are set."""
    return np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])).reshape(-1, 2).tolist()


def remove_contamination(documents: DataFrame, benchmark: DataFrame, most_cover: float = 0.5, window: int = WINDOW) -> DataFrame:
    """Documents without the benchmark's passages: hit words and what stands between them go.

    A document of which at least `most_cover` of the words are hit goes whole. Documents
    without hits are left byte for byte. All columns of `documents` stay. Every block of the
    benchmark marks its hits on the text as it came; texts are cut once, by all marks.
    """
    spark = documents.sparkSession
    hits = fresh(documents.columns, "_hits")
    result = documents.withColumn(hits, F.lit(None).cast("array<bigint>"))
    for block in _blocks(benchmark, BLOCK_WORDS)[1]:
        result = _mark(result, spark.sparkContext.broadcast(Automaton(block, window)), hits)
    return _strip(result, hits, most_cover)


def _mark(documents: DataFrame, shared, hits: str) -> DataFrame:
    """Begins and ends of the stretches that a block hits go to the column `hits`."""
    at, to = documents.columns.index("text"), documents.columns.index(hits)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marked = []
        for text, old in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist(), strict=True):
            mask, _ = shared.value.hits(words_of(text))
            marked.append([*(old or []), *(x for pair in stretches(mask) for x in pair)])
        return batch.set_column(to, batch.schema.field(to), pa.array(marked, batch.schema.field(to).type))

    return by_batch(documents, work, documents.schema)


def _strip(documents: DataFrame, hits: str, most_cover: float) -> DataFrame:
    at, marks = documents.columns.index("text"), documents.columns.index(hits)
    size = "n_chars" if "n_chars" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for value, marked in zip(batch.column(at), batch.column(marks), strict=True):
                text, gone = strip_text(value.as_py(), marked.as_py(), most_cover)
                texts.append(text)
                keep.append(not gone)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if size:
                k = batch.schema.get_field_index(size)
                old, new = batch.column(at).to_pylist(), batch.column(k).to_pylist()
                counts = [n if a == b else len(b) for a, b, n in zip(old, texts, new, strict=True)]
                out = out.set_column(k, batch.schema.field(k), pa.array(counts, batch.schema.field(k).type))
            yield out.drop_columns([hits]).filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.drop(hits).schema)


def strip_text(text: str | None, marked: list[int], most_cover: float) -> tuple[str | None, bool]:
    """The text without its hit words, and whether the whole document goes."""
    if not marked:
        return text, False
    mask = np.zeros(len(words_of(text)), dtype=bool)
    for a, b in zip(marked[::2], marked[1::2], strict=True):
        mask[a:b] = True
    if mask.mean() >= most_cover:
        return "", True
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    places = stretches(np.frombuffer(folded, dtype=np.uint8) != 32)
    kept, last = [], 0
    for a, b in stretches(mask):
        kept.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    kept.append(raw[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass"), False


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from the operator's spans and items."""
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.begin)"), F.lit(0)).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
word AS (
  SELECT kind, rid, id, len(ws) AS n, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w
  FROM (SELECT kind, rid, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low)),
size AS (SELECT DISTINCT least(n, 10) AS s FROM word WHERE kind = 'i'),
win AS (
  SELECT kind, rid, id, n, pos, s, list_aggregate(list_slice(ahead, 1, s), 'string_agg', ' ') AS win
  FROM (SELECT *, list(w) OVER (PARTITION BY kind, rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM word), size
  WHERE len(ahead) >= s AND (kind = 'd' OR s = least(n, 10))),
guard AS (SELECT DISTINCT s, win, id AS item FROM win WHERE kind = 'i'),
found AS (SELECT rid, pos, s, item FROM win JOIN guard USING (s, win) WHERE kind = 'd'),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + s)) AS p FROM found) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item::VARCHAR AS item FROM found) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_words FROM word WHERE kind = 'd' GROUP BY rid)
SELECT id AS doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN n USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
WHERE kind = 'd'
"""
