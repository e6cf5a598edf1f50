"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed from its protobuf wire format; its normaliser (character map, extra
spaces, dummy prefix), the metaspace marker, the unigram scores or the merge order of a BPE model,
and byte fallback are rebuilt as a tokenizer of the tokenizers library. Batches are encoded and
decoded with as many threads as a task has cores. `parity` holds every row's ids against those of
the sentencepiece library itself, `round_trip` says whether decoding gives the text back.

A BPE vocabulary in which the marker only leads a piece cannot merge across the start of a marked
word. Where the normaliser changes nothing else either, texts are cut there and each distinct word
of a portion is encoded once; otherwise, and for texts that hold the marker, texts are encoded whole.

Null texts have null ids, empty texts none; neither lacks parity or the round trip. A text that
holds the marker itself, or starts with spaces that the normaliser drops, does not come back the
same. Repeated rows and null doc_ids are encoded each. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from rankflow.llm.common import by_batch, fresh

#: Default model file; its place is a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Fixed values of the format: model types, piece types, field numbers.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        field, kind = key >> 3, key & 7
        if kind == 0:
            yield field, number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield field, data[at : at + size]
            at += size
        elif kind == 2:
            size = number()
            yield field, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for field, value in wire(data):
            if field == 1:
                part = dict(wire(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                self.pieces.append((part.get(1, b"").decode(), score, part.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire(value))
            elif field == 3:
                norm = dict(wire(value))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if trainer.get(24, 0):
            raise ValueError("white space as suffix is not supported")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that merge, the best-scored result first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        found = []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in ids and right in ids:
                    found.append((-self.pieces[i][1], i, ids[left], ids[right], left, right))
        return [x[4:] for x in sorted(found)]

    def by_word(self) -> bool:
        """Whether encoding the marked words of a text one by one gives the text's ids."""
        leading = not any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces)
        return self.kind == BPE and leading and self.escape and not self.charsmap and not self.trim

    def tokenizer(self, dummy_prefix: bool = True) -> Tokenizer:
        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            unknown = self.pieces[self.unknown][0]
            core = models.BPE(vocabulary, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        elif self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models")
        made = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        made.normalizer = normalizers.Sequence(steps)
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        made.decoder = decoders.Sequence([*back, *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return made


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """A model's tokenizers; encodes lists of texts into one run of ids and the size of each text's part."""

    def __init__(self, data: bytes, threads: int = 1):
        self.model, self.threads = (model := Model(data)), threads
        self.words = None
        if model.by_word():
            # spaces become the marker once a text, not once a word
            self.words = model.tokenizer(dummy_prefix=False)
            self.words.normalizer = None
        self.lead = " " if model.dummy_prefix else ""
        # bytes of each id; None where the library has to decide
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER, UNUSED) else None
            for p, _, kind in model.pieces
        ]
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)

    @cached_property
    def whole(self) -> Tokenizer:
        return self.model.tokenizer()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None or any(MARK in t for t in texts):
            return _joined([e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)])
        found = [WORD.findall((self.lead + t).replace(" ", MARK) if t else t) for t in texts]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        known = pa.array(itertools.chain.from_iterable(found), pa.string()).dictionary_encode()
        words = known.indices.to_numpy()
        pieces, sizes = _joined(self.word_ids(known.dictionary.to_pylist()))
        long = sizes[words]  # pieces of each word of the texts
        begin = (np.cumsum(sizes) - sizes)[words]
        upto = np.cumsum(long)
        ids = pieces[np.repeat(begin - (upto - long), long) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.r_[0, upto][np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Of marked words; with one thread straight from the model, without the batch's records of offsets."""
        if self.threads > 1:
            return [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        tokenize = self.words.model.tokenize
        return [[t.id for t in tokenize(w)] for w in words]

    def decode(self, lists: list[list[int]]) -> list[str]:
        """The pieces' bytes in a row; the library decodes what these are no whole text of (special ids, cut characters)."""
        out: list[str | None] = []
        for ids in lists:
            try:
                text = b"".join(map(self.bytes.__getitem__, ids)).decode()
                out.append(text[1:] if self.lead and text.startswith(" ") else text)
            except (TypeError, UnicodeDecodeError):
                out.append(self.whole.decode(ids, skip_special_tokens=False))
        return out


#: A word with the markers before it, or markers at the end.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


_ready: dict[int, Codec] = {}


def _codec(data: bytes, threads: int) -> Codec:
    """Built once a worker, which has `threads` cores."""
    key = hash(data)
    if key not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        _ready[key] = Codec(data, threads)
    return _ready[key]


def _threads(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.task.cpus", "1"))


#: Characters encoded at a time, so that the library's intermediate results stay small.
AT_ONCE = 3 << 20


def _portions(texts: list[str]) -> Iterator[slice]:
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= AT_ONCE:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(documents: DataFrame, model: str = MODEL, verify: bool = True) -> DataFrame:
    """All columns but text, and: ids, n_tokens, round_trip, and with `verify` parity."""
    spark = documents.sparkSession
    shared, threads = spark.sparkContext.broadcast(read_model(model)), _threads(spark)
    names: dict[str, str] = {}
    taken = [c for c in documents.columns if c.lower() != "text"]
    for name in ("ids", "n_tokens", "round_trip", *(["parity"] if verify else [])):
        names[name] = fresh([*taken, *names.values()], name)
    kinds = {"ids": "array<int>", "n_tokens": "int", "round_trip": "boolean", "parity": "boolean"}
    told = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in taken), *(f"`{names[n]}` {kinds[n]}" for n in names)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared.value, threads)
        given = batch.column("text").to_pylist()
        texts = [t or "" for t in given]
        flat, sizes, back, same = [], [], [], []
        for part in _portions(texts):
            some = texts[part]
            ids, counts = codec.encode(some)
            lists = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            back += [a == b for a, b in zip(codec.decode(lists), some, strict=True)]
            if verify:
                same += [a == b for a, b in zip(codec.own.encode(some, num_threads=threads), lists, strict=True)]
            sizes += counts.tolist()
            flat.append(ids.astype(np.int32))
        ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
        mask = pa.array([t is None for t in given])
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=mask)
        made = {"ids": lists, "n_tokens": pa.array(sizes, pa.int32()), "round_trip": pa.array(back), "parity": pa.array(same)}
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in taken), *(made[n] for n in names)], [*taken, *names.values()])

    return by_batch(documents, work, told)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of the column of ids (null for null)."""
    spark = encoded.sparkSession
    shared, threads = spark.sparkContext.broadcast(read_model(model)), _threads(spark)
    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{to}` string"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(ids).to_pylist()
        texts = _codec(shared.value, threads).decode([x or [] for x in lists])
        said = pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, said], [*batch.schema.names, to])

    return by_batch(encoded, work, told)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip", "parity")
