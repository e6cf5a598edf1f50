"""Removed bytes against brute force, on texts with repeats of every length around the limits."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rankflow.llm import suffixes as s
from rankflow.llm.common import table

SCHEMA = "doc_id long, text string, Spans string, kept int, n_chars long"


def brute(rows):
    first = {}
    texts = [(t or "").encode() for _, t in rows]
    rank = lambda d: -(10**9) if d is None else d
    for (doc, _), b in zip(rows, texts, strict=True):
        for i in range(len(b) - s.MATCH + 1):
            w = b[i : i + s.MATCH]
            first[w] = min(first.get(w, rank(doc)), rank(doc))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - s.MATCH + 1):
            if first[b[i : i + s.MATCH]] < rank(doc):
                gone[i + 1 : i + 1 + s.MATCH] = True
        kept = bytes(c for c, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((doc, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdefgé ", k=n))
    passages = [noise(n) for n in (30, 48, 49, 50, 51, 55, 69, 70, 71, 90, 200, 800)] + ["z" * 120, "xy" * 60, "abc" * 40]
    rows = []
    for i in range(80):
        parts = [noise(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [p[a:] if rng.random() < 0.3 else p, noise(rng.choice([0, 1, 30, 60]))]
        rows.append((i * 3 - 40, "".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (600, None), (601, ""), (602, "q" * 49), (603, "q" * 60), (700, "q" * 100), (None, passages[10])]
    rows += [(700, passages[11]), (700, passages[11]), (701, noise(30_000) + passages[11])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x", 1, 5) for d, t in rows], SCHEMA)
    found = s.find_repeats(frame)
    assert found.columns == ["doc_id", "Spans", "kept", "n_chars", "n_bytes", "spans_2", "kept_2"]
    plain = found.select("doc_id", "n_bytes", F.col("spans_2").alias("spans"), F.col("kept_2").alias("kept"))
    assert sorted(map(tuple, s.digest(plain).collect()), key=str) == brute(rows)


def test_rows_keep_their_columns(spark):
    text = "é" * 30 + "unique start of the second"
    rows = [(1, "é" * 30, "a", 1, 30), (2, text, None, None, 56), (None, None, None, None, None)]
    got = {r.doc_id: tuple(r) for r in s.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == rows[0] and got[2] == (2, text[30:], None, None, 26) and got[None][1] == ""
    assert s.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, s.digest(s.find_repeats(docs)).collect()), key=str) == brute(rows)


def test_cover_and_coding():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))
    for dtype in (np.uint32, np.uint64):
        keys = np.unique(np.random.default_rng(1).integers(0, np.iinfo(dtype).max, 5000, dtype=dtype))
        assert (s.decode(s.encode(keys), dtype) == keys).all()
