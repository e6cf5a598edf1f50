"""Resampling against a plain reading of its rules, and the CRC matrices against zlib."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from rankflow.llm import resample as r

SCHEMA = "doc_id long, text string, rank string, Weight string, _tie int"


def runs(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words)]


def plain(docs, target, least=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % r.BUCKETS
    s, t = np.zeros(r.BUCKETS, int), np.zeros(r.BUCKETS, int)
    for rows, count in ((docs, s), (target, t)):
        for _, text in rows:
            for f in runs(text)[1]:
                count[bucket(f)] += 1
    all_s, all_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log(((int(b) + 1) * (all_s + r.BUCKETS)) / ((int(a) + 1) * (all_t + r.BUCKETS)))) for a, b in zip(s, t)]
    out = []
    for key, text in docs:
        words, features = runs(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    place = {id(x): i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    return [(*x, place.get(id(x))) for x in out]


def some_docs():
    rng = random.Random(5)
    pool = ["un", "Deux", "trois", "ÇA", "ça", "x1", "日本", "a-b", "longer words", "\x85", "\x7f", "É"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 3, 19, 20, 40, 300])))) for i in range(150)]
    docs += [(None, None), (None, "only " * 30), (None, "only " * 30), (7, docs[7][1]), (900, "x" * 3000 + " y " + "é" * 700)]
    docs += [(901, "")] + [(1000 + i, "same text again and " * 8) for i in range(40)]
    return docs


def test_rank_is_the_plain_reading(spark):
    docs, target = some_docs(), [(1, "un deux trois ÇA"), (2, None), (3, "same text")]
    table = spark.createDataFrame([(*d, "x", "y", 3) for d in docs], SCHEMA)
    wanted = spark.createDataFrame(target, "item_id long, text string")
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(x[c] for c in names) for x in r.rank(table, wanted, percent=20).collect()), key=str)
    assert got == sorted(plain(docs, target, percent=20), key=str)
    drawn = r.draw(table, wanted, percent=20)
    assert drawn.columns == table.columns
    assert {x.doc_id for x in drawn.collect()} == {x[0] for x in got if x[5] is not None}
    assert r.rank(table.where("false"), wanted).count() == 0
    assert r.rank(table, wanted.where("false")).count() == len(docs)


def test_sql_is_the_plain_reading():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    docs, target = some_docs(), [(1, "un deux trois ÇA"), (2, None)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", target)
    got = sorted(con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({r.SQL.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)})").fetchall(), key=str)
    assert got == sorted(((x[0], *x[2:]) for x in plain(docs, target)), key=str)


@pytest.mark.parametrize("piece", [1, 7, 30_000])
def test_pieces_and_long_words(monkeypatch, piece):
    monkeypatch.setattr(r, "PIECE", piece)
    texts = [t for _, t in some_docs()]
    flat, features, words = r.buckets_of(*r.flat_bytes(pa.array(texts).slice(3)))
    expected = [runs(t) for t in texts[3:]]
    assert words.tolist() == [len(w) for w, _ in expected] and features.tolist() == [len(f) for _, f in expected]
    assert flat.tolist() == [zlib.crc32(f.encode()) % r.BUCKETS for _, fs in expected for f in fs]
