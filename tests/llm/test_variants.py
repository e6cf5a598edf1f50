"""Spelling variants against all pairs, and the hashes of edits against edits spelled out."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from rankflow.llm import variants as v

SCHEMA = "doc_id long, text string, word string, Hash long"


def low(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    known = {w: n for w, n in count.items() if n >= 3}
    rows = {}
    for w, n in known.items():
        others = [(-known[o], o) for o in known if near(w, o)]
        form = min(others)[1] if others and -min(others)[0] >= 2 * n else None
        rows[w] = [n, len(others), form, known[form] if form else None]
    out = []
    for w, row in rows.items():
        root = w
        while rows[root][2]:
            root = rows[root][2]
        out.append((w, *row, root))
    return sorted(out, key=str)


def some_docs():
    rng = random.Random(11)
    stems = ["colour", "color", "colours", "coloured", "éclair", "Éclair", "eclair", "aaaaa", "aaaaaa", "naïveté", "x" * 90, "x" * 89 + "y", "ÿøøøøþ"]
    docs = []
    for i in range(260):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "Z", "é", w[at] * 2]) + w[at + 1 :]
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return docs + [(None, None), (None, "colour colour"), (5, ""), (3, docs[3][1]), (3, docs[3][1])]


@pytest.mark.parametrize("slots", [1 << 21, 16])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, slots):
    monkeypatch.setattr(v, "SLOTS", slots)  # 16 blocks: several rounds
    docs = some_docs()
    table = spark.createDataFrame([(*d, "w", 1) for d in docs], SCHEMA)
    got = v.group(v.observed(table, noise=97))
    names = ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == plain(docs)
    assert v.group(v.observed(table.where("false"))).count() == 0


def test_sql_is_the_plain_reading():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", some_docs())
    names = "word, n, n_near, form, form_n, root"
    assert sorted(con.execute(f"SELECT {names} FROM ({v.SQL})").fetchall(), key=str) == plain(some_docs())


@pytest.mark.parametrize("word", ["abcde", "aabbb", "zéçÿa", "q" * 70])
def test_hashes_of_edits(word):
    rows = np.frombuffer(word.encode("latin-1") * 2, np.uint8).reshape(2, -1)
    seen = set()
    for which, at, letter, hashes in v.edits(rows):
        if not len(which):
            continue
        edited = word[:at] + (chr(letter) if letter >= 0 else "") + word[at + 1 :]
        spelled = np.frombuffer(edited.encode("latin-1"), np.uint8).reshape(1, -1)
        assert sorted(which.tolist()) == [0, 1] and (hashes == v.raw_hash(spelled)[0]).all()
        assert edited not in seen
        seen.add(edited)
    letters = [chr(c) for c in v.LETTERS]
    assert seen == {word[:i] + word[i + 1 :] for i in range(len(word))} | {
        word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters if c > word[i]
    }


def test_a_chain_of_forms(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {(r.word, r.root) for r in v.roots(chain).collect()} == {(f"w{i}", "w37") for i in range(37)}
