"""Decontamination against a brute-force search, and its edge cases."""

import hashlib
import random
import re

import pytest
from rankflow.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, T string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wanted}:
            for i in range(len(w) - size + 1):
                if owners := wanted.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Dé", "e5", "F"]
    text = lambda n: rng.choice([" ", "\n", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 4, 10, 12, 30]))) for i in range(rng.choice([0, 3, 12]))]
    items += [(99, None), (100, "..."), *items[:1]]
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(12)] + [(3, None), (None, "a b"), (4, "a")]
    long = [t for _, t in items if t and len(t) > 20]
    docs += [(50 + k, f"x {t} y {t.upper()}") for k, t in enumerate(long)]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [d.BLOCK_WORDS, 40])
def test_same_as_brute_force(spark, seed, block):
    docs, items = cases(seed)
    table = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.digest(d.find_contamination(table, bench, block_words=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    table = spark.createDataFrame([(1, "a b", "en", "s", 3, "x")], DOCS)
    assert d.digest(d.find_contamination(table, bench)).first().n_hit == 0
    assert d.find_contamination(table.where("false"), bench).count() == 0


def test_removal_keeps_clean_rows_and_all_columns(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [
        (1, "clean\n text", "en", "s", 11, "t"), (2, None, "en", None, None, None), (3, passage, "en", "s", 50, "t"),
        (4, f"one two {passage}, three " + "four " * 20, "en", "s", 1, "t"),
    ]
    table = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: tuple(r) for r in d.remove_contamination(table, bench).collect()}
    assert got[1] == rows[0] and got[2] == rows[1] and 3 not in got
    assert got[4][1] == "one two , three " + "four " * 20 and got[4][4] == len(got[4][1])


def test_removal_is_the_same_in_one_block_and_in_many(spark, monkeypatch):
    w = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w[5 * i : 5 * i + 12])) for i in range(6)], "item_id long, text string")
    rows = [(1, "a b " + " ".join(w[:37]) + " c" * 60), (2, " ".join([*w[:12], *w[25:37], *["c"] * 16])), (3, "x y"), (4, None)]
    table = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], DOCS)
    whole = {r.doc_id: r.text for r in d.remove_contamination(table, bench).collect()}
    assert whole == {1: "a b " + " c" * 60, 3: "x y", 4: None}
    monkeypatch.setattr(d, "BLOCK_WORDS", 48)
    assert d._blocks(bench, 48)[0] > 1
    assert {r.doc_id: r.text for r in d.remove_contamination(table, bench).collect()} == whole
