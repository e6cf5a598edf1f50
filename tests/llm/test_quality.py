"""Counts of a text against a plain reading of the rules; verdicts against DuckDB."""

import random
import re
from collections import Counter

import duckdb
import pytest
from rankflow.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Row_Key string"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many, hit = Counter(wins), set()
    for i, w in enumerate(wins):
        if many[w] > 1:
            hit.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(lines), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def some_texts(seed):
    rng = random.Random(seed)
    pick = lambda v, n: rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choices(v, k=n))
    out = [None, "", " \n", "é b c", "x" * 5000, "\x1c a"]
    for _ in range(60):
        out.append(pick(["a", "bb", "ccé", "#", "<d>"][: rng.randint(1, 5)], rng.choice([0, 3, 7, 8, 9, 40, 200])))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_counts(seed):
    for text in some_texts(seed):
        assert q.counts_of(text) == plain(text)


def test_same_as_sql_with_hot_and_small_groups(spark):
    rng = random.Random(3)
    rows = [(i, t, "en", "hot", 0, "x") for i, t in enumerate(some_texts(1) + some_texts(2) + some_texts(7))]
    rows += [(i, " ".join(rng.choices(["un", "deux", "trois"], k=30 + i % 9)), "fr", f"s{i % 3}", 0, "x") for i in range(120)]
    rows += [(i, "* ".join(["q"] * 40), None, None, None, None) for i in range(2)] + [(None, "a b", "xx", None, 0, "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", table.drop("Row_Key").toPandas())
    names = [c[0] for c in con.execute(q.SQL).description]
    got = sorted((tuple(r[c] for c in names) for r in q.judge(table).collect()), key=str)
    assert got == sorted(map(tuple, con.execute(q.SQL).fetchall()), key=str)
    kept = q.keep_good(table)
    assert kept.columns == table.columns and kept.count() == sum(r[names.index("kept")] for r in got)
    assert q.judge(table.where("false")).count() == 0
