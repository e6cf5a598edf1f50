"""The stages one after another, against brute force on a small table."""

import duckdb
import corpus_pipeline as c
import sentencepiece
from rankflow.llm import pieces, quality
from rankflow.llm import suffixes as s
from rankflow.llm.common import table
from test_decontaminate import words
from test_near import brute as near_classes

FOLDER = "/root/testdata/sf0.001"


def without_repeats(rows):
    """{doc_id: text} without bytes in strings that a smaller doc_id also has; rows are (doc_id, text)."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        b = text.encode()
        for i in range(len(b) - s.MATCH + 1):
            first.setdefault(b[i : i + s.MATCH], doc)
    for doc, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - s.MATCH + 1):
            if first[b[i : i + s.MATCH]] < doc:
                gone[i : i + s.MATCH] = b"\1" * s.MATCH
        out[doc] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in c.STAGES[:4]:
        before = texts
        docs = c.store(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert set(texts) == good and all(before[d] == t for d, t in texts.items())
        if name == "minhash_near_dedup":
            pairs, _ = near_classes(sorted(before.items()))
            assert set(texts) == {least for _, least in pairs} and all(before[d] == t for d, t in texts.items())
        if name == "suffix_array_dedup":
            assert texts == without_repeats(list(before.items()))
        if name == "benchmark_decontamination":
            guard = set()
            for r in table(spark, FOLDER, "benchmark").collect():
                w = words(r.text)
                guard |= {(*w[i : i + 10],) for i in range(max(1, len(w) - 9))} - {()}
            hits = {d for d, t in before.items() for w in [words(t)] for i in range(len(w)) if (*w[i : i + 10],) in guard}
            assert all(texts[d] == before[d] for d in set(before) - hits)
            assert all(d not in texts or len(texts[d]) < len(before[d]) for d in hits)
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = c.STAGES[4][1](spark, docs, FOLDER).collect()
    assert len(coded) == len(texts) and all(r.ids == own.encode(texts[r.doc_id]) and r.parity for r in coded)


def test_stages_on_empty_and_null_rows(spark):
    schema = table(spark, FOLDER, "documents").schema
    for rows in ([], [(None, None, None, None, None)] * 2):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in c.STAGES[:4]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == schema.names
        assert c.STAGES[4][1](spark, docs, FOLDER).count() == 0
