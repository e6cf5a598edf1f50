"""Ids against the sentencepiece library: the given BPE model, and unigram models written here."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from rankflow.llm import pieces as p

TEXTS = [
    "", " ", "a  b", "  lead", "tail  ", "\n\n x\ty", "é😀日本 café", "<s> </s> <unk> <0x0A>", "aaaaaaa", "    ", "x　y", "abcbcabc" * 50, "▁x ▁", "a b" * 40_000,
]


def field(number, kind, value):
    body = value if kind != 2 else bytes(_varint(len(value))) + value
    return bytes(_varint(number << 3 | kind)) + (bytes(_varint(value)) if kind == 0 else body)


def _varint(n):
    while n > 127:
        yield n & 127 | 128
        n >>= 7
    yield n


def unigram(trim, prefix):
    """A small unigram model in the format of the files."""
    rng = random.Random(4)
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    known = dict.fromkeys(["▁", "a", "b", "c", "▁a", "▁b", "ab", "ca", "abc", "▁cab", "é", "a▁b"])
    made += [(w, -1.0 - 9 * rng.random(), 1) for w in known]
    out = b""
    for piece, score, kind in made:
        out += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, kind))
    out += field(2, 2, field(3, 0, 1) + field(35, 0, 1) + field(40, 0, 0) + field(41, 0, 1) + field(42, 0, 2))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, prefix) + field(4, 0, trim) + field(5, 0, 1))


def random_texts(letters, n=300):
    rng = random.Random(9)
    return ["".join(rng.choices(letters, k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]


def same(data, texts):
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = p.Codec(data)
    for some in (texts, [t for t in texts if p.MARK not in t]):
        ids, counts = codec.encode(some)
        at = 0
        for text, n in zip(some, counts, strict=True):
            assert ids[at : at + n].tolist() == own.encode(text), text[:60]
            at += n
        assert at == len(ids)


def test_bpe_parity():
    assert p.Codec(p.read_model()).words is not None
    same(p.read_model(), TEXTS + random_texts("ab c\n éthion,.") + random_texts("the and of  ing"))


@pytest.mark.parametrize("trim", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_unigram_parity(trim, prefix):
    same(unigram(trim, prefix), random_texts("abc") + random_texts("aabbcc  éz") + ["", "a  b ", " x"])


def test_decoding_parity():
    for data in (p.read_model(), unigram(0, 1), unigram(0, 0)):
        own, codec = sentencepiece.SentencePieceProcessor(model_proto=data), p.Codec(data)
        rng = random.Random(3)
        lists = [own.encode(t) for t in TEXTS + random_texts("abcé日 \n")]
        lists += [rng.choices(range(3, own.vocab_size()), k=20) for _ in range(50)]
        assert codec.decode(lists) == codec.whole.decode_batch(lists, skip_special_tokens=False)
        assert codec.decode(lists[:300]) == own.decode(lists[:300])


def test_frames(spark):
    rows = [(i, t, "s", i, None) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (0, "", "again", 1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, IDS string, n_tokens long, n_chars long")
    coded = p.encode(table)
    assert coded.columns == ["doc_id", "IDS", "n_tokens", "n_chars", "ids_2", "n_tokens_2", "round_trip", "parity"]
    got = p.decode(coded, ids="ids_2").collect()
    assert len(got) == len(rows) and all(r.parity for r in got)
    for r, (_, text, *_) in zip(got, rows, strict=True):
        assert (r.text == text) == (r.round_trip if text is not None else True) and r.round_trip == (p.MARK not in (text or ""))
        assert r.ids_2 is None if text is None else len(r.ids_2) == r.n_tokens_2
    assert p.encode(table.where("false")).count() == 0


def test_words_need_no_normaliser_and_threads_change_nothing():
    texts = TEXTS + random_texts("the  \n日é and") + ["", " ", "   ", "a  b   ", "\n \n"]
    texts = [t for t in texts if p.MARK not in t]
    own = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
    for threads in (1, 2):
        codec = p.Codec(p.read_model(), threads)
        assert codec.words.normalizer is None and "whole" not in vars(codec)
        ids, counts = codec.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == own.encode(texts)
        assert "whole" not in vars(codec)  # built only where texts are encoded whole
