"""Signatures, similarities and classes against brute force."""

import random
from collections import Counter

import numpy as np
from rankflow.llm import near
from rankflow.llm.common import table
from rankflow.llm.decontaminate import words_of

SCHEMA = "doc_id long, text string, NODE string, label string, bucket int"


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(rows):
    """Least doc_id of each row's connected component."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = words_of(rows[i][1]) == words_of(rows[j][1]) if bags[i] else (rows[i][1] or "") == (rows[j][1] or "")
            if same or bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                up[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(doc, least[find(i)]) for i, (doc, _) in enumerate(rows)], len(ids)


def corpus(seed):
    """Groups around a base, whose members are at 0.8 or more of it but often not of each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for size in (1, 1, 2, 3, 30, 60):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        rows.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 70))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n"]).join(copy))
            if rng.random() < 0.3:
                rows.append(rows[-1].upper())
    rows += ["x y", "X, y!", "x y z", "", None, "!!!", "!!!", "a " * 50, "a " * 60, "a " * 45, "w" * 200_000]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)] + [(None, "x y"), (None, "only null"), (3, "another three " * 3), (3, "unlike the rest in all")]


def test_signature_agreement_is_the_similarity():
    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(40)]
    for _ in range(5):
        a = rng.choices(words[:30], k=300)
        b = a[:200] + rng.choices(words, k=150)
        x, y = (near.shingles(w, {}) for w in (a, b))
        x, y = x % np.uint64(60), y % np.uint64(60)  # many repeats: the weights matter
        want = jaccard(Counter(x.tolist()), Counter(y.tolist()))
        both = [near.signatures([near.mix(h + np.uint64(s << 20)) for h in (x, y)]) for s in range(40)]
        got = np.mean([s[0] == s[1] for s in both])
        assert abs(got - want) < 4 * (want * (1 - want) / (40 * near.SIZE)) ** 0.5 + 0.01
    assert (near.signatures([x[:1], y])[0] > 0).all() and not near.signatures([x[:0]]).any()


def test_classes(spark):
    for seed in range(2):
        rows = corpus(seed)
        frame = spark.createDataFrame([(i, t, "n", "l", 1) for i, t in rows], SCHEMA)
        want, n = brute(rows)
        assert sorted(map(tuple, near.digest(near.classes(frame)).collect()), key=str) == sorted(want, key=str)
    kept = near.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == n
    assert near.classes(frame.where("false")).count() == 0 and near.keep_one(frame.where("false")).count() == 0


def test_classes_of_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, near.digest(near.classes(docs)).collect())) == sorted(brute(rows)[0])


def test_a_doubled_sentence_keeps_the_darts():
    rng = random.Random(9)
    for n in (200, 1000):
        plain = [f"{rng.random()}".encode() for _ in range(n)]
        doubled = [*plain[:100], *plain[90:100], *plain[100:]]
        hashes = [near.shingles(w, {}) for w in (plain, doubled)]
        assert len(set(hashes[0].tolist())) == len(hashes[0]) and len(set(hashes[1].tolist())) < len(hashes[1])
        want = jaccard(Counter(hashes[0].tolist()), Counter(hashes[1].tolist()))
        a, b = near.signatures(hashes)
        assert want > 0.9 and abs(np.mean(a == b) - want) < 0.1
        x, y = near.bands_of(near.signatures(hashes))
        assert (x == y).any()


def test_links_that_no_hub_has(spark):
    rng = random.Random(4)
    more = lambda n: [f"{rng.random()}"[2:] for _ in range(n)]
    words = more(340)
    rows = [" ".join(words[20 * k : 20 * k + 202]) for k in range(6)]  # a chain: 0.82 to the next, 0.66 to the one after
    common = more(356)
    for _ in range(2):  # of two crowds only the first texts are at 0.8 of each other; the others are more central
        first = common + more(43)
        near_first = first + more(4)
        rows += [" ".join(first), *(" ".join(near_first + more(3)) for _ in range(20))]
    rows = list(enumerate(rows))
    want, n = brute(rows)
    assert n == 2
    frame = spark.createDataFrame([(i, t, "n", "l", 1) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, near.digest(near.classes(frame)).collect())) == sorted(want)


def test_cells_hold_each_pair_of_components_once(spark):
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(120)]
    rows = []
    for k in range(300):
        text = list(words)
        text[rng.randrange(120)] = text[rng.randrange(120)] = f"x{k}".encode()
        found = near.signatures([near.shingles(text, {})])
        rows.append((bytes([k // 256, k % 256]), found, b"big" if k % 3 else bytes([k % 7]), len(text) - 4))
    signed = spark.createDataFrame([(n, z, s.tobytes()) for n, s, _, z in rows], "node binary, size long, signature binary")
    banded = [(n, int(b), lab) for n, s, lab, _ in rows for b in near.bands_of(s)[0]]
    placed = spark.createDataFrame(banded, "node binary, bucket long, label binary")
    got = [tuple(map(bytes, r)) for r in near.open_pairs(placed, signed, 0.8, False).collect()]
    tiny = {b for b, n in Counter(b for _, b, _ in banded).items() if n < 3}
    want = set()
    sets = {n: set(near.bands_of(s)[0].tolist()) for n, s, _, _ in rows}
    for n, s, lab, _ in rows:
        for m, t, other, _ in rows:
            if n < m and lab != other and (both := sets[n] & sets[m]) and min(both) not in tiny and (s == t).sum() >= near.AGREE:
                want.add((n, m))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    few = near.open_pairs(placed, signed, 0.8, True)
    assert {tuple(map(bytes, r)) for r in few.collect()} < want


def test_overlaps_are_sums_of_the_lesser_weights():
    rng = random.Random(6)
    texts = [near.elements(np.array(rng.choices(range(9000), k=rng.choice([1, 40, 9000])) + [5] * k, dtype=np.uint64)) for k in range(12)]
    got = near.overlaps([k for k, _ in texts], [w for _, w in texts])
    sums = [sum((Counter(dict(zip(*map(np.ndarray.tolist, x)))) & Counter(dict(zip(*map(np.ndarray.tolist, y))))).values()) for x in texts for y in texts]
    off = ~np.eye(12, dtype=bool)
    assert (got[off] == np.array(sums).reshape(12, 12)[off]).all()


def test_a_crowd_below_the_threshold_makes_no_row_a_pair(spark, monkeypatch):
    rng = random.Random(8)
    more = lambda n: [f"{rng.random()}"[2:] for _ in range(n)]
    common = more(200)
    texts = [common + more(30) for _ in range(200)]  # 0.77 of each other
    texts += [[*texts[7][:-2], *more(2)], [*texts[90][:-1], *more(1)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    tried, check = [], near.check

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(near, "check", counted)
    frame = spark.createDataFrame([(i, t, "n", "l", 1) for i, t in rows], SCHEMA)
    want, n = brute(rows)
    assert n == 200 and sorted(map(tuple, near.digest(near.classes(frame)).collect())) == sorted(want)
    assert sum(tried) < 20 * len(rows)  # all pairs are 100 times the rows
