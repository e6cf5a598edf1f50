"""Base spans against plain regular expressions, discovery against the rules in plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from rankflow.llm import pii

SCHEMA = "doc_id long, text string, base string, _Key string"
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAILISH = r"[A-Za-z0-9._%+-]+(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]+)*"
NUMBER = r"\+?\(?[0-9](?:[ ().\-/]{0,3}[0-9])*"


def fine(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_of(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(SHAPES.items()) for m in re.finditer(p, text or "") if fine(kind, m.group()))


def patterns(text, start, end, gap_from, gap_to):
    left, right = text[gap_from:start][-pii.AROUND :], text[end:gap_to][: pii.AROUND]
    tame = lambda s: re.sub("[0-9]+", "0", s.lower())
    words, out = left.split(), []
    after = right.split()[:1]
    if len(words) >= 2:
        out.append(f"{tame(words[-2])} {tame(words[-1])} _")
    if words and after:
        out.append(f"{tame(words[-1])} _ {tame(after[0])}")
    return out


def suits(k, value):
    n = len(re.sub("[^0-9]", "", value))
    if k == 0:
        return bool(re.search(r"@|[\[(](?:at|AT)[\])]", value))
    if re.search("[A-Za-z]", value):
        return False
    if k == 1:
        return bool(re.search(r"^[0-9]{1,4}(?:[.-][0-9]{1,4}){3,}$", value))
    return 12 <= n <= 19 if k == 2 else 7 <= n <= 15


def plain(docs):
    places = {}
    for key, text in docs:
        text = text or ""
        base = base_of(text)
        for k, p in [*enumerate(SHAPES.values()), (-1, MAILISH), (-1, NUMBER)]:
            found = list(re.finditer(p, text))
            for i, m in enumerate(found):
                span = (m.start(), k, m.end())
                if k >= 0 and span not in base or k < 0 and any(b[0] < m.end() and m.start() < b[2] for b in base):
                    continue
                around = patterns(text, *m.span(), found[i - 1].end() if i else 0, found[i + 1].start() if i + 1 < len(found) else len(text))
                places[key, text, m.start(), m.end(), k] = (re.sub(r"[\s()\-/]", "", m.group().lower()), m.group(), around)
    edges, raw = {}, {}
    for (*_, k), (value, shown, around) in places.items():
        raw[value] = shown
        for p in around:
            edges[p, value] = max(k, edges.get((p, value), -1))
    seeds = {(value, place[4]) for place, (value, _, _) in places.items() if place[4] >= 0}
    known, more = set(seeds), set()
    for _ in range(pii.ROUNDS):
        trust = {}
        for p in {p for p, _ in edges}:
            values = [x for q, x in edges if q == p]
            for k in range(4):
                hits = sum((x, k) in known for x in values)
                if hits >= pii.LEAST_KNOWN and hits / (len(values) + 1) >= pii.PATTERN:
                    trust[p, k] = hits / (len(values) + 1)
        score = {}
        for (p, value), seed in edges.items():
            for k in range(4):
                if seed < 0 and suits(k, raw[value]) and (p, k) in trust:
                    score[value, k] = score.get((value, k), 0) + math.log(1 - trust[p, k])
        best = {}
        for (value, k), s in score.items():
            if 1 - math.exp(s) >= pii.VALUE:
                best[value] = min(best.get(value, (0, 9)), (math.exp(s) - 1, k))
        new = {(value, k) for value, (_, k) in best.items() if not any((value, j) in seeds for j in range(4))}
        same, more, known = new == more, new, seeds | new
        if same:
            break
    extra = {}
    for (key, text, start, end, k), (value, shown, _) in places.items():
        for j in range(4):
            if k < 0 and (value, j) in more and suits(j, shown):
                extra.setdefault((key, text), set()).add((start, j, end))
    write = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    rows = []
    for key, text in docs:
        base = base_of(text)
        sha = hashlib.sha256(write(base).encode()).hexdigest()
        rows.append((key, *(sum(b[1] == k for b in base) for k in range(4)), sha, write([*base, *extra.get((key, text or ""), [])])))
    return sorted(rows, key=str)


def answer(table):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return sorted((tuple(r[c] for c in names) for r in pii.digest(pii.find(table)).collect()), key=str)


def odd_texts():
    rng = random.Random(4)
    texts = [
        None, "", "a@b", "a@b.c_d@e.f", "é x.y@z-1.co.uk.", "1.2.3.4.5.6.7.8", "001.002.0255.4", "256.1.1.1", "99999999999.1.1.1",
        "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111", "+1 (743) 555-3824)", "+1..........", "++12 3456789012 3",
        "x" * 9_000, "1 " * 9_000, "a@" * 3_000, "1." * 9_000, "a.b@c.d " * 1_000, "日本 +81 3 1234 5678 end", "\n+1 555 000 1111\t9",
    ]
    return texts + ["".join(rng.choices("a1.@+ -(é\n45", k=rng.randint(1, 60))) for _ in range(250)]


def test_base_spans(spark):
    docs = list(enumerate(odd_texts())) + [(None, "a@b.co"), (None, None), (5, "a@b.co"), (5, "a@b.co")]
    got = answer(spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA))
    assert got == plain(docs)


def known_texts():
    rng = random.Random(9)
    number = lambda n: "".join(rng.choices("123456789", k=n))
    docs = []
    for _ in range(30):
        docs.append(f"Please call me at +1 {number(3)} {number(7)} tonight, thanks")
        docs.append(f"my mail address is {number(4)}@host.example.com and nothing else")
        docs.append(f"the year was {number(4)} or thereabouts")
    docs += [f"please CALL me at {number(3)}-{number(4)} tonight" for _ in range(3)]
    docs += ["my mail address is jo.doe [at] host (dot) example and so on", "an order of 1234567 pieces"]
    docs += ["write to jo.doe [at] host (dot) example soon", "call me at 5 tonight", docs[-2], docs[-2]]
    return [(i, t) for i, t in enumerate(docs)]


def test_contexts_discover_what_no_shape_finds(spark):
    docs = known_texts()
    table = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    got = answer(table)
    assert got == plain(docs)
    spans = {r[0]: r[6] for r in got}
    at = {t: i for i, t in docs}
    for i, t in docs:
        if t.startswith("please CALL"):
            assert spans[i] == "phone:18:26"
    assert spans[at["write to jo.doe [at] host (dot) example soon"]] == "email:9:39"
    assert spans[at["an order of 1234567 pieces"]] == spans[at["call me at 5 tonight"]] == ""
    assert answer(table.where("false")) == []


def test_endless_words_take_linear_time(spark):
    texts = ["x" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "a@" * 30_000, "+1(" * 30_000, "a.b@c.d " * 10_000]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(pii.find(table)).collect()}
    assert counts == {i: (0, 0, 0, 0) for i in range(5)} | {5: (10_000, 0, 0, 0)}


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a@b.co", "x", "y")], SCHEMA)
    plan = pii.scan(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    steps = spark.range(1).select((F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("steps"))
    row = steps.select(pii.running("steps").alias("s")).first()
    assert list(row.s) == [i * (i + 1) // 2 for i in range(1, n + 1)]
