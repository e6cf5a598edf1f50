"""Rules against brute force, trees on held-out labelled URLs, edge cases."""

import random

from pyspark.sql import functions as F
from rankflow.llm import url_filter as u

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
SCHEMA = "page_id long, url string, html string, Host string, score string"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "x", "://", "http://", "http://com/", "http://com", "HTTP://A.Example.COM/en/x?y=/es/#z", "http://notcom/", "a://b.net/fr/://", "http://É.Com/\n"]
    for _ in range(400):
        host = ".".join(rng.choices(["www", "m", "example", "a", "xcom"], k=rng.randint(0, 3)) + [rng.choice(["com", "net", "example.com", "org"])])
        urls.append(f"{rng.choice(['http', 'https', 'ftp'])}://{host}{rng.choice(['', '/', '/en/', '/en', '/es/1', '/fr/a/b', '?q=/en/', '#/en/'])}")
    urls.append("http://" + "a." * 20000 + "com/" + "é" * 20000)
    table = spark.createDataFrame([(i, x, "h", "clash", "s") for i, x in enumerate(urls)], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(table, RULES).collect()}
    for i, x in enumerate(urls):
        host, path, rule, verdict = brute(x)
        assert got[i][:3] == (host, path, rule)
        assert got[i][3] == verdict if rule else got[i][3] in ("allow", "block")


def test_trees_separate_held_out_urls(spark):
    rng, rows = random.Random(2), []
    for i in range(1500):
        bad = i % 2
        host = f"{'cheap-' * bad}{rng.choice('abcdef')}{rng.randint(0, 9999) if bad else ''}.{rng.choice(['biz', 'org'] if bad else ['org', 'net'])}"
        rows.append((f"http://{host}/{rng.choice(['x', 'y'])}{'?a=1&b=2' if bad and rng.random() < 0.5 else ''}", bad))
    table = spark.createDataFrame(rows, "url string, label int")
    model = u.UrlModel(table.limit(1000))
    scored = model.score(u.split_url(table)).select("label", "score").collect()[1000:]
    assert sum((r.score >= 0.5) == bool(r.label) for r in scored) > 0.95 * len(scored)


def test_one_label_none_and_empty(spark):
    table = spark.createDataFrame([(1, "http://a.org/x", None, None, None), (None, None, None, None, None)], SCHEMA)
    assert {r.score for r in u.judge(table, RULES).collect()} == {0.0}
    one = spark.createDataFrame([("http://a.org", 1)], "url string, label int")
    assert {r.verdict for r in u.judge(table, [], one).collect()} == {"block"}
    assert u.judge(table.where(F.lit(False)), RULES).count() == 0
