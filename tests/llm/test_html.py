"""Extraction of given and written pages, matching against brute force, broken markup."""

import random
import re
from html import unescape

from rankflow.llm import html as h
from rankflow.llm.common import table

SCHEMA = "page_id long, url string, html string, Host string, wrapper int"


def one(page):
    shape, groups = h.shape_of(h.parse(page))
    good = h.content_of(shape, None, 0, [s[1] for s in h._measured(groups)])
    return "\n".join(t for _, t in sorted(t for n, g in zip(groups, good, strict=True) if g for x in n for t in x.texts))


def test_single_pages():
    assert one(None) == one("") == ""
    assert one("<p>a&amp;b  &lt;c&gt;\n d<p><b>e<br>f") == "a&b <c> d\ne f"
    assert one("<nav>n</nav><article><h1>T</h1><div class='comments'>c</div><p>x<script>var t='</p>';</script>y</p><form>f</form></article><footer>z") == "T\nxy"
    assert one("<body><div id=menu>m</div><div><h2>t</h2>loose<p>text <a href='x>y'>link</a>.</p></div><aside>s</aside>") == "t\nloose\ntext link."
    assert one("<article><ul><li>a<li>b</ul>c<table><tr><td>1<td>2</table></article>") == "a\nb\nc\n1\n2"
    assert one("<style>p{}</style><!-- <p>no --><p hidden>h</p><p>yes</p><p") == "yes\n<p"
    assert one("<div>" * 5000 + "deep") == "deep" and one("<article>" + "w " * 200_000 + "</article>") == ("w " * 200_000).strip()


def size(a, b):
    """Largest simple tree matching by trying everything."""
    if a[0] != b[0]:
        return 0

    def forests(x, y):
        if not x or not y:
            return 0
        return max(forests(x[1:], y), forests(x, y[1:]), size(x[0], y[0]) and size(x[0], y[0]) + forests(x[1:], y[1:]))

    return 1 + forests(a[3], b[3])


def test_matching_is_the_largest():
    rng = random.Random(5)

    def tree(depth):
        return [rng.choice("ab") if depth < 3 else "r", "", False, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert h.matching(a, b)[0] == size(a, b)


def test_constant_text_of_a_host_is_template(spark):
    page = lambda i, s="http://h.org": (i, f"{s}/{i}", f"<div><div class=x><p>Same on all pages of this site, always.</p></div><div class=y><h1>t{i}</h1><p>{'own ' * 9}{i}</p></div></div>", "c", 1)
    rows = [page(i) for i in range(6)] + [page(50, "http://one.org")] + [(7, None, None, None, None), (8, "http://copy.org", "<p>a</p>", "c", 1)]
    rows += [(k, "http://copy.org", "<article><p>a b c</p></article>", "c", 1) for k in range(90, 99)]
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert got[3].text == f"t3\n{'own ' * 9}3" and got[3].n_chars == len(got[3].text)
    assert got[50].text.endswith("50") and (got[7].text, got[7].n_chars, got[7].url) == ("", 0, None)
    assert got[95].text == "a b c"
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_articles_of_the_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner))]
        want[r.page_id] = "\n".join(filter(None, blocks))
    for r in h.extract(pages).collect():
        assert r.text == want[r.page_id], r.page_id


def test_copies_of_one_page_make_no_template(spark):
    page = lambda k, more: f"<body><div class=foot0>Same on all.</div><article><h1>t{k}</h1><p>own {k}</p>{more}</article></body>"
    rows = [(i, f"http://h.org/{i}", page(0, "<blockquote>only here</blockquote>"), "c", 1) for i in range(20)]
    rows += [(i, f"http://h.org/{i}", page(i, ""), "c", 1) for i in range(100, 105)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "t0\nown 0\nonly here" and got[101] == "t101\nown 101"


def test_layout_names_are_no_boilerplate():
    for start in ("<body class='no-sidebar'>", "<body class='search-results'>", "<div id=page class='has-header wide'>", "<article class='post comments-open'>"):
        assert one(f"{start}<h1>t</h1><p>text of it</p>") == "t\ntext of it", start
    assert one("<body class='no-sidebar'><div class='sidebar'>s</div><div class='post-comments'>c</div><p>x</p>") == "x"


def test_elements_below_the_depth():
    nest = lambda inside: "<div>" * 200 + inside + "</div>" * 200
    assert one(f"<div id=a><article><h1>t</h1>{nest('in')}<p>after</p></article></div><footer>f</footer>") == "t\nin\nafter"
    assert one(f"<article>{nest('<nav>n<p>m</nav><p>a<p>b<ul><li>c<li>d</ul><div class=comments>x<div>y</div></div>')}<p>z</article>") == "a\nb\nc\nd\nz"
