"""Main text of pages by wrapper induction.

Pages become DOM trees of their block elements; runs of equal siblings fold into one node that
repeats. Trees of one host are aligned by simple tree matching (the largest order-preserving
match of equal-tagged nodes, by dynamic programming over children), the commonest tree first, and
merged into the host's wrapper: a tree whose nodes know on how many pages they stand, how much
text and link text they hold, and the one text they hold if it never varies. Nodes whose text is
constant over the host's pages are template. Of the varying slots, those that are boilerplate by
what they are (navigation, adverts, forms, comments...: fixed words in tag, class, id and role)
or hold mostly links are no content; the content root is an article or main element, else the
smallest slot that still holds most of the host's varying text. A page is then aligned with its
host's wrapper and the texts in content slots are its main text.

Statistics are summed in Spark per host and tree shape (so a host with a third of all pages is
a few rows), shapes are merged in two steps (host and salt, host), and pages meet the wrapper in a
salted join. Trees of equal shape are aligned once a task.

A block is a block-level element's own run of inline text; white space in it becomes one space,
blocks join by line ends; comments, scripts, styles and the like never count; broken and unclosed
markup is read as browsers do in outline. Null html is empty and has an empty text; a null url is
a host of its own (''); repeated rows are extracted each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankflow.llm.common import salted
from rankflow.llm.url_filter import split_url
from rankflow.session import store

# Element kinds of HTML, and words that name boilerplate.
RAW = frozenset("script style textarea title noscript template iframe svg math select option button object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER_TAGS = frozenset("nav header footer aside form menu dialog head".split())
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner\w*|breadcrumbs?|comments?|comment\w*|respond|replies|cookies?|consent|gdpr|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|notices|pagination|pager|popup|modal|promo\w*|related|recommend\w*|share|sharing|sidebar|side|social|sponsor\w*|subscribe|subscription|signup|login|toolbar|widget|alert|disclaimer|copyright|legal|toc|skip|search)(?:$|[\s_-])"
)
#: Parts of names that say what a page has or lacks, or that a state is on, and name no boilerplate.
LAYOUT = re.compile(r"(?<![^\s_])(?:no|has|with|without)[-_]\S+|\S+[-_](?:open|closed)(?!\S)")
#: Elements that hold a page or its content: no name makes them boilerplate.
NEVER_BOILER = frozenset("html body main article".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ROOTS = ("article", "main")
TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CONTAINERS = frozenset("# html body div section main article td center blockquote table tbody tr".split())
LISTS = frozenset("ul ol dl table div section".split())
#: Elements below this depth give their text to the one that holds them; their end tags and boilerplate still count.
DEEPEST = 150

#: A host's text is template if it is constant over so many pages at least.
LEAST_PAGES = 4
MOST_LINKS = 0.6


class Node:
    """An element: its name for matching, its children, and the blocks of text directly in it."""

    __slots__ = ("depth", "kids", "links", "name", "skip", "tag", "texts", "up")

    def __init__(self, name: str, tag: str, skip: bool, up: Node | None):
        self.name, self.tag, self.skip, self.up = name, tag, skip, up
        self.depth = up.depth + 1 if up else 0
        self.kids: list[Node] = []
        self.texts: list[tuple[int, str]] = []
        self.links = 0


def _named(tag: str, rest: str) -> tuple[str, bool]:
    """Name for matching (tag, class and id without digits) and whether the element is boilerplate."""
    name, skip = tag, tag in BOILER_TAGS
    for m in ATTRIBUTE.finditer(rest) if rest else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            skip = skip or tag not in NEVER_BOILER and bool(BOILER_NAMES.search(LAYOUT.sub(" ", value)))
            name += "." + re.sub(r"\d+", "0", " ".join(value.split()))
        elif key == "role":
            skip = skip or value in BOILER_ROLES
            name += "@" + value
        else:
            hidden = key == "hidden" or value == "true"
            skip, name = skip or hidden, name + "!" * hidden
    return name, skip


def parse(page: str | None) -> Node:
    """The block tree of a page; texts carry their place among all texts of the page."""
    root = node = Node("#", "#", False, None)
    text, at, order, anchors, linked = [], 0, 0, 0, 0
    page = page or ""
    deep: list[tuple[str, bool]] = []  # open elements below DEEPEST: tag, and whether it or one around it is boilerplate

    def flush() -> None:
        nonlocal order, linked
        if text:
            block = " ".join("".join(text).split())
            if block and not (deep and deep[-1][1]):
                node.texts.append((order, block))
                node.links += min(linked, len(block))
                order += 1
            text.clear()
        linked = 0

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            piece = entities.unescape(page[at : m.start()])
            text.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in INLINE:
                continue
            flush()
            mine = next((k for k in range(len(deep) - 1, -1, -1) if deep[k][0] == tag), None)
            if mine is not None:
                del deep[mine:]
                anchors = 0
                continue
            up = node
            while up is not None and up.tag != tag:
                up = up.up
            if up is not None and up.up is not None:
                node = up.up
                anchors = 0
                deep.clear()
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            anchors += tag == "a"
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if tag in CLOSES_P:
            while deep and deep[-1][0] == "p":
                deep.pop()
        if tag in CLOSES_P and not deep:
            up = node
            while up is not None and up.tag == "p":
                up = up.up
            node = up or root
        if tag in SAME_LEVEL:
            for k in range(len(deep) - 1, -1, -1):
                if deep[k][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
                if deep[k][0] in SAME_LEVEL[tag]:
                    del deep[k:]
                    break
        if tag in SAME_LEVEL and not deep:
            up = node
            while up.up is not None and up.tag not in ("ul", "ol", "dl", "table", "menu", "select"):
                if up.tag in SAME_LEVEL[tag]:
                    node = up.up
                    break
                up = up.up
        if deep or node.depth >= DEEPEST:
            deep.append((tag, _named(tag, m[3])[1] or bool(deep and deep[-1][1])))
            continue
        name, skip = _named(tag, m[3])
        made = Node(name, tag, skip, node)
        node.kids.append(made)
        node = made
        anchors = 0
    flush()
    return root


def shape_of(root: Node) -> tuple[tuple, list[list[Node]]]:
    """The tree with equal-named siblings folded, and the nodes behind each shape node, in preorder."""
    groups: list[list[Node]] = []

    def fold(nodes: list[Node]) -> tuple:
        groups.append(nodes)
        runs: dict[str, list[Node]] = {}
        for node in nodes:
            for kid in node.kids:
                runs.setdefault(kid.name, []).append(kid)
        first = nodes[0]
        return (first.name, first.tag, first.skip, tuple(fold(kids) for kids in runs.values()))

    return fold([root]), groups


# A wrapper node is a list: name, tag, skip, kids, pages, characters, link characters, least and greatest hash of its text,
# hashes of up to LEAST_PAGES different pages that hold it.
NAME, TAGGED, SKIP, KIDS, PAGES, CHARS, LINKS, LOW, HIGH, SOME = range(10)


def wrapper_of(shape: tuple, stats: list[list]) -> list:
    """A wrapper of one shape; `stats` has pages, characters, links, low, high and some pages of its nodes in preorder."""
    rows = iter(stats)

    def build(node: tuple) -> list:
        own = next(rows)
        return [node[0], node[1], node[2], [build(k) for k in node[3]], *own]

    return build(shape)


def matching(a: list, b: list, name: int = NAME, kids: int = KIDS) -> tuple[int, list]:
    """Simple tree matching of two nodes of equal name: size of the best match, and the matched pairs of kids.

    Kids are matched in order; a pair's worth is the size of its own best match.
    """
    left, right = a[kids], b[kids]
    inner = {
        (i, j): matching(x, y, name, kids) for i, x in enumerate(left) for j, y in enumerate(right) if x[name] == y[name]
    }
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if (i - 1, j - 1) in inner:
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + inner[i - 1, j - 1][0])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j, inner[i, j][1]))
    return 1 + best[-1][-1], pairs[::-1]


def absorb(a: list, b: list, pairs: list) -> None:
    """Merge wrapper b into a along a matching; kids without a partner go in after the last that has one."""
    for k in (PAGES, CHARS, LINKS):
        a[k] += b[k]
    a[LOW], a[HIGH] = min(a[LOW], b[LOW]), max(a[HIGH], b[HIGH])
    a[SOME] = sorted({*a[SOME], *b[SOME]})[:LEAST_PAGES]
    partner = {j: (a[KIDS][i], inner) for i, j, inner in pairs}
    place = 0
    for j, kid in enumerate(b[KIDS]):
        if j in partner:
            mine, inner = partner[j]
            absorb(mine, kid, inner)
            place = next(k for k, x in enumerate(a[KIDS]) if x is mine) + 1
        else:
            a[KIDS].insert(place, kid)
            place += 1


def induce(wrappers: list[tuple[str, str]]) -> tuple[str, str]:
    """One wrapper from several (each with the hashes of some of its pages), the one of most pages first."""
    trees = sorted(((json.loads(w), w) for w, _ in wrappers), key=lambda x: (-x[0][PAGES], x[1]))
    whole = trees[0][0]
    for tree, _ in trees[1:]:
        absorb(whole, tree, matching(whole, tree)[1])
    pages = sorted({h for _, some in wrappers for h in json.loads(some)})[:LEAST_PAGES]
    return json.dumps(whole), json.dumps(pages)


def content_of(shape: tuple, wrapper: list | None, pages: int, own: list[int]) -> list[bool]:
    """Which of a shape's nodes (in preorder) are content slots; `pages`: distinct pages the wrapper is known to have."""
    flat, kin = [], []

    def walk(node: tuple, up: int, skip: bool) -> None:
        me = len(flat)
        flat.append((node, skip or node[2]))
        kin.append([up, []])
        if up >= 0:
            kin[up][1].append(me)
        for kid in node[3]:
            walk(kid, me, skip or node[2])

    walk(shape, -1, False)
    known: dict[int, list] = {}

    def align(w: list, me: int, pairs: list) -> None:
        known[me] = w
        for i, j, inner in pairs:
            align(w[KIDS][i], kin[me][1][j], inner)

    if wrapper is not None:
        plain = _as_list(shape)
        if wrapper[NAME] == plain[NAME]:
            align(wrapper, 0, matching(wrapper, plain)[1])
    n = len(flat)
    out = [False] * n
    template = [
        (w := known.get(k)) is not None and len(w[SOME]) >= LEAST_PAGES and w[LOW] == w[HIGH] and w[CHARS] > 0 and 2 * w[PAGES] > wrapper[PAGES]
        for k in range(n)
    ]
    linked = [(w := known.get(k)) is not None and flat[k][0][1] in LISTS and w[CHARS] > 0 and _total(w, LINKS) > MOST_LINKS * _total(w, CHARS) for k in range(n)]
    held = [0] * n
    for k in range(n - 1, -1, -1):
        if flat[k][1] or linked[k]:
            held[k] = 0
            continue
        if not template[k]:
            held[k] += known[k][CHARS] if k in known else own[k]
        if kin[k][0] >= 0:
            held[kin[k][0]] += held[k]
    roots = [k for k in range(n) if flat[k][0][1] in ROOTS and held[k]]
    if roots:
        root = max(roots, key=lambda k: (held[k], -k))
    else:
        root = 0
        while True:
            inner = [k for k in kin[root][1] if flat[k][0][1] in CONTAINERS and 10 * held[k] >= 6 * held[root] > 0]
            if not inner:
                break
            root = max(inner, key=lambda k: held[k])

    def mark(k: int) -> None:
        if flat[k][1] or (k != root and linked[k]):
            return
        out[k] = not template[k]
        for kid in kin[k][1]:
            mark(kid)

    mark(root)
    return out


def _as_list(shape: tuple) -> list:
    return [shape[0], shape[1], shape[2], [_as_list(k) for k in shape[3]]]


def _total(w: list, field: int) -> int:
    return w[field] + sum(_total(k, field) for k in w[KIDS])


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def _measured(groups: list[list[Node]]) -> list[list]:
    out = []
    for nodes in groups:
        said = "\n".join(t for node in nodes for _, t in node.texts)
        h = _digest(said)
        out.append([1, len(said), sum(node.links for node in nodes), h, h])
    return out


def wrappers_of(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(host, wrapper, pages): one row a host; `pages` has the hashes of up to LEAST_PAGES different pages."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[list], set]] = {}

        def rows() -> pa.RecordBatch:
            keys = list(held)
            made = [json.dumps(wrapper_of(shape, held[host, shape][0])) for host, shape in keys]
            some = [json.dumps(sorted(held[k][1])) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array(made, pa.string()), pa.array(some, pa.string())], ["host", "wrapper", "pages"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                shape, groups = shape_of(parse(page))
                stats = _measured(groups)
                seen, some = held.setdefault((host, shape), ([[0, 0, 0, s[3], s[4], []] for s in stats], set()))
                mark = _digest("".join(str(s[3]) for s in stats))
                for a, b in zip(seen, stats, strict=True):
                    a[0] += 1
                    a[1] += b[1]
                    a[2] += b[2]
                    a[3], a[4] = min(a[3], b[3]), max(a[4], b[4])
                    if mark not in a[5]:
                        a[5] = sorted([*a[5], mark])[:LEAST_PAGES]
                some.add(mark)
                if len(some) > LEAST_PAGES:
                    some.remove(max(some))
            if len(held) > 2000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        wrapper, some = induce(list(zip(group["wrapper"], group["pages"], strict=True)))
        return pd.DataFrame({"host": group["host"].iloc[:1].to_numpy(), "wrapper": [wrapper], "pages": [some]})

    told = "host string, wrapper string, pages string"
    found = pages.select("host", "html").mapInArrow(shapes, told)
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt")
    return found.groupBy("host", salt).applyInPandas(merge, told).groupBy("host").applyInPandas(merge, told)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by line ends) and n_chars of every page."""
    rows = split_url(pages.select("page_id", "url", "html")).drop("path")
    wrapped = store(wrappers_of(rows), "wrappers")
    joined = salted(rows, wrapped, ["host"], F.struct("page_id", "url"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, tuple[list, int]] = {}
        slots: dict[tuple, list[bool]] = {}
        for batch in batches:
            said = []
            for page, wrapper, some in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "pages")), strict=True):
                shape, groups = shape_of(parse(page))
                key = (wrapper, shape)
                if key not in slots:
                    if len(slots) > 5000:
                        slots.clear()
                        wrappers.clear()
                    if wrapper is not None and wrapper not in wrappers:
                        wrappers[wrapper] = (json.loads(wrapper), len(json.loads(some)))
                    tree, known = wrappers.get(wrapper, (None, 0))
                    slots[key] = content_of(shape, tree, known, [s[1] for s in _measured(groups)])
                blocks = [t for nodes, good in zip(groups, slots[key], strict=True) if good for node in nodes for t in node.texts]
                said.append("\n".join(t for _, t in sorted(blocks)))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(said, pa.string()), pa.array(list(map(len, said)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
