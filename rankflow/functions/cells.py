"""Let users meet a catalog cell by cell, as matrices.

Shards of users and blocks of items meet through the same equi-join on two numbers as in `blocks.py`,
but the rows of a cell reach numpy as two Arrow tables, and what comes back is a row or a few per user and
block. A pair costs a few nanoseconds instead of a row. Matrix products only preselect: every score or
threshold that is returned or compared exactly is added up feature by feature, in the order SQL does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions.blocks import block_of, place, side
from rankflow.session import width

#: Users and items in a cell, on average, at most; pairs in a matrix, and in one of short floats.
USERS = 16384
ITEMS = 16384
TILE = 1 << 17
WIDE = 1 << 19
#: Items of a whole catalog that one cell can hold, for steps that then need no further pass.
WHOLE = 1 << 17


def meet_cells(
    users: DataFrame, catalog: DataFrame, work: Callable[[Users, Items], pa.Table], columns: list[str], numbers: list[str],
    cells: DataFrame | None = None, whole: bool = False,
) -> DataFrame:
    """`work` on every cell: it returns `columns` (of `users` or `catalog`) and `numbers` (doubles).

    `users` have `user_id`, packed columns and maybe `_rated`; `cells` as in `meet_rows`. With `whole` every cell
    has the whole catalog.
    """
    n, people = side(users), max(1, users.count())
    blocks = 1 if whole else max(1, min(n, -(-catalog.count() // ITEMS)))
    shards = max(-(-people // USERS), min(-(-people // 64), -(-2 * width(users) // blocks)))
    parts = min(blocks * shards, 2 * width(users) + 1)
    if cells is None:
        sent = users.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        merged = cells.groupBy("user_id", F.pmod("_block", F.lit(blocks)).cast("int").alias("_block")).agg(
            F.flatten(F.collect_list("_rated")).alias("_rated")
        )
        sent = users.drop("_block", "_rated").join(place(merged), "user_id")
    keys = ["_shard", "_block"]
    sent = sent.withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), "user_id"), F.lit(shards)).cast("int"))
    placed = catalog.withColumns(
        {
            "_block": F.pmod(block_of("item", n), F.lit(blocks)).cast("int"),
            "_shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))),
        }
    )
    kinds = {f.name: f.dataType for f in [*users.schema, *catalog.schema]} | dict.fromkeys(numbers, T.DoubleType())
    schema = T.StructType([T.StructField(c, kinds[c]) for c in [*columns, *numbers]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({})
        return work(Users(left), Items(right))

    # The number of partitions is given, so that few bytes are not taken for little work.
    pairs = sent.repartition(parts, *keys).groupBy(*keys).cogroup(placed.repartition(parts, *keys).groupBy(*keys))
    return pairs.applyInArrow(run, schema)


def matrix(table: pa.Table, column: str, letter: str) -> np.ndarray | None:
    """Fields `<letter>0`, `<letter>1`... of a packed column, a row per table row."""
    if column not in table.column_names:
        return None
    packed = table.column(column).combine_chunks()
    packed = packed if isinstance(packed, pa.StructArray) else packed.chunk(0)
    names = {f.name for f in packed.type}
    found = [f"{letter}{i}" for i in range(len(names)) if f"{letter}{i}" in names]
    return np.column_stack([doubles(packed.field(f)) for f in found]) if found else None


def doubles(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from left to right: the bits that the SQL expression gives."""
    total = a[:, 0] * b[:, 0]
    for i in range(1, a.shape[1]):
        total = total + a[:, i] * b[:, i]
    return total


class Items:
    """A block of the catalog, sorted by item."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("item", "ascending")], null_placement="at_start")
        table = table.take(order)
        self.table, self.item = table, table.column("item").combine_chunks()
        self.size = table.num_rows
        self.c, self.k, self.x, self.u = (matrix(table, "_i", letter) for letter in "ckxu")
        self.g = matrix(table, "_g", "g")
        self.whole = bool((self.k == 1).all())
        known = self.item.drop_null()
        self.once = known.unique()
        #: Column of an item's first row in `once` order, and the rows that repeat it (keys need not be unique).
        self.code = np.asarray(pc.fill_null(pc.index_in(self.item, value_set=self.once), -1))
        #: Memory for the matrices of one tile after another.
        self.boards: dict[str, np.ndarray] = {}


class Users:
    """A shard of users, sorted so that equal thresholds are neighbours."""

    def __init__(self, table: pa.Table):
        t = matrix(table, "_t", "t")
        if t is not None:
            order = np.lexsort(t.T)
            table, t = table.take(pa.array(order)), t[order]
        self.table, self.t, self.size = table, t, table.num_rows
        self.w, self.q = matrix(table, "_u", "w"), matrix(table, "_u", "q")
        if self.q is not None:
            packed = table.column("_u").combine_chunks()
            self.wc, self.ws = doubles(packed.field("wc")), doubles(packed.field("ws"))
        self.rated = None
        if "_rated" in table.column_names:
            self.rated = listed(table, "_rated")


def content(users: Users, items: Items, at: slice) -> np.ndarray:
    """Content scores but for rounding: the users `at` in the rows, every item in the columns."""
    w = users.w[at]
    if items.whole:
        known = w.sum(1)
        return (w / np.where(known > 0, known, 1)[:, None]) @ items.c.T
    known = w @ items.k.T
    return (w @ items.c.T) / np.where(known > 0, known, 1)


def cosine(users: Users, items: Items, at: slice) -> np.ndarray:
    near = users.q[at] @ items.u.T
    return np.clip(near, 0, 1, out=near)


def plain(users: Users, items: Items, at: slice) -> np.ndarray:
    return users.w[at] @ items.x.T


def hybrid(users: Users, items: Items, at: slice) -> np.ndarray:
    scores = content(users, items, at)
    scores *= users.wc[at, None]
    if users.ws[at].any():
        scores += users.ws[at, None] * cosine(users, items, at)
    return scores


def content_exact(users: Users, items: Items, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    top, bottom = dot(users.w[r], items.c[c]), dot(users.w[r], items.k[c])
    return np.where(bottom != 0, top / np.where(bottom != 0, bottom, 1), 0.0)


def plain_exact(users: Users, items: Items, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return dot(users.w[r], items.x[c])


def hybrid_exact(users: Users, items: Items, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    near = np.clip(dot(users.q[r], items.u[c]), 0, 1)
    return users.wc[r] * content_exact(users, items, r, c) + users.ws[r] * near


SCORES = {"content": (content, content_exact), "plain": (plain, plain_exact), "hybrid": (hybrid, hybrid_exact)}


def tiles(users: Users, items: Items) -> Iterator[slice]:
    step = max(1, TILE // items.size)
    return (slice(at, min(at + step, users.size)) for at in range(0, users.size, step))


def listed(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """The elements of an array column, and the table row of each."""
    lists = table.column(column).combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.repeat(np.arange(table.num_rows), lengths), lists.flatten()


def named(items: Items, who: np.ndarray, what: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """User and row of the block of every pair of a user `who` and item `what`, by user, each pair once. Keys may repeat."""
    code = np.asarray(pc.fill_null(pc.index_in(what, value_set=items.once), -1))
    who, code = who[code >= 0], code[code >= 0]
    order = np.argsort(items.code, kind="stable")
    low, high = (np.searchsorted(items.code[order], code, side) for side in ("left", "right"))
    n = high - low
    rows = np.repeat(who, n)
    spots = order[np.repeat(low, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]
    both = np.unique(rows * items.size + spots)
    return both // items.size, both % items.size


def wanted(users: Users, items: Items) -> Callable[[slice], np.ndarray]:
    """For a tile, which pairs count: those not rated yet."""
    rows, spots = named(items, *users.rated) if users.rated is not None else (np.zeros(0, int),) * 2

    def mask(at: slice) -> np.ndarray:
        good = np.ones((at.stop - at.start, items.size), bool)
        low, high = np.searchsorted(rows, [at.start, at.stop])
        good[rows[low:high] - at.start, spots[low:high]] = False
        return good

    return mask


class View:
    """The items of a block (`cols`, all if None) that neighbouring users want, as matrices whose columns are items."""

    def __init__(self, items: Items, cols: np.ndarray | None = None):
        self.cols = np.arange(items.size) if cols is None else cols
        self.c, self.k, self.x, self.u, self.code = (
            a if cols is None or a is None else a[cols] for a in (items.c, items.k, items.x, items.u, items.code)
        )
        self.size = len(self.cols)
        self.whole = items.whole or bool((self.k == 1).all())
        self.spot = np.full(items.size, -1)
        self.spot[self.cols] = np.arange(self.size)
        self.short, self.boards = {}, items.boards

    def turned(self, name: str, kind: type) -> np.ndarray:
        if (name, kind) not in self.short:
            self.short[name, kind] = np.ascontiguousarray(getattr(self, name).T, kind)
        return self.short[name, kind]

    def product(self, left: np.ndarray, right: np.ndarray, board: str) -> np.ndarray:
        """left @ right, in memory that the next product on this board takes again: fresh pages cost more than the numbers."""
        return np.matmul(left, right, out=self.board(board, len(left), left.dtype))

    def board(self, name: str, rows: int, real: type) -> np.ndarray:
        size = rows * self.size
        if (held := self.boards.get(name)) is None or held.dtype != real or len(held) < size:
            held = self.boards[name] = np.empty(max(size, WIDE), real)
        return held[:size].reshape(rows, self.size)

    def without(self, pairs: tuple[np.ndarray, np.ndarray], at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Of `pairs` (by user): those of the users `at`, counted from the first of them, with an item of the view."""
        low, high = np.searchsorted(pairs[0], [at.start, at.stop])
        r, c = pairs[0][low:high] - at.start, self.spot[pairs[1][low:high]]
        return r[c >= 0], c[c >= 0]


def views(users: Users, items: Items, passing: bool) -> Iterator[tuple[slice, View]]:
    """Neighbouring users and the items they want: all, or those past their thresholds, looked up once for equal ones."""
    every = View(items)
    if not passing:
        yield slice(0, users.size), every
        return
    change = np.flatnonzero(np.r_[True, (users.t[1:] != users.t[:-1]).any(1)])
    for start, stop in zip(change, np.r_[change[1:], users.size]):
        past = np.ones(items.size, bool)
        for i in np.flatnonzero(users.t[start] > -np.inf):
            past &= items.g[:, i] >= users.t[start, i]
        if past.all():
            yield slice(start, stop), every
        elif past.any():
            yield slice(start, stop), View(items, np.flatnonzero(past))


def spans(span: slice, view: View) -> Iterator[slice]:
    step = max(16, WIDE // view.size)
    return (slice(at, min(at + step, span.stop)) for at in range(span.start, span.stop, step))


def within(low: float, high: float, *arrays: np.ndarray | None) -> bool:
    """Whether all numbers but zeros are so large that nothing is lost in short floats."""
    sizes = [np.abs(a[a != 0]) for a in arrays if a is not None]
    return all(bool((v >= low).all() and (v <= high).all()) for v in sizes)


def real(users: Users, items: Items) -> type:
    """Short floats, where their range does, are enough to preselect."""
    fits = within(1e-25, 1e12, users.w, getattr(users, "wc", None), getattr(users, "ws", None))
    return np.float32 if fits and within(0, 1e12, items.c, items.x) else np.float64


def approximate(kind: str, users: Users, view: View, at: slice, real: type, by: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """`by` times the scores of the users `at`, and per user what rounding can change of them at most."""
    w, loss = users.w[at], 6e-6 if real is np.float32 else 1e-10
    if kind == "plain":
        top = np.abs(view.x).max(0)
        return view.product((by * w).astype(real), view.turned("x", real), "scores"), loss * (1 + by * np.abs(w) @ top)
    share = by * (users.wc[at] if kind == "hybrid" else np.ones(len(w)))
    if view.whole:
        known = w.sum(1)
        scores = view.product((w * (share / np.where(known > 0, known, 1))[:, None]).astype(real), view.turned("c", real), "scores")
    else:
        known = view.product(w.astype(real), view.turned("k", real), "more")
        scores = view.product(w.astype(real), view.turned("c", real), "scores")
        known[known == 0] = 1
        scores /= known
        scores *= share.astype(real)[:, None]
    slack = loss * (1 + np.abs(share) * np.abs(view.c).max())
    if kind == "hybrid" and users.ws[at].any():
        share = by * users.ws[at]
        near = view.product((np.abs(share)[:, None] * users.q[at]).astype(real), view.turned("u", real), "more")
        np.maximum(near, 0, out=near)
        if (share < 0).any():
            near *= np.sign(share).astype(real)[:, None]
        scores += near
        slack += loss * by * np.abs(users.ws[at])
    return scores, slack


def leading(scores: np.ndarray, n: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all that can be among the n largest of a row, if scores are right but for `slack`; minus infinity is left out.

    The n-th largest of the group maxima is reached by n items, so only groups that reach it are looked through.
    """
    size = scores.shape[1]
    groups = min(64, size // 2)
    if groups < n:
        return np.nonzero(scores > -np.inf)
    each = size // groups
    body = scores[:, : groups * each].reshape(len(scores), groups, each)
    tops = body.max(2)
    least = np.partition(tops, groups - n, axis=1)[:, groups - n] - 2 * slack
    r, g = np.nonzero(tops >= least[:, None])
    part = body[r, g]
    i, j = np.nonzero((part >= least[r, None]) & (part > -np.inf))
    rest = scores[:, groups * each :]
    k, tail = np.nonzero((rest >= least[:, None]) & (rest > -np.inf))
    return np.r_[r[i], k], np.r_[g[i] * each + j, tail + groups * each]


def first_items(users, view, at, scores, slack, exact, n):
    """Users, columns of the view and scores of the first n pairs of each row of a tile that are not minus infinity."""
    r, c = leading(scores, n, slack)
    r += at.start
    score = exact(users, view, r, c)
    order = np.lexsort((c, -score, r))
    r, c, score = r[order], c[order], score[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < n], c[rank < n], score[rank < n]


def answer(users: Users, items: Items | None, r: np.ndarray, c: np.ndarray | None, **numbers: np.ndarray) -> pa.Table:
    out = {"user_id": users.table.column("user_id").take(pa.array(r))}
    if c is not None:
        out["item"] = items.item.take(pa.array(c))
    return pa.table(out | {k: pa.array(v, pa.float64()) for k, v in numbers.items()})


NONE = np.zeros(0, int), np.zeros(0, int)


def best(kind: str, n: int, unrated: bool, passing: bool) -> Callable[[Users, Items], pa.Table]:
    """The first n wanted items of each user in the block: `user_id`, `item`, `score`. Ties by item."""
    exact = SCORES[kind][1]

    def work(users: Users, items: Items) -> pa.Table:
        found, float_ = [NONE + (np.zeros(0),)], real(users, items)
        rated = named(items, *users.rated) if unrated and users.rated is not None else NONE
        for span, view in views(users, items, passing):
            for at in spans(span, view):
                scores, slack = approximate(kind, users, view, at, float_)
                scores[view.without(rated, at)] = -np.inf
                r, c, score = first_items(users, view, at, scores, slack, exact, n)
                found.append((r, view.cols[c], score))
        r, c, score = map(np.concatenate, zip(*found))
        return answer(users, items, r, c, score=score)

    return work


#: Per value, below: the square of a spread that is rounding alone.
NOISE = 1e-28


def spreads(kinds: list[str]) -> Callable[[Users, Items], pa.Table]:
    """`user_id`, `_n`, and `_m<i>`, `_s<i>` (mean, sum of squared differences) of each kind of score over the block."""
    rough = {"cosine": cosine} | {k: f for k, (f, _) in SCORES.items()}

    def work(users: Users, items: Items) -> pa.Table:
        out = {"_n": np.full(users.size, float(items.size))}
        out |= {f"_{name}{i}": np.empty(users.size) for i in range(len(kinds)) for name in "ms"}
        for at in tiles(users, items):
            for i, kind in enumerate(kinds):
                scores = rough[kind](users, items, at)
                out[f"_m{i}"][at] = mean = scores.mean(1)
                scores -= mean[:, None]
                square = np.einsum("ij,ij->i", scores, scores)
                out[f"_s{i}"][at] = np.where(square > NOISE * items.size, square, 0)
        return answer(users, None, np.arange(users.size), None, **out)

    return work


def merged(parts: DataFrame, size: int) -> DataFrame:
    """`user_id`, `_n`, `_mean`, `_square` (arrays) from `_n`, `_m<i>`, `_s<i>` per block, merged pairwise: equal values stay without spread."""
    arrays = [f"array({', '.join(f'_{name}{i}' for i in range(size))})" for name in "ms"]
    step = (
        "(a, b) -> named_struct('n', a.n + b.n, 'm', zip_with(a.m, b.m, (x, y) -> x + (y - x) * b.n / (a.n + b.n)),"
        " 's', transform(a.s, (v, i) -> v + b.s[i] + (b.m[i] - a.m[i]) * (b.m[i] - a.m[i]) * a.n * b.n / (a.n + b.n)))"
    )
    listed = parts.where("_n > 0").groupBy("user_id").agg(
        F.expr(f"array_sort(collect_list(named_struct('n', _n, 'm', {arrays[0]}, 's', {arrays[1]})))").alias("_l")
    )
    whole = listed.selectExpr("user_id", f"aggregate(slice(_l, 2, size(_l)), _l[0], {step}) AS _w")
    return whole.selectExpr("user_id", "_w.n AS _n", "_w.m AS _mean", "_w.s AS _square")


#: What rounding can change of a rough score, at most.
SLACK = 1e-9
#: Ranks named on either side of a wanted one.
RANKS = 12


def ranks(kind: str, q: float) -> Callable[[Users, Items], pa.Table]:
    """Rough scores of each user's unrated items around their `q` quantile in the block: `_n`, `_k<i>` (ranks from 0) and `_v<i>`.

    The two ranks next to the quantile are among them; the others lie so far apart that the quantile
    over all blocks is between them but for chance, if items are spread at random.
    """
    rough, _ = SCORES[kind]

    def work(users: Users, items: Items) -> pa.Table:
        step = int(np.ceil(4.5 * np.sqrt(q * (1 - q) * items.size) / RANKS))
        apart = np.r_[-step * np.arange(RANKS, 0, -1), 0, 1, 1 + step * np.arange(1, RANKS + 1)]
        count, at_rank = np.zeros(users.size), np.zeros((users.size, len(apart)), int)
        value, mask = np.zeros(at_rank.shape), wanted(users, items)
        for at in tiles(users, items):
            scores, good = rough(users, items, at), mask(at)
            scores[~good] = np.inf
            scores.sort(1)
            count[at] = n = good.sum(1)
            middle = np.floor(q * np.maximum(n - 1, 0)).astype(int)
            at_rank[at] = k = np.clip(middle[:, None] + apart, 0, np.maximum(n - 1, 0)[:, None])
            value[at] = np.take_along_axis(scores, k, 1)
        some = np.flatnonzero(count)
        numbers = {f"_k{i}": at_rank[some, i] for i in range(len(apart))} | {f"_v{i}": value[some, i] for i in range(len(apart))}
        return answer(users, None, some, None, _n=count[some], **numbers)

    return work


def between(kind: str) -> Callable[[Users, Items], pa.Table]:
    """Different exact scores `_s` of unrated items from the user's `_lo` to `_hi`, with `_c` items each, and how many
    items are below, as a score of minus infinity."""
    rough, exact = SCORES[kind]

    def work(users: Users, items: Items) -> pa.Table:
        low, high = doubles(users.table.column("_lo")) - SLACK, doubles(users.table.column("_hi")) + SLACK
        rows, values, counts = [], [], []
        mask = wanted(users, items)
        for at in tiles(users, items):
            scores, good = rough(users, items, at), mask(at)
            under = scores < low[at, None]
            r, c = np.nonzero(good & ~under & (scores <= high[at, None]))
            r += at.start
            score = exact(users, items, r, c)
            order = np.lexsort((score, r))
            r, score = r[order], score[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (score[1:] != score[:-1])][: len(r)])
            below = (good & under).sum(1)
            some = np.flatnonzero(below)
            rows += [r[first], some + at.start]
            values += [score[first], np.full(len(some), -np.inf)]
            counts += [np.diff(np.r_[first, len(r)]), below[some]]
        r, score, count = map(np.concatenate, (rows, values, counts))
        return answer(users, None, r, None, _s=score, _c=count)

    return work


def removals(kind: str, missing: float) -> Callable[[Users, Items], pa.Table]:
    """Unrated items of at least the user's `_cut` whose known value `g<i>` is under the threshold `t<i>`: `_i<i>`."""
    rough, exact = SCORES[kind]

    def work(users: Users, items: Items) -> pa.Table:
        cut, mask = doubles(users.table.column("_cut")), wanted(users, items)
        size, known = users.t.shape[1], items.g != missing
        change = np.flatnonzero(np.r_[True, (users.t[1:] != users.t[:-1]).any(1)])
        counts = np.zeros((users.size, size))
        fails = None
        for at in tiles(users, items):
            scores, good = rough(users, items, at), mask(at)
            with np.errstate(invalid="ignore"):
                far = scores - cut[at, None]
            r, c = np.nonzero(good & (np.abs(far) <= SLACK))
            good &= far >= 0
            good[r, c] = exact(users, items, r + at.start, c) >= cut[r + at.start]
            # Users with equal thresholds are neighbours, so a tile has few sets of them.
            for start in np.unique(np.r_[at.start, change[(change > at.start) & (change < at.stop)]]):
                after = change[change > start]
                stop = min(at.stop, after[0] if len(after) else at.stop)
                if fails is None or (fails[0] != users.t[start]).any():
                    fails = users.t[start], ((items.g < users.t[start]) & known).astype(np.float32)
                counts[start:stop] = good[start - at.start : stop - at.start].astype(np.float32) @ fails[1]
        return answer(users, None, np.arange(users.size), None, **{f"_i{i}": counts[:, i] for i in range(size)})

    return work


def moments(kind: str, unrated: bool, passing: bool) -> Callable[[Users, Items], pa.Table]:
    """Of the wanted items of each user: `_n`, `_m<i>`, `_s<i>` of the values, and the best `item` with `_score` and its values `_x<i>`.

    The sums are those of the view less those of what the user has rated.
    """
    exact = SCORES[kind][1]

    def work(users: Users, items: Items) -> pa.Table:
        size, float_ = items.x.shape[1], real(users, items)
        rated = named(items, *users.rated) if unrated and users.rated is not None else NONE
        count, mean, square = np.zeros(users.size), np.zeros((users.size, size)), np.zeros((users.size, size))
        found = [NONE + (np.zeros(0),)]
        for span, view in views(users, items, passing):
            people = span.stop - span.start
            middle = view.x.mean(0)
            moved = view.x - middle
            both = np.column_stack([moved, moved * moved])
            r, c = gone = view.without(rated, span)
            n = view.size - np.bincount(r, minlength=people)
            total = both.sum(0)
            sums = total - np.column_stack([np.bincount(r, both[c, i], people) for i in range(2 * size)])
            some = np.maximum(n, 1)[:, None]
            m = sums[:, :size] / some
            s = sums[:, size:] - m * m * some
            m += middle
            # Little is left of a difference of sums: these few are looked at value by value.
            equal = (view.x == view.x[0]).all(0)
            m[:, equal], s[:, equal] = view.x[0, equal], 0
            close = (s <= 1e-6 * np.maximum(sums[:, size:], total[size:])) & (n > 0)[:, None] & ~equal
            for row in np.flatnonzero(close.any(1)):
                low, high = np.searchsorted(r, [row, row + 1])
                x = np.delete(view.x, c[low:high], axis=0)[:, close[row]]
                m[row, close[row]] = middle = x[0] + (x - x[0]).mean(0)
                s[row, close[row]] = np.square(x - middle).sum(0)
            count[span], mean[span], square[span] = n, m, s
            for at in spans(span, view):
                scores, slack = approximate(kind, users, view, at, float_)
                scores[view.without(rated, at)] = -np.inf
                u, c, score = first_items(users, view, at, scores, slack, exact, 1)
                found.append((u, view.cols[c], score))
        r, c, score = map(np.concatenate, zip(*found))
        x = items.x[c]
        numbers = {"_n": count[r], "_score": score}
        for i in range(size):
            numbers |= {f"_m{i}": mean[r, i], f"_s{i}": square[r, i], f"_x{i}": x[:, i]}
        return answer(users, items, r, c, **numbers)

    return work


def picked(users: Users, items: Items) -> np.ndarray:
    """Directions of the picks of each user. Users with fewer picks repeat their last one, which changes no maximum."""
    size = items.x.shape[1]
    who, along = listed(users.table, "_along")
    have = np.bincount(who, minlength=users.size) // size
    starts = size * (np.cumsum(have) - have)
    spots = starts[:, None] + size * np.minimum(np.arange(have.max()), have[:, None] - 1)
    return doubles(along)[spots[:, :, None] + np.arange(size)]


class Sides:
    """What likeness to a pick needs of a view and of its users (with means `m`, 1 / deviations `d`), as factors of products.

    Values count from their mean and in units of their reach: lengths are no small differences of large numbers.
    """

    def __init__(self, view: View, m: np.ndarray, d: np.ndarray, lam: float, fits: type):
        middle = view.x.mean(0)
        reach = np.abs(view.x - middle).max(0)
        reach[~(reach > 0)] = 1
        x = (view.x - middle) / reach
        self.view, self.lam, self.shift, self.scale = view, lam, (m - middle) / reach, d * reach
        short = fits is np.float32 and within(1e-8, 1e8, self.scale) and within(0, 1e8, self.shift)
        #: What rounding can change of a worth by its likeness.
        self.real, self.loss = (np.float32, 3e-5) if short else (np.float64, 1e-6)
        self.squares = np.ascontiguousarray(np.column_stack([x * x, x, np.ones(view.size)]).T, self.real)
        self.values = np.ascontiguousarray(np.column_stack([x, np.ones(view.size)]).T, self.real)
        dd = self.scale * self.scale
        self.origin = (self.shift * self.shift * dd).sum(1)
        self.lengths = np.column_stack([dd, -2 * self.shift * dd, self.origin]).astype(self.real)

    def aims(self, here: slice, along: np.ndarray) -> np.ndarray:
        """Times `values`: (1 - lambda) * likeness to the direction `along` * length."""
        aim = self.scale[here] * along
        return ((1 - self.lam) * np.column_stack([aim, -(aim * self.shift[here]).sum(1)])).astype(self.real)

    def length(self, here: slice, board: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Squared lengths, and where they are vague: a vector that is nearly the mean has no direction worth
        trusting before it is added up exactly."""
        length = self.view.product(self.lengths[here], self.squares, board)
        least = self.origin[here, None].astype(self.real) + self.real(1e-12)
        vague = NONE if (length.min(1, keepdims=True) > least).all() else np.nonzero(~(length > least))
        length[vague] = 1
        return length, vague


def directed(x: np.ndarray, m: np.ndarray, d: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the direction of `x`, and its likeness to the nearest of the row's `picks`."""
    v = (x - m) * d
    norm = np.sqrt(dot(v, v))[:, None]
    unit = np.where(norm != 0, v / np.where(norm != 0, norm, 1), 0)
    likeness = dot(unit, picks[:, 0])
    for j in range(1, picks.shape[1]):
        likeness = np.maximum(likeness, dot(unit, picks[:, j]))
    return unit, likeness


def leaders(kind: str, unrated: bool, passing: bool, lam: float, most: int) -> Callable[[Users, Items], pa.Table]:
    """The first `most` wanted items by lambda * score - (1 - lambda) * likeness to the nearest of the user's picks. Ties by item.

    `users` have the packed `_m` (mean, 1 / deviation), the items picked (`_taken`) and their directions, one
    after the other (`_along`). Returned are `item`, `score`, `_near`, the direction `v<i>`, and `_floor`: no other
    item of the block is worth more. Picked items and those without a key are left out.
    """
    exact = SCORES[kind][1]

    def work(users: Users, items: Items) -> pa.Table:
        rated = named(items, *users.rated) if unrated and users.rated is not None else NONE
        taken = named(items, *listed(users.table, "_taken"))
        size, picks = items.x.shape[1], picked(users, items)
        m, d, fits = matrix(users.table, "_m", "m"), matrix(users.table, "_m", "d"), real(users, items)
        found, floor = [], np.full(users.size, -np.inf)
        for span, view in views(users, items, passing):
            nameless = np.flatnonzero(view.code < 0)
            sides = Sides(view, m[span], d[span], lam, fits)
            for at in spans(span, view):
                here = slice(at.start - span.start, at.stop - span.start)
                worth, slack = approximate(kind, users, view, at, sides.real, lam)
                near = view.product(sides.aims(here, picks[at, 0]), sides.values, "near")
                for j in range(1, picks.shape[1]):
                    np.maximum(near, view.product(sides.aims(here, picks[at, j]), sides.values, "more"), out=near)
                length, vague = sides.length(here, "more")
                near /= np.sqrt(length, out=length)
                worth -= near
                unwanted = [view.without(rated, at), view.without(taken, at)]
                for pairs in unwanted:
                    worth[pairs] = -np.inf
                worth[:, nameless] = -np.inf
                bare = np.isneginf(worth[vague])
                worth[vague] = -np.inf
                r, c = leading(worth, most, slack + sides.loss)
                r, c = np.r_[r, vague[0][~bare]], np.r_[c, vague[1][~bare]]
                left = np.concatenate([p[0] * view.size + p[1] for p in unwanted])
                left = np.unique(left[view.code[left % view.size] >= 0]) // view.size
                count = view.size - len(nameless) - np.bincount(left, minlength=at.stop - at.start)
                u = r + at.start
                score = exact(users, view, u, c)
                unit, likeness = directed(view.x[c], m[u], d[u], picks[u])
                cost = (1 - lam) * likeness - lam * score
                order = np.lexsort((c, cost, r))
                rank = np.arange(len(r)) - np.searchsorted(r[order], r[order])
                order, rank = order[rank < most], rank[rank < most]
                last = (rank == most - 1) & (count[r[order]] > most)
                floor[u[order][last]] = -cost[order][last]
                found.append((u[order], view.cols[c[order]], score[order], likeness[order], unit[order]))
        if not found:
            return pa.table({})
        r, c, score, likeness, unit = map(np.concatenate, zip(*found))
        v = {f"v{i}": unit[:, i] for i in range(size)}
        return answer(users, items, r, c, score=score, _near=likeness, _floor=floor[r], **v)

    return work


def greedy(kind: str, unrated: bool, passing: bool, lam: float, n: int) -> Callable[[Users, Items], pa.Table]:
    """The picks after the first, for users who see the whole catalog in one block: `user_id`, `item`, `score`, `_rank`.

    `users` as for `leaders`, with their `_count` of wanted items: with n or fewer the rank is that of the score.
    """
    exact = SCORES[kind][1]

    def work(users: Users, items: Items) -> pa.Table:
        rated = named(items, *users.rated) if unrated and users.rated is not None else NONE
        taken = named(items, *listed(users.table, "_taken"))
        size, first = items.x.shape[1], picked(users, items)
        m, d, fits = matrix(users.table, "_m", "m"), matrix(users.table, "_m", "d"), real(users, items)
        few = doubles(users.table.column("_count")) <= n
        found = [NONE + (np.zeros(0), np.zeros(0))]
        for span, view in views(users, items, passing):
            sides, order = Sides(view, m[span], d[span], lam, fits), np.argsort(view.code, kind="stable")
            nameless = np.flatnonzero(view.code < 0)
            for at in spans(span, view):
                here, people = slice(at.start - span.start, at.stop - span.start), at.stop - at.start
                worth, slack = approximate(kind, users, view, at, sides.real, lam)
                for pairs in (view.without(rated, at), view.without(taken, at)):
                    worth[pairs] = -np.inf
                worth[:, nameless] = -np.inf
                near = view.product(sides.aims(here, first[at, 0]), sides.values, "near")
                length, vague = sides.length(here, "length")
                np.sqrt(length, out=length)
                doubt = np.stack(vague)[:, ~np.isneginf(worth[vague])]
                r, c = np.nonzero(worth[few[at]] > -np.inf)
                r = np.flatnonzero(few[at])[r]
                worth[vague] = -np.inf
                score = exact(users, view, r + at.start, c)
                by = np.lexsort((c, -score, r))
                r, c, score = r[by], c[by], score[by]
                rank = np.arange(len(r)) - np.searchsorted(r, r) + 2
                found.append((r[rank <= n] + at.start, view.cols[c[rank <= n]], score[rank <= n], rank[rank <= n]))
                worth[few[at]] = -np.inf
                doubt = doubt[:, ~few[at][doubt[0]]]
                picks = first[at, :1]
                for rank in range(2, n + 1):
                    net = np.divide(near, length, out=view.board("net", people, sides.real))
                    np.subtract(worth, net, out=net)
                    r, c = leading(net, 1, slack + sides.loss)
                    r, c = np.r_[r, doubt[0]], np.r_[c, doubt[1]]
                    u = r + at.start
                    score = exact(users, view, u, c)
                    unit, likeness = directed(view.x[c], m[u], d[u], picks[r])
                    by = np.lexsort((*unit.T[::-1], view.code[c], (1 - lam) * likeness - lam * score, r))
                    by = by[np.flatnonzero(np.diff(r[by], prepend=-1))]
                    r, c = r[by], c[by]
                    found.append((u[by], view.cols[c], score[by], np.full(len(by), float(rank))))
                    # Every row of the item is taken.
                    low, high = (np.searchsorted(view.code[order], view.code[c], side) for side in ("left", "right"))
                    for i in range(int((high - low).max(initial=0))):
                        more = low + i < high
                        worth[r[more], order[low[more] + i]] = -np.inf
                    new = np.full(people, -1)
                    new[r] = view.code[c]
                    doubt = doubt[:, view.code[doubt[1]] != new[doubt[0]]]
                    along = picks[:, -1].copy()
                    along[r] = unit[by]
                    picks = np.concatenate([picks, along[:, None]], 1)
                    if rank < n:
                        np.maximum(near, view.product(sides.aims(here, along), sides.values, "more"), out=near)
        r, c, score, rank = map(np.concatenate, zip(*found))
        return answer(users, items, r, c, score=score, _rank=rank)

    return work


def nearest_cells(left: DataFrame, donors: DataFrame, size: int, k: int, blocks: int | None = None) -> DataFrame:
    """`_id`, `_c`, `_d`, `_key`, `_v`: for each gap `_q<c>` of a left row the k nearest donors of every block that know `_d<c>`.

    `left` has `_id` and `_q<i>`, `donors` `_key` and `_d<i>` (doubles or integers). Distances are over what both rows
    know, added up as SQL does; ties by key, then by value.
    """
    people = max(1, left.count())
    blocks = blocks or max(1, -(-donors.count() // ITEMS))
    shards = max(-(-people // USERS), min(-(-people // 64), -(-2 * width(left) // blocks)))
    parts, keys = min(blocks * shards, 2 * width(left) + 1), ["_shard", "_block"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Rows without a key would all meet in one cell.
    spread = F.xxhash64("_id", *[f"_q{i}" for i in range(size)])
    sent = left.withColumn("_shard", F.pmod(spread, F.lit(shards)).cast("int")).withColumn("_block", numbers(blocks))
    placed = donors.withColumn("_block", block_of("_key", blocks)).withColumn("_shard", numbers(shards))
    kinds = [("_id", left.schema["_id"].dataType), ("_c", T.IntegerType()), ("_d", T.DoubleType()), ("_key", donors.schema["_key"].dataType), ("_v", T.DoubleType())]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return nearest(a, b, size, k) if a.num_rows and b.num_rows else pa.table({})

    pairs = sent.repartition(parts, *keys).groupBy(*keys).cogroup(placed.repartition(parts, *keys).groupBy(*keys))
    return pairs.applyInArrow(run, T.StructType([T.StructField(n, t) for n, t in kinds]))


def nearest(left: pa.Table, donors: pa.Table, size: int, k: int) -> pa.Table:
    donors = donors.take(pc.sort_indices(donors, sort_keys=[("_key", "ascending")], null_placement="at_start"))
    key = donors.column("_key").combine_chunks()
    code = np.asarray(pc.fill_null(pc.index_in(key, value_set=key.drop_null().unique()), -1))
    sides = [[t.column(f"_{letter}{i}") for i in range(size)] for t, letter in ((left, "q"), (donors, "d"))]
    (q, d), (q_known, d_known) = ([np.column_stack([f(c) for c in side]) for side in sides] for f in (doubles, lambda c: np.asarray(c.is_valid())))
    # Distances that are no numbers come last; they are sorted without preselection.
    plain = within(0, 1e150, q[q_known], d[d_known])
    q_kinds, d_kinds = (np.unique(m, axis=0) for m in (q_known, d_known))
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for has in q_kinds:
        rows = np.flatnonzero((q_known == has).all(1))
        for wanted in np.flatnonzero(~has):
            near = []
            for knows in d_kinds:
                both = np.flatnonzero(has & knows)
                if not knows[wanted] or not len(both):
                    continue
                spots = np.flatnonzero((d_known == knows).all(1))
                step = max(1, (WIDE if plain else TILE >> 3) // len(spots))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    far = np.zeros((len(some), len(spots)))
                    for j in both:
                        apart = q[some, j, None] - d[spots, j]
                        far += np.multiply(apart, apart, out=apart)
                    far = np.sqrt(size * far / len(both))
                    r, c = leading(-far, k, np.zeros(len(some))) if plain else np.divmod(np.arange(far.size), len(spots))
                    near.append((some[r], spots[c], far[r, c]))
            if near:
                r, c, far = map(np.concatenate, zip(*near))
                order = np.lexsort((d[c, wanted], code[c], far, r))
                r, c, far = r[order], c[order], far[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                found.append((r[first], c[first], np.full(int(first.sum()), wanted), far[first]))
    r, c, wanted, far = map(np.concatenate, zip(*found))
    return pa.table({
        "_id": left.column("_id").take(pa.array(r)), "_c": pa.array(wanted, pa.int32()), "_d": far,
        "_key": key.take(pa.array(c)), "_v": d[c, wanted],
    })
