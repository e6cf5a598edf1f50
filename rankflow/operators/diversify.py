"""Diversity-aware re-ranking (maximal marginal relevance) and diversity measures."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.functions import cells as C
from rankflow.functions import expr as X
from rankflow.functions.blocks import meet_rows, place
from rankflow.operators.scoring import _packed, matrix_work, repack_all, top_items
from rankflow.session import store

DEFAULTS = Settings()


def by_user():
    return Window.partitionBy("user_id")


def candidate_z(candidates: DataFrame, features: list[str], prefix: str = "z_") -> DataFrame:
    """z-scores within each user's candidate set (population std, missing = 0, constant -> 0)."""
    over = "OVER (PARTITION BY user_id)"
    moments = candidates.selectExpr(
        "*",
        *[f"avg(coalesce({f}, 0D)) {over} AS _m_{f}" for f in features],
        *[f"stddev_pop(coalesce({f}, 0D)) {over} AS _d_{f}" for f in features],
    )
    return moments.selectExpr(
        *candidates.columns,
        *[f"coalesce(try_divide(coalesce({f}, 0D) - _m_{f}, _d_{f}), 0D) AS {prefix}{f}" for f in features],
    )


@dataclass(frozen=True)
class Candidates:
    """A table of scored pairs as what it is made of: users (`user_id`, `_u`) that meet a catalog (`item`, `_i`,
    features) where `wanted` holds. What a step learns about a user is put beside the user, not beside every pair."""

    users: DataFrame
    catalog: DataFrame
    score: str
    wanted: str
    cells: DataFrame | None = None

    def rows(self, features: list[str]) -> DataFrame:
        """`user_id`, `item`, `score` and the features of every pair."""
        pairs = meet_rows(self.users, self.catalog, "item", self.cells).where(self.wanted)
        return pairs.selectExpr("user_id", "item", f"{self.score} AS score", *features)


def mmr(
    candidates: DataFrame | Candidates, features: list[str], settings: Settings = DEFAULTS, n: int | None = None,
    metric: str = "cosine",
) -> DataFrame:
    """`user_id`, `rank`, `item`, `score`, `z_<f>` (direction of the item's vector): n picks per user, each the best of
    lambda * score - (1 - lambda) * greatest similarity to the picks so far; ties by item.

    A round is one window over the user's candidates: it finds the pick and hands its vector to
    every candidate, which keeps only its running similarity. No join, no shuffle between rounds.
    Without features, or with n candidates or fewer, the ranking is by score alone.

    Of `Candidates` only those worth a certified floor are rows (see `_certified`). Items without a key can be
    picked but never get a rank, so they are left to the windows, as are users without one and distances.
    """
    n = n or settings.top_n
    if isinstance(candidates, Candidates):
        keyed = candidates.catalog.where("item IS NULL").isEmpty() and candidates.users.where("user_id IS NULL").isEmpty()
        if features and metric == "cosine" and keyed:
            return _mmr_of(candidates, features, settings, n)
        candidates = candidates.rows(features)
    by_score = by_user().orderBy(F.desc("score"), "item")
    if not features:
        return candidates.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n).select(
            "user_id", "rank", "item", "score"
        )
    over = "OVER (PARTITION BY user_id)"
    z, v = X.named("z_", features), [f"_v{i}" for i in range(len(features))]
    zed = candidate_z(candidates.select("user_id", "item", "score", *features), features)
    zed = zed.withColumn("_by_score", F.row_number().over(by_score)).selectExpr(
        "*", f"count(1) {over} AS _count", f"{X.norm(z)} AS _len"
    )
    # Cosine between unit vectors is a plain dot product; distances compare the z-vectors themselves.
    compared = "coalesce(try_divide({}, _len), 0D) AS {}" if metric == "cosine" else "{} AS {}"
    state = zed.selectExpr(
        "user_id", "item", "score", "_count", "_by_score", *[compared.format(c, n_) for c, n_ in zip(z, v)],
        "int(NULL) AS _rank", "double(NULL) AS _near", "double(NULL) AS _far",
    )
    picked = _rounds(state, v, settings, range(1, n + 1), f"_count > {n}", metric)
    return picked.selectExpr(
        "user_id", f"IF(_count > {n}, _rank, _by_score) AS rank", "item", "score",
        *[f"{c} AS {name}" for c, name in zip(v, z)],
    ).where(F.col("rank") <= n)


def _rounds(
    state: DataFrame, v: list[str], settings: Settings, numbers: range, able: str, metric: str = "cosine"
) -> DataFrame:
    """Greedy picks among candidate rows, one window a round: sets `_rank` and, where given, `_worth` of the picked rows
    and `_own` of the row that was picked itself (others may share its item)."""
    lam, over = settings.diversity_lambda, "OVER (PARTITION BY user_id)"
    penalty = "coalesce(_near, 0D)"
    if metric != "cosine":
        penalty = "IF(_near IS NULL, 0D, 1D - coalesce(try_divide(_near, _far), 0D))"
    worth = f"{1 - lam!r}D * {penalty} - {lam!r}D * score"
    offer = ", ".join(["'worth'", worth, "'item'", "item", *[f"'{c}', {c}" for c in v]])
    changing = {"_rank", "_near", "_far", "_worth", "_own"}
    for number in numbers:
        # Small candidate sets keep their score ranking and offer nothing.
        picked = state.selectExpr("*", f"min(IF(_rank IS NULL AND {able}, named_struct({offer}), NULL)) {over} AS _pick")
        p = [f"_pick.{c}" for c in v]
        new = {"_rank": f"IF(_pick.item = item, {number}, _rank)"}
        if metric == "cosine":
            new["_near"] = f"greatest(_near, {X.dot(v, p)})"
        else:
            distance = X.DISTANCES[metric](v, p)
            new |= {"_near": f"least(_near, {distance})", "_far": f"greatest(_far, {distance})"}
        if "_worth" in state.columns:
            new["_worth"] = "IF(_pick.item = item, -_pick.worth, _worth)"
        if "_own" in state.columns:
            new["_own"] = f"_own OR coalesce(_pick = named_struct({offer}), false)"
        fixed = [c for c in state.columns if c not in changing]
        state = picked.selectExpr(*fixed, *[f"{new.get(c, c)} AS {c}" for c in state.columns if c in changing])
    return state


def _mmr_of(candidates: Candidates, features: list[str], settings: Settings, n: int) -> DataFrame:
    """The ranking of candidates that are not a table yet: every row of a picked item, with its own score and direction."""
    users, score, ids = candidates.users.select("user_id", "_u"), candidates.score, range(len(features))
    catalog = candidates.catalog.select("item", "_i")
    state, picks = _certified(users, catalog, features, score, candidates.wanted, settings, n, candidates.cells)
    v = [f"((_i.x{i} - _m.m{i}) * _m.d{i})" for i in ids]
    scored = ["user_id", "rank", "item", f"{score} AS score", f"{X.norm(v)} AS _len", *[f"{c} AS _v{i}" for i, c in enumerate(v)]]
    directed = ["user_id", "rank", "item", "score", *[f"coalesce(try_divide(_v{i}, _len), 0D) AS z_{f}" for i, f in enumerate(features)]]
    many = state.where(f"_count > {n}").select("user_id", "_u", "_m")
    out = picks.select("user_id", "rank", "item").distinct().join(many, "user_id").join(catalog, "item").selectExpr(*scored)
    few = state.where(f"_count <= {n}").select("user_id", "_u", "_m")
    if not few.isEmpty():
        pairs = meet_rows(place(few), catalog, "item", candidates.cells).where(candidates.wanted).withColumn("rank", F.lit(0))
        out = out.unionByName(top_items(pairs.selectExpr(*scored), n).select(out.columns))
    return out.selectExpr(*directed)


#: Candidates that a user is meant to keep for each pick wanted.
KEPT = 16
#: Catalog rows a user's first floor is estimated from, at least.
SAMPLE = 128
#: Normal quantile for a small upper tail `p` (Hastings' rational approximation, error under 5e-4). Fixed values.
TAIL = (
    "(sqrt(-2 * ln({p})) - (2.515517D + 0.802853D * sqrt(-2 * ln({p})) + 0.010328D * (-2 * ln({p})))"
    " / (1 + 1.432788D * sqrt(-2 * ln({p})) + 0.189269D * (-2 * ln({p})) + 0.001308D * pow(-2 * ln({p}), 1.5D)))"
)


def _first_picks(
    users: DataFrame, catalog: DataFrame, features: list[str], score: str, wanted: str, cells: DataFrame | None
) -> DataFrame:
    """`users` with `_count`, `_top`, `_first`, the packed moments `_m` and the direction `_p` of the first pick."""
    ids = range(len(features))
    moments = meet_rows(users, catalog, "item", cells).where(wanted).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_count"), F.expr(f"max({score}) AS _top"),
        *[F.expr(f"avg(_i.x{i}) AS _a{i}") for i in ids],
        *[F.expr(f"stddev_pop(_i.x{i}) AS _d{i}") for i in ids],
    )
    spread = {f"m{i}": f"coalesce(_a{i}, 0D)" for i in ids} | {f"d{i}": f"coalesce(try_divide(1D, _d{i}), 0D)" for i in ids}
    known = users.join(moments, "user_id").select(*users.columns, "_count", "_top", _packed("_m", spread))
    state = place(repack_all(store(known, "moments")))
    v = [f"((_i.x{i} - _m.m{i}) * _m.d{i})" for i in ids]
    first = (
        meet_rows(state, catalog, "item", cells)
        .where(wanted)
        .where(f"{score} = _top")
        .selectExpr("user_id", "item", f"{X.norm(v)} AS _len", f"array({', '.join(v)}) AS _v")
        .groupBy("user_id")
        .agg(F.expr("min(named_struct('item', item, 'len', _len, 'v', _v)) AS _pick"))
    )
    direction = {f"v{i}": f"coalesce(try_divide(_pick.v[{i}], _pick.len), 0D)" for i in ids}
    state = state.join(first, "user_id").select(*state.columns, F.col("_pick.item").alias("_first"), _packed("_p", direction))
    return place(repack_all(store(state, "first-picks")))


def _first_in_cells(
    users: DataFrame, catalog: DataFrame, known: tuple[str, bool, bool], size: int, cells: DataFrame | None
) -> DataFrame:
    """The same from the moments and best items of whole cells."""
    names = ["_n", "_score", *[f"_{c}{i}" for i in range(size) for c in "msx"]]
    parts = store(C.meet_cells(_slim(users, known), _slim(catalog, known), C.moments(*known), ["user_id", "item"], names, cells), "block-moments")
    x = ", ".join(f"_x{i}" for i in range(size))
    pick = parts.groupBy("user_id").agg(F.expr(f"min(named_struct('s', -_score, 'item', item, 'x', array({x}))) AS _pick"))
    both = users.join(C.merged(parts, size), "user_id").join(pick, "user_id")
    spread = {f"m{i}": f"_mean[{i}]" for i in range(size)}
    spread |= {f"d{i}": f"coalesce(try_divide(1D, sqrt(_square[{i}] / _n)), 0D)" for i in range(size)}
    state = both.select(
        *users.columns, F.expr("CAST(_n AS bigint) AS _count"), F.expr("-_pick.s AS _top"), _packed("_m", spread),
        F.col("_pick.item").alias("_first"), F.col("_pick.x").alias("_x"),
    )
    v = [f"((_x[{i}] - _m.m{i}) * _m.d{i})" for i in range(size)]
    direction = {f"v{i}": f"coalesce(try_divide({v[i]}, {X.norm(v)}), 0D)" for i in range(size)}
    return place(repack_all(store(state.select(*[c for c in state.columns if c != "_x"], _packed("_p", direction)), "first-picks")))


def _slim(df: DataFrame, known: tuple[str, bool, bool], *more: str) -> DataFrame:
    """What cells need of users or of a catalog."""
    names = ["user_id", "item", "_u", "_i", "_rated", "_m", "_taken", "_along", *["_t", "_g"] * known[2], *more]
    slim = df.select(*[c for c in names if c in df.columns])
    return slim.where("user_id IS NOT NULL") if "user_id" in df.columns else slim


def mmr_over_catalog(
    users: DataFrame, catalog: DataFrame, features: list[str], score: str, wanted: str,
    settings: Settings = DEFAULTS, n: int | None = None, cells: DataFrame | None = None,
) -> DataFrame:
    """The same ranking (cosine) without a candidate table: candidates are the pairs where `wanted` holds."""
    return _certified(users, catalog, features, score, wanted, settings, n or settings.top_n, cells)[1]


#: Items a block of the catalog hands on for each user in a pass.
LEADERS = 8


def _picked_in_cells(
    users: DataFrame, catalog: DataFrame, features: list[str], score: str, known: tuple[str, bool, bool],
    settings: Settings, n: int, cells: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """What `_certified` returns, from the best few items of each cell.

    A pass hands on the items of each block that are worth most given the picks so far, and what the others are worth
    at most. A worth only falls as picks are added, so picks made among the items handed on are right while
    they are worth more than that, the first one always: a pass adds a pick or more for every user, and only
    users short of n go past the catalog again. In a catalog that a cell can hold, all picks are made in one pass.
    """
    ids, most, size = range(len(features)), max(LEADERS, n), len(features)
    names, able = [f"v{i}" for i in ids], f"_count > {n}"
    moments = _first_in_cells(users, catalog, known, size, cells)
    first = moments.selectExpr("user_id", "1 AS rank", "_first AS item", "_top AS score")
    if n == 1:
        return moments, first
    state = moments.selectExpr("*", "array(_first) AS _taken", f"array({', '.join(f'_p.{c}' for c in names)}) AS _along").drop("_top", "_first", "_p")
    if catalog.count() <= C.WHOLE:
        work = C.greedy(*known, settings.diversity_lambda, n)
        found = C.meet_cells(_slim(state, known, "_count"), _slim(catalog, known), work, ["user_id", "item"], ["score", "_rank"], cells, whole=True)
        new = found.groupBy("user_id").agg(
            F.expr("array_sort(collect_set(named_struct('rank', CAST(_rank AS int), 'item', item, 'score', score))) AS _new")
        )
        tried = store(state.select("user_id", "_u", "_count").join(new, "user_id"), "picks")
        few = tried.where(f"NOT {able}").selectExpr("user_id", "inline(_new)")
        # Every row of a picked item has its rank.
        chosen = tried.where(able).selectExpr("user_id", "_u", "explode(_new) AS p").selectExpr("user_id", "_u", "p.rank", "p.item")
        rows = chosen.join(catalog.select("item", "_i"), "item").selectExpr("user_id", "rank", "item", f"{score} AS score")
        return moments, first.unionAll(few).unionAll(rows)
    numbers = ["score", "_near", "_floor", *names]
    later, by_score = [], by_user().orderBy(F.desc("score"), "item")
    while not state.isEmpty():
        work = C.leaders(*known, settings.diversity_lambda, most)
        kept = C.meet_cells(_slim(state, known), _slim(catalog, known), work, ["user_id", "item"], numbers, cells)
        candidates = kept.join(state.select("user_id", "_count"), "user_id").selectExpr(
            "user_id", "item", "score", "_count", f"max(_floor) OVER (PARTITION BY user_id) AS _floor", *names,
            "int(NULL) AS _rank", "_near", "double(NULL) AS _worth", "false AS _own",
        )
        picked = _rounds(candidates, names, settings, range(1, n), able).withColumn("_by_score", F.row_number().over(by_score))
        new = picked.where(f"IF({able}, _own AND (_rank = 1 OR _worth > _floor), _by_score < {n})").groupBy("user_id").agg(
            F.expr(f"array_sort(collect_set(named_struct('rank', IF({able}, _rank, _by_score), 'item', item, 'score', score, 'v', array({', '.join(names)})))) AS _new")
        )
        # Without a further item there is no further pick.
        tried = store(state.join(new, "user_id").selectExpr("*", "size(_taken) AS _have"), "picks")
        later.append(tried.where(f"NOT {able}").selectExpr("user_id", "inline(_new)").selectExpr("user_id", "rank + 1 AS rank", "item", "score"))
        chosen = tried.where(able).selectExpr("user_id", "_u", "_have", "explode(_new) AS p").selectExpr("user_id", "_u", "p.rank + _have AS rank", "p.item")
        # Every row of a picked item has its rank.
        later.append(chosen.where(f"rank <= {n}").join(catalog.select("item", "_i"), "item").selectExpr("user_id", "rank", "item", f"{score} AS score"))
        more = {
            "_taken": "concat(_taken, transform(_new, p -> p.item)) AS _taken",
            "_along": "concat(_along, flatten(transform(_new, p -> p.v))) AS _along",
        }
        state = place(repack_all(tried.where(f"{able} AND _have + size(_new) < {n}").selectExpr(*[more.get(c, c) for c in state.columns])))
    return moments, functools.reduce(DataFrame.unionAll, [first, *later])


def _certified(
    users: DataFrame, catalog: DataFrame, features: list[str], score: str, wanted: str, settings: Settings, n: int,
    cells: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """`users` with the moments `_m` and `_count` of their candidates, and the picks (`user_id`, `rank`, `item`, `score`).

    The scores of `scoring` are looked at in cells (`_picked_in_cells`), others in SQL:

    Three passes over the pairs: the moments and the highest score of each user, the item that has
    it (the first pick), and the items worth at least a floor once the first pick is known. A
    worth only falls as picks are added, so if a later pick is worth the floor, no item under it can
    have been better: the picks made among the items kept are certified. The floor is estimated from
    a fixed part of the catalog, so that some `KEPT` items a pick remain; a user whose picks fall below
    it goes past the catalog again with a floor that these picks are worth, which certifies at least
    one more of them each time.
    """
    lam, ids = settings.diversity_lambda, range(len(features))
    known = matrix_work(users, score, wanted)
    if known:
        return _picked_in_cells(users, catalog, features, score, known, settings, n, cells)
    moments = state = _first_picks(users, catalog, features, score, wanted, cells)
    v = [f"((_i.x{i} - _m.m{i}) * _m.d{i})" for i in ids]
    first_picks = state.selectExpr("user_id", "1 AS rank", "_first AS item", "_top AS score")
    if n == 1:
        return moments, first_picks
    second = f"{lam!r}D * {score} - {1 - lam!r}D * coalesce(try_divide({X.dot(v, [f'_p.v{i}' for i in ids])}, {X.norm(v)}), 0D)"
    rest = f"({wanted}) AND item <> _first"
    items = catalog.count()
    every = max(1, items // max(SAMPLE, items // 64))
    part = catalog.where(F.pmod(F.xxhash64(F.lit("sample"), "item"), F.lit(every)) == 0)
    many = state.where(f"_count > {2 * KEPT * n}")
    rough = meet_rows(many, part, "item", cells).where(rest).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_seen"), F.expr(f"avg({second}) AS _mean"), F.expr(f"stddev_pop({second}) AS _dev")
    )
    tail = TAIL.format(p=f"({KEPT * n}D / _count)")
    state = store(
        state.join(rough, "user_id", "left").selectExpr(
            *state.columns, f"IF(coalesce(_seen, 0) < 8, double('-Infinity'), _mean + {tail} * _dev) AS _floor", "_dev"
        ),
        "floors",
    )
    kind = catalog.schema["item"].dataType.simpleString()
    none = f"CAST(array() AS array<struct<rank:int,item:{kind},score:double,worth:double>>)"
    done: list[DataFrame] = []
    while True:
        state = place(repack_all(state))
        names = [f"v{i}" for i in ids]
        unit = [f"coalesce(try_divide({c}, _len), 0D) AS v{i}" for i, c in enumerate(v)]
        kept = (
            meet_rows(state, catalog, "item", cells).where(rest).where(f"{second} >= _floor")
            .selectExpr("user_id", "item", f"{score} AS score", "_count", "_p", f"{X.norm(v)} AS _len", "_i", "_m")
            .selectExpr("user_id", "item", "score", "_count", "_p", *unit)
            .withColumn("_near", F.expr(X.dot(names, [f"_p.v{i}" for i in ids])))
        )
        candidates = kept.selectExpr(
            "user_id", "item", "score", "_count", *names, "int(NULL) AS _rank", "_near", "double(NULL) AS _worth"
        )
        picked = _rounds(candidates, names, settings, range(2, n + 1), f"_count > {n}")
        # With n candidates or fewer the ranking is by score alone.
        by_score = by_user().orderBy(F.desc("score"), "item")
        placed = picked.withColumn("_by_score", F.row_number().over(by_score) + 1).selectExpr(
            "user_id", "item", "score", "_worth", f"IF(_count > {n}, _rank, _by_score) AS rank"
        ).where(f"rank <= {n}")
        picks = placed.groupBy("user_id").agg(F.expr("array_sort(collect_list(named_struct('rank', rank, 'item', item, 'score', score, 'worth', _worth))) AS _picks"))
        tried = store(state.join(picks, "user_id", "left").withColumn("_picks", F.coalesce("_picks", F.expr(none))), "picks")
        # Rows that share an item share its rank.
        complete = f"size(array_distinct(transform(_picks, p -> p.rank))) >= least({n}, _count) - 1"
        sure = f"_floor = double('-Infinity') OR (({complete}) AND NOT exists(_picks, p -> p.worth < _floor))"
        done.append(tried.where(sure).select("user_id", "_picks"))
        lower = f"least(coalesce(array_min(transform(_picks, p -> p.worth)), _floor), IF({complete}, _floor, _floor - greatest(_dev, 1e-6D)))"
        # Who has too few different items gets no more of them by a lower floor: the steps grow, and end without a floor.
        new = {"_floor": f"IF({complete} OR {lower} > -2, {lower}, double('-Infinity')) AS _floor"}
        new["_dev"] = f"IF({complete}, _dev, 4 * greatest(_dev, 1e-6D)) AS _dev"
        state = tried.where(f"NOT ({sure})").selectExpr(*[new.get(c, c) for c in state.columns])
        if state.isEmpty():
            break
    later = functools.reduce(DataFrame.unionAll, done).select("user_id", F.explode("_picks").alias("p"))
    return moments, first_picks.unionByName(later.select("user_id", "p.rank", "p.item", "p.score"))


def diversity_score(selected: DataFrame, features: list[str]) -> DataFrame:
    """1 - mean pairwise cosine of each user's picks (`z_<f>`), clipped to [0, 1]; 1 below two picks.

    The sum over all pairs of unit vectors is |sum|^2 minus the diagonal, so no pair is formed.
    """
    z = X.named("z_", features)
    sums = selected.selectExpr("user_id", *z, f"{X.norm(z)} AS _len").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_len") > 0).alias("_diagonal"),
        *[F.expr(f"sum(coalesce(try_divide({c}, _len), 0D)) AS {c}") for c in z],
    )
    mean = f"try_divide({X.dot(z, z)} - _diagonal, n * (n - 1))"
    return sums.selectExpr("user_id", f"IF(n < 2, 1D, greatest(0D, least(1D, 1D - {mean}))) AS diversity_score")


def feature_diversity(selected: DataFrame, features: list[str]) -> DataFrame:
    """Coefficient of variation, range and level per (user, feature) over the recommended items."""
    parts = []
    for f in features:
        cv = F.coalesce(F.try_divide(F.stddev(f), F.avg(f)), F.lit(0.0))
        parts.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count(f).alias("known"),
                cv.alias("coefficient_of_variation"),
                F.min(f).alias("low"),
                F.max(f).alias("high"),
                F.when(cv > 0.2, "high").when(cv > 0.1, "moderate").otherwise("low").alias("diversity_level"),
            ).alias(f)
        )
    wide = selected.groupBy("user_id").agg(*parts)
    return wide.select("user_id", F.explode(F.array(*[F.col(f) for f in features])).alias("r")).select(
        "user_id", "r.*"
    ).where("known > 1").drop("known")


def set_size_label(selected: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return selected.groupBy("user_id").agg(
        n.alias("num_items"), F.when(n >= 5, "high").otherwise("moderate").alias("estimated_diversity")
    )


def clustering(selected: DataFrame, features: list[str]) -> DataFrame:
    """Mean pairwise distance of each user's z-scored recommendation list (three items or more).

    The list length is the number of recommendations asked for, so its vectors fit in one row.
    """
    zed = candidate_z(selected, features)
    vectors = zed.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(F.struct("item", F.array(*[F.col(f"z_{f}") for f in features]).alias("v")))
        ).alias("s")
    ).where(F.size("s") >= 3)

    def apart(a: Column, b: Column) -> Column:
        return F.sqrt(
            F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
        )

    def to_later(e: Column, i: Column) -> Column:
        later = F.slice("s", i + 2, F.size("s"))
        return F.aggregate(later, F.lit(0.0), lambda s, o: s + apart(e["v"], o["v"]))

    total = F.aggregate(F.transform("s", to_later), F.lit(0.0), lambda s, v: s + v)
    pairs = F.size("s") * (F.size("s") - 1) / 2
    mean = total / pairs
    return vectors.select(
        "user_id", mean.alias("average_pairwise_distance"),
        F.when(mean > 1.5, "diverse").otherwise("clustered").alias("clustering_tendency"),
        pairs.cast("long").alias("num_distances"),
    )


def diversity_analysis(selected: DataFrame, features: list[str]) -> DataFrame:
    """One row per user with two recommendations or more: size label, clustering, per-feature spread."""
    # Stored: three measures read it, and it may come from a pass over the catalog.
    selected = store(selected, "selected")
    per_feature = feature_diversity(selected, features).groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "diversity_level")))).alias(
            "feature_levels"
        )
    )
    return (
        set_size_label(selected)
        .where("num_items >= 2")
        .join(per_feature, "user_id", "left")
        .join(clustering(selected, features), "user_id", "left")
    )
