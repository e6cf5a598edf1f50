"""Content, similarity and hybrid scores, and their explanation.

State lives in one row per user. A step that needs something about all of a user's scores
(spread, largest distance, best item) sends the user rows past the catalog and aggregates the
pairs as they arise, by user; the next step computes the scores again from the state. Scores are
a few multiplications, so this is far cheaper than sorting or storing users x items rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.config import Settings
from rankflow.functions import cells as C
from rankflow.functions import expr as X
from rankflow.functions.blocks import meet, meet_rows, place, rated_cells
from rankflow.operators.profile import mapped_features, mapping_table
from rankflow.operators.scale import z_scores
from rankflow.session import store

DEFAULTS = Settings()


def by_user():
    return Window.partitionBy("user_id")


# Users and items meet as packed rows: numbers that are never NULL, so that the code generated for
# a pair stays small enough to be compiled. `_i` (item): c = clipped value or 0, k = value known,
# x = value or 0, u = direction of the z-vector. `_u` (user): w = weight or 0, q = direction of the
# liked prototype, wc and ws = the two shares.


def _packed(name: str, fields: dict[str, str]) -> Column:
    return F.expr(f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())}) AS {name}")


def pack_items(items: DataFrame, features: list[str], normalize: bool = True) -> DataFrame:
    """`item`, `_i` (and the columns of `items`, for results)."""
    z = X.named("z_", features)
    fields = {}
    for i, f in enumerate(features):
        clipped = f"greatest(0D, least(1D, {f}))" if normalize else f"coalesce({f}, 0D)"
        fields[f"c{i}"] = f"IF({f} IS NULL, 0D, {clipped})"
        fields[f"k{i}"] = f"IF({f} IS NULL, 0D, 1D)"
        fields[f"x{i}"] = f"coalesce({f}, 0D)"
        fields[f"u{i}"] = f"coalesce(try_divide({z[i]}, {X.norm(z)}), 0D)" if z[i] in items.columns else "0D"
    return items.withColumn("_i", _packed("_i", fields))


def pack_weights(features: list[str], shares: bool = False) -> Column:
    """`_u` from `weight_<f>` (and, with shares, `proto_<f>` and the two share columns)."""
    p = X.named("proto_", features)
    fields = {f"w{i}": f"IF(weight_{f} > 0, weight_{f}, 0D)" for i, f in enumerate(features)}
    if shares:
        fields |= {f"q{i}": f"coalesce(try_divide({c}, {X.norm(p)}), 0D)" for i, c in enumerate(p)}
        fields |= {"wc": "coalesce(content_weight, 1D)", "ws": "coalesce(similarity_weight, 0D)"}
    return _packed("_u", fields)


def repack(df: DataFrame, name: str) -> DataFrame:
    """Tell the optimizer again, after a table was stored, that a packed column has no NULL."""
    fields = {f.name: f"coalesce({name}.{f.name}, 0D)" for f in df.schema[name].dataType.fields}
    return df.withColumn(name, _packed(name, fields))


def repack_all(df: DataFrame) -> DataFrame:
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            df = repack(df, f.name)
    return df


def content_sql(features: list[str]) -> str:
    """Weighted mean of the known features with a positive weight."""
    ids = range(len(features))
    top = X.dot([f"_u.w{i}" for i in ids], [f"_i.c{i}" for i in ids])
    bottom = X.dot([f"_u.w{i}" for i in ids], [f"_i.k{i}" for i in ids])
    return f"coalesce(try_divide({top}, {bottom}), 0D)"


def cosine_sql(features: list[str]) -> str:
    ids = range(len(features))
    return f"greatest(0D, least(1D, {X.dot([f'_u.q{i}' for i in ids], [f'_i.u{i}' for i in ids])}))"


def score_sql(features: list[str]) -> str:
    """Hybrid score; a user without a prototype has similarity 0 at share 0."""
    return f"(_u.wc * {content_sql(features)} + _u.ws * {cosine_sql(features)})"


def passes_sql(features: list[str]) -> str:
    return " AND ".join(f"_g.g{i} >= _t.t{i}" for i in range(len(features)))


def plain_sql(features: list[str]) -> str:
    """Dot product of weights and values as they are."""
    ids = range(len(features))
    return X.dot([f"_u.w{i}" for i in ids], [f"_i.x{i}" for i in ids])


UNRATED = "NOT coalesce(array_contains(_rated, item), false)"


def matrix_work(users: DataFrame, score: str, wanted: str) -> tuple[str, bool, bool] | None:
    """(kind of score, unrated only, passing only) if matrices can do both expressions; others are left to SQL."""
    names = [f.name for f in users.schema["_u"].dataType.fields]
    features = [c for c in names if c[0] == "w" and c[1:].isdigit()]
    kinds = {content_sql(features): "content", plain_sql(features): "plain"}
    if "wc" in names:
        kinds[score_sql(features)] = "hybrid"
    passes = passes_sql(features)
    tests = {"true": (False, False), UNRATED: (True, False), f"{UNRATED} AND {passes}": (True, True), passes: (False, True)}
    return (kinds[score], *tests[wanted]) if score in kinds and wanted in tests else None


def content_score(features: list[str], scaling: str = "linear") -> Column:
    return X.scale_score(F.expr(content_sql(features)), scaling)


def content_users(profiles: DataFrame, features: list[str]) -> DataFrame:
    return profiles.select("user_id", pack_weights(features))


def content_scores(
    profiles: DataFrame, items: DataFrame, features: list[str], scaling: str = "linear", normalize: bool = True
) -> DataFrame:
    catalog = pack_items(items.select("item", *features), features, normalize).select("item", "_i")
    pairs = meet_rows(place(content_users(profiles, features)), catalog, "item")
    return pairs.select("user_id", "item", content_score(features, scaling).alias("score"))


def top_items(scores: DataFrame, n: int) -> DataFrame:
    """`rank` 1..n per user by score; ties by item."""
    order = by_user().orderBy(F.desc("score"), "item")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_pairs(
    users: DataFrame, items: DataFrame, score: str, n: int, wanted: str = "true", groups: int = 64,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Exact top n of `score` over all wanted pairs, sorting only pairs that can be among them.

    Items fall into `groups` hash groups. The n-th largest of a user's group maxima is reached by n
    different items, so nothing below it can be in the top n. `users` is placed by user.

    The scores of this module are ranked in cells: a block hands on n items a user.
    """
    known = matrix_work(users, score, wanted)
    if known:
        kind, unrated, passing = known
        slim = users.where("user_id IS NOT NULL").select("user_id", "_u", *[c for c in ("_t", "_rated") if c in users.columns])
        packed = items.select("item", "_i", *["_g"] * passing)
        return top_items(C.meet_cells(slim, packed, C.best(kind, n, unrated, passing), ["user_id", "item"], ["score"], cells), n)
    catalog = items.withColumn("_group", F.pmod(F.xxhash64("item"), F.lit(max(groups, 4 * n))))
    best = (
        meet_rows(users, catalog, "item", cells)
        .where(wanted)
        .groupBy("user_id", "_group")
        .agg(F.expr(f"max({score})").alias("_best"))
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list("_best"), asc=False).alias("_bests"))
        .select("user_id", F.get("_bests", F.lit(n - 1)).alias("_floor"))
    )
    near = (
        meet_rows(users.join(best, "user_id"), items, "item", cells)
        .where(wanted)
        .selectExpr("user_id", "item", f"{score} AS score", "_floor")
        .where("_floor IS NULL OR score >= _floor")
    )
    return top_items(near.drop("_floor"), n)


def without_rated(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """Anti-join for stored score tables; the ranking jobs test the user's rated set instead."""
    return scores.join(ratings.select("user_id", "item"), ["user_id", "item"], "left_anti")


def content_ranking(
    profiles: DataFrame, ratings: DataFrame, items: DataFrame, features: list[str], n: int
) -> DataFrame:
    """Best n unrated items per user by content score."""
    # Stored: two passes read the state, and the cells are made from it.
    users = store(content_users(profiles, features), "content-users")
    cells = store(rated_cells(users, ratings), "rated-cells")
    catalog = pack_items(items.select("item", *features), features).select("item", "_i")
    return top_pairs(place(repack_all(users)), catalog, content_sql(features), n, UNRATED, cells=cells)


def baseline_ranking(importance: DataFrame, items: DataFrame, mapping: dict[str, list[str]], n: int) -> DataFrame:
    """Plain ranker: importance / 10 per mapped feature, unnormalized dot product, top n."""
    features = mapped_features(mapping)
    rows = importance.join(F.broadcast(mapping_table(importance.sparkSession, mapping)), "category")
    weights = rows.groupBy("user_id").agg(
        *[F.expr(f"coalesce(sum(importance / 10D) FILTER (WHERE feature = '{f}'), 0D) AS weight_{f}") for f in features]
    )
    users = weights.select("user_id", pack_weights(features))
    catalog = pack_items(items.select("item", *features), features).select("item", "_i")
    return top_pairs(place(users), catalog, plain_sql(features), n)


def prototype(features: list[str]) -> list[Column]:
    """Mean z-vector of the liked items; NULL without any. Rounding residue (a user who likes
    everything has the zero vector) counts as 0, or its direction would be noise."""
    mean = "try_divide(sliked[{i}], n_liked)"
    return [
        F.expr(f"IF(abs({mean.format(i=i)}) < 1e-9D, 0D, {mean.format(i=i)})") for i in range(len(features))
    ]


def similarity_sql(features: list[str], metric: str = "cosine") -> str:
    """0-1 similarity of `z_<f>` and `proto_<f>`, NULL without a prototype; distances are relative
    to `_farthest`, the user's largest."""
    z, p = X.named("z_", features), X.named("proto_", features)
    if metric == "cosine":
        raw = X.cosine(z, p)
    elif metric in X.DISTANCES:
        raw = f"1D - {X.DISTANCES[metric](z, p)} / IF(_farthest > 0, _farthest, 1D)"
    else:
        raise ValueError(f"unknown similarity metric: {metric}")
    return f"IF({p[0]} IS NULL, NULL, greatest(0D, least(1D, {raw})))"


def similarity_scores(
    sums: DataFrame, items: DataFrame, features: list[str], metric: str = "cosine", targets: DataFrame | None = None
) -> DataFrame:
    """0-1 similarity of every item to the user's liked items; users without a liked item have no rows.

    `items` carries `z_<f>`; `targets` (`item`) limits the answer, not the scale of the scores.
    """
    catalog = items.select("item", *X.named("z_", features))
    users = place(
        sums.where("n_liked > 0").select(
            "user_id", *[p.alias(f"proto_{f}") for f, p in zip(features, prototype(features))]
        )
    )
    if metric in X.DISTANCES:
        distance = X.DISTANCES[metric](X.named("z_", features), X.named("proto_", features))
        farthest = meet_rows(users, catalog, "item").groupBy("user_id").agg(F.expr(f"max({distance})").alias("_farthest"))
        users = users.join(farthest, "user_id")
    if targets is not None:
        catalog = catalog.join(targets.select("item"), "item", "left_semi")
    pairs = meet_rows(users, catalog, "item")
    return pairs.selectExpr("user_id", "item", f"{similarity_sql(features, metric)} AS score")


def most_similar(
    items: DataFrame, references: DataFrame, features: list[str], top: int = 5, metric: str = "cosine"
) -> DataFrame:
    """`reference`, `rank`, `item`, `score`: nearest items of each reference item, itself left out."""
    refs = references.select(F.col("item").alias("user_id")).distinct()
    liked = refs.join(items.withColumnRenamed("item", "user_id"), "user_id").select(
        "user_id", F.lit(1).alias("n_liked"), F.array(*X.named("z_", features)).alias("sliked")
    )
    scores = similarity_scores(liked, items, features, metric).where("user_id <> item")
    return top_items(scores, top).withColumnRenamed("user_id", "reference")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, top: int = 5) -> DataFrame:
    """Cosine top-k over array columns; each query keeps k candidates per catalog block."""
    asked = queries.select(F.col(key).alias("reference"), F.col(vector).alias("_q"))
    near = meet(asked, vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v")), "_key")
    others = F.filter("_rows", lambda r: r["_key"] != F.col("reference"))
    entries = F.transform(
        others,
        lambda r: F.struct((-X.array_cosine(F.col("_q"), r["_v"])).alias("s"), r["_key"].alias("k")),
    )
    best = near.select("reference", F.explode(F.slice(F.array_sort(entries), 1, top)).alias("b"))
    order = Window.partitionBy("reference").orderBy("b.s", "b.k")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("reference", "rank", F.col("b.k").alias(key), (-F.col("b.s")).alias("score"))
    )


def adaptive_weights(
    confidence: Column, ratings: Column, content_var: Column, similarity_var: Column, settings: Settings = DEFAULTS
) -> tuple[Column, Column]:
    """Content and similarity share from confidence, number of ratings and score spread; they sum to 1."""
    base_c, base_s = F.lit(settings.content_weight), F.lit(settings.similarity_weight)
    content = F.when(confidence > 0.7, F.least(F.lit(0.8), base_c + 0.1)).otherwise(base_c)
    similar = F.when(confidence < 0.4, F.least(F.lit(0.7), base_s + 0.2)).otherwise(base_s)
    similar = similar * F.least(F.lit(1.0), ratings / F.lit(10.0))
    content_wins = content_var > F.lit(1.5) * similarity_var
    similar_wins = ~content_wins & (similarity_var > F.lit(1.5) * content_var)
    content = F.when(content_wins, content + 0.1).otherwise(content)
    similar = F.when(similar_wins, similar + 0.1).otherwise(similar)
    total = content + similar
    return F.coalesce(F.try_divide(content, total), content), F.coalesce(F.try_divide(similar, total), similar)


def catalog_of(items: DataFrame, features: list[str]) -> DataFrame:
    """`item`, features, whole-table z-scores and the packed `_i`."""
    z = X.named("z_", features)
    with_z = items if all(c in items.columns for c in z) else z_scores(items, features)
    return pack_items(with_z.select("item", *features, *z), features)


def variances(users: DataFrame, catalog: DataFrame, kinds: list[str], names: list[str]) -> DataFrame:
    """`user_id` and the population variance of each kind of score over the catalog, as `names`."""
    numbers = ["_n", *[f"_{name}{i}" for i in range(len(kinds)) for name in "ms"]]
    slim = users.where("user_id IS NOT NULL").select("user_id", "_u")
    parts = C.meet_cells(slim, catalog.select("item", "_i"), C.spreads(kinds), ["user_id"], numbers)
    return C.merged(parts, len(kinds)).selectExpr("user_id", *[f"_square[{i}] / _n AS {name}" for i, name in enumerate(names)])


def hybrid_users(
    profiles: DataFrame, catalog: DataFrame, features: list[str], settings: Settings = DEFAULTS, carry: list[str] | None = None
) -> DataFrame:
    """One placed row per user with the packed `_u`, `confidence`, `num_ratings`, `_blend` and the shares.

    The shares depend on the spread of both scores over the whole catalog, found in one pass.
    Users without any weight have no row. `carry` names further profile columns to keep.
    """
    blend = (
        F.lit(settings.use_similarity)
        & (F.col("n_given") >= settings.min_ratings_for_similarity)
        & (F.col("confidence") >= settings.similarity_confidence)
        & (F.col("n_liked") > 0)
    )
    known = profiles.where(" OR ".join(f"weight_{f} IS NOT NULL" for f in features)).select(
        "user_id", "confidence", F.col("n_given").alias("num_ratings"), F.coalesce(blend, F.lit(False)).alias("_blend"),
        *[F.when(blend, p).alias(f"proto_{f}") for f, p in zip(features, prototype(features))],
        *X.named("weight_", features), F.lit(1.0).alias("content_weight"), F.lit(0.0).alias("similarity_weight"),
        *(carry or []),
    )
    users = place(known.select("user_id", "confidence", "num_ratings", "_blend", pack_weights(features, True), *(carry or [])))
    # Only blended users need the pass over the catalog.
    spread = variances(users.where("_blend"), catalog, ["content", "cosine"], ["_vc", "_vs"])
    spread = users.join(spread, "user_id", "left")
    wc, ws = adaptive_weights(F.col("confidence"), F.col("num_ratings"), F.col("_vc"), F.col("_vs"), settings)
    shared = spread.withColumns(
        {
            "content_weight": F.when(F.col("_blend"), wc).otherwise(F.lit(1.0)),
            "similarity_weight": F.when(F.col("_blend"), ws).otherwise(F.lit(0.0)),
        }
    ).drop("_vc", "_vs")
    fields = [f.name for f in users.schema["_u"].dataType.fields if f.name not in ("wc", "ws")]
    return shared.withColumn(
        "_u",
        _packed(
            "_u",
            {n: f"_u.{n}" for n in fields}
            | {"wc": "coalesce(content_weight, 1D)", "ws": "coalesce(similarity_weight, 0D)"},
        ),
    )


def strategy() -> Column:
    return F.when(F.col("_blend"), "hybrid").otherwise("content_only")


def hybrid_scores(
    profiles: DataFrame, items: DataFrame, features: list[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """All pairs with `score`, its two parts, their shares and the `strategy`."""
    catalog = catalog_of(items, features)
    users = hybrid_users(profiles, catalog, features, settings)
    pairs = meet_rows(users, catalog.select("item", "_i"), "item")
    return pairs.selectExpr(
        "user_id", "item", "num_ratings", "confidence", "content_weight", "similarity_weight", "_blend",
        f"{content_sql(features)} AS content_score", f"IF(_blend, {cosine_sql(features)}, NULL) AS similarity_score",
        f"{score_sql(features)} AS score",
    ).withColumn("strategy", strategy()).drop("_blend")


def combine_scores(content: DataFrame, similar: DataFrame, content_weight: float, similarity_weight: float) -> DataFrame:
    """Weighted sum of two stored score tables; a pair missing on one side counts 0 there."""
    return content.withColumnRenamed("score", "_c").join(
        similar.withColumnRenamed("score", "_s"), ["user_id", "item"], "full"
    ).select(
        "user_id", "item",
        (
            F.lit(content_weight) * F.coalesce("_c", F.lit(0.0)) + F.lit(similarity_weight) * F.coalesce("_s", F.lit(0.0))
        ).alias("score"),
    )


def score_confidence(
    profiles: DataFrame, items: DataFrame, features: list[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """0.1-1 per user: base by strategy x spread of the scores x rating count x user confidence."""
    catalog = catalog_of(items, features)
    users = hybrid_users(profiles, catalog, features, settings)
    spread = variances(users, catalog, ["hybrid"], ["_v"])
    spread = users.join(spread, "user_id")
    raw = (
        F.when(F.col("_blend"), 0.8).otherwise(0.6)
        * F.least(F.lit(1.0), F.col("_v") * 4)
        * F.when(F.col("num_ratings") > 0, F.least(F.lit(1.0), F.col("num_ratings") / F.lit(8.0))).otherwise(1.0)
        * F.when(F.col("_blend"), F.col("confidence")).otherwise(0.5)
    )
    return spread.select("user_id", X.clip(raw, 0.1, 1.0).alias("score_confidence"))


def explain_scores(
    pairs: DataFrame, profiles: DataFrame, items: DataFrame, features: list[str], liked: DataFrame | None = None
) -> DataFrame:
    """Per (user, item, feature): content contribution and likeness to the user's liked items.

    `pairs` (`user_id`, `item`) are the results to explain; `items` carries `z_<f>`; `liked`
    (`user_id`, `item`) are ratings of 3.5 stars and more.
    """
    z = X.named("z_", features)
    rows = pairs.join(profiles.select("user_id", *X.named("weight_", features)), "user_id").join(
        items.select("item", *features, *z), "item"
    )
    if liked is None:
        rows = rows.selectExpr("*", *[f"double(NULL) AS proto_{f}" for f in features])
    else:
        means = liked.join(items.select("item", *z), "item").groupBy("user_id").agg(
            *[F.avg(f"z_{f}").alias(f"m_{f}") for f in features]
        )
        proto = means.selectExpr("user_id", *[f"IF(abs(m_{f}) < 1e-9D, 0D, m_{f}) AS proto_{f}" for f in features])
        rows = rows.join(proto, "user_id", "left")
    rows = rows.withColumn("_total", X.total(f"coalesce(weight_{f}, 0D)" for f in features))

    def entry(f: str) -> Column:
        t, p = f"z_{f}", f"proto_{f}"
        part = f"IF(weight_{f} > 0, try_divide(weight_{f}, _total) * greatest(0D, least(1D, {f})), NULL)"
        apart = f"abs({t} - {p}) / (greatest(abs({t}), abs({p})) + 1e-10D)"
        like = f"IF(abs({t}) < 1e-10D AND abs({p}) < 1e-10D, 1D, greatest(0D, 1D - {apart}))"
        return F.expr(
            f"named_struct('feature', '{f}', 'contribution', IF({f} IS NOT NULL, {part}, NULL),"
            f" 'feature_similarity', IF({p} IS NOT NULL, {like}, NULL))"
        )

    return rows.select("user_id", "item", F.explode(F.array(*[entry(f) for f in features])).alias("e")).select(
        "user_id", "item", "e.*"
    )
