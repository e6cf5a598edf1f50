"""User profiles: stated weights, weights learned from ratings, and their blend.

A profile is one wide row per user. Ratings are reduced to additive sums before anything is
solved, so a user with very many ratings takes one row of memory and new ratings can be added.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.functions import expr as X
from rankflow.functions.blocks import place
from rankflow.session import store

DEFAULTS = Settings()


def mapping_table(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """`category`, `feature`, `n_features`, `place`: a fixed handful of rows."""
    rows = [(c, f, len(fs), i) for c, fs in mapping.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "category string, feature string, n_features int, place int")


def mapped_features(mapping: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(f for fs in mapping.values() for f in fs))


def available_features(mapping: dict[str, list[str]], items: DataFrame) -> list[str]:
    """The mapped features that the table has; weights on others count for nothing."""
    found = [f for f in mapped_features(mapping) if f in items.columns]
    if not found:
        raise ValueError(f"the items have none of the features {mapped_features(mapping)}")
    return found


def stated_weights(importance: DataFrame, mapping: dict[str, list[str]], settings: Settings = DEFAULTS) -> DataFrame:
    """Per user: `stated_<f>` summing to 1 (NULL: not mentioned), plus hard-constraint marks.

    `hard_<f>` is the last category that makes the feature a hard requirement and `place_<f>`
    its position among the user's requirements.
    """
    features = mapped_features(mapping)
    widest = max(map(len, mapping.values()), default=0) + 1
    rows = importance.join(F.broadcast(mapping_table(importance.sparkSession, mapping)), "category")
    rows = rows.select(
        "user_id", "feature", "category", "ord", (F.col("ord") * widest + F.col("place")).alias("_place"),
        (X.importance_weight(F.col("importance")) / F.col("n_features")).alias("_share"),
        (F.col("importance") >= settings.hard_importance).alias("_hard"),
    )
    sums = rows.groupBy("user_id").agg(
        *[F.expr(f"sum(_share) FILTER (WHERE feature = '{f}') AS w_{f}") for f in features],
        *[F.expr(f"max_by(category, ord) FILTER (WHERE feature = '{f}' AND _hard) AS hard_{f}") for f in features],
        *[F.expr(f"min(_place) FILTER (WHERE feature = '{f}' AND _hard) AS place_{f}") for f in features],
    )
    whole = sums.withColumns(
        {
            "_total": X.total(f"coalesce(w_{f}, 0D)" for f in features),
            "_named": X.total(f"int(w_{f} IS NOT NULL)" for f in features),
        }
    )
    return whole.selectExpr(
        "user_id",
        *[
            f"CASE WHEN w_{f} IS NULL THEN NULL WHEN _total = 0 THEN 1D / _named ELSE try_divide(w_{f}, _total) END"
            f" AS stated_{f}"
            for f in features
        ],
        *[f"hard_{f}" for f in features],
        *[f"place_{f}" for f in features],
    )


def valid_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.where(X.stars_in_range(F.col("rating")))


def rejected_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.where(~F.coalesce(X.stars_in_range(F.col("rating")), F.lit(False)))


#: Rows of a catalog that is sent to every executor, at most; a larger one meets the ratings in a shuffle by item.
SENT = 1 << 19


def rating_sums(
    ratings: DataFrame, items: DataFrame, features: list[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """Additive per-user sums of (features, rating): all that learning and similarity need.

    `items` may carry `z_<f>` columns; the liked centroid is summed over those if present.
    A rated item that is unknown counts as given, not as matched.
    """
    pairs = list(combinations_with_replacement(features, 2))
    z = [f"z_{f}" for f in features if f"z_{f}" in items.columns]
    z_values = [f"z_{f}" if f"z_{f}" in z else "0D" for f in features]
    known = items.selectExpr("item", *[f"coalesce({f}, 0D) AS {f}" for f in features], *z, "true AS _known")
    given = valid_ratings(ratings).selectExpr("user_id", "item", "rating * 0.2D AS _y")
    # By user go three numbers a rating, if that is possible, not the values of its item.
    if items.count() <= SENT:
        joined = place(given).join(F.broadcast(known), "item", "left")
    else:
        joined = place(given.join(known, "item", "left"))
    rows = joined.withColumn("_liked", F.expr(f"_known AND _y >= {settings.liked_stars_unit!r}D"))

    def summed(values: list[str], name: str, where: str = "") -> Column:
        return F.expr(f"array({', '.join(f'coalesce(sum({v}){where}, 0D)' for v in values)}) AS {name}")

    # An unknown item has NULL features, so it drops out of every sum by itself. Placed by user first: a
    # map-side table of sums would hold most users in every task, the sums of its own users are all that a task needs.
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_given"),
        F.count_if("_known").alias("n"),
        summed(features, "sx"),
        summed([f"{a} * {b}" for a, b in pairs], "sxx"),
        summed([f"{f} * _y" for f in features], "sxy"),
        F.expr("coalesce(sum(_y) FILTER (WHERE _known), 0D) AS sy"),
        F.expr("coalesce(sum(_y * _y) FILTER (WHERE _known), 0D) AS syy"),
        F.count_if("_liked").alias("n_liked"),
        summed(z_values, "sliked", " FILTER (WHERE _liked)"),
    )


def add_sums(stored: DataFrame, new: DataFrame, features: list[str]) -> DataFrame:
    """Both tables of sums as one: how a profile absorbs new ratings."""
    k = len(features)
    sizes = {"sx": k, "sxx": k * (k + 1) // 2, "sxy": k, "sliked": k}

    def total(c: str) -> Column:
        if c in sizes:
            return F.expr(f"array({', '.join(f'sum({c}[{i}])' for i in range(sizes[c]))}) AS {c}")
        return F.sum(c).alias(c)

    return stored.unionByName(new).groupBy("user_id").agg(*[total(c) for c in stored.columns if c != "user_id"])


#: A sum of squares under this is rounding noise: all ratings are equal, and nothing can be learned from them.
NOISE = 1e-12


def learned_weights(sums: DataFrame, features: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `learned_<f>` (NULL where nothing was learned) and `confidence` (0 there).

    Ridge regression on standardized features, from a user's sums. The small system is a list of rows
    that is eliminated row by row; it is symmetric and positive definite, so no pivots are sought.
    """
    if settings.ridge_alpha <= 0:
        raise ValueError("elimination without pivots needs a positive ridge penalty")
    size = len(features)
    place = {p: k for k, p in enumerate((i, j) for i in range(size) for j in range(i, size))}
    row = lambda i: f"array({', '.join(f'sxx[{place[min(i, j), max(i, j)]}]' for j in range(size))})"
    system = "transform(_g, (r, i) -> array_append(transform(r, (v, j) -> IF(i = j, v + {alpha}D, v)), _t[i]))"
    eliminated = (
        f"aggregate(sequence(0, {size - 1}), {system.format(alpha=repr(float(settings.ridge_alpha)))},"
        " (m, k) -> transform(m, (r, i) -> IF(i = k, r, zip_with(r, m[k], (x, y) -> x - r[k] / m[k][k] * y))))"
    )
    rounds = [
        {"_c": "greatest(double(n), 1D)", "_full": f"array({', '.join(map(row, range(size)))})"},
        {"_mean": "transform(sx, v -> v / _c)", "_ym": "sy / _c", "_tot": f"IF(syy - sy * sy / _c > {NOISE!r}D, syy - sy * sy / _c, 0D)"},
        {"_cov": "transform(_full, (r, i) -> transform(r, (v, j) -> v / _c - _mean[i] * _mean[j]))"},
        {"_inv": "transform(_cov, (r, i) -> IF(r[i] > 1e-12D, 1D / sqrt(r[i]), 0D))"},
        {
            "_g": "transform(_cov, (r, i) -> transform(r, (v, j) -> _c * v * _inv[i] * _inv[j]))",
            "_t": "transform(sxy, (v, i) -> IF(_tot > 0, (v - _c * _mean[i] * _ym) * _inv[i], 0D))",
        },
        {"_x": f"transform({eliminated}, (r, i) -> r[{size}] / r[i])"},
        {
            "_res": "_tot - 2D * aggregate(zip_with(_x, _t, (a, b) -> a * b), 0D, (s, v) -> s + v)"
            " + aggregate(zip_with(_x, _g, (a, r) -> a * aggregate(zip_with(r, _x, (v, b) -> v * b), 0D, (s, v) -> s + v)), 0D, (s, v) -> s + v)",
            "_size": "aggregate(_x, 0D, (s, v) -> s + abs(v))",
        },
    ]
    solved = sums
    for step in rounds:
        solved = solved.selectExpr("*", *[f"{e} AS {c}" for c, e in step.items()])
    enough = f"(n_given >= {settings.min_ratings} AND n > 0)"
    fit = "greatest(0D, 1D - _res / (_tot + 1e-10D))"
    return solved.selectExpr(
        *sums.columns,
        *[f"IF({enough}, IF(_size > 0, abs(_x[{i}]) / _size, {1.0 / size!r}D), NULL) AS learned_{f}" for i, f in enumerate(features)],
        f"IF({enough}, 0.7D * {fit} + 0.3D * least(1D, n_given / 10D), 0D) AS confidence",
    )


def blend_weights(df: DataFrame, features: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `weight_<f>` from `stated_<f>`, `learned_<f>`, `confidence` (any of them may be NULL)."""
    share = f"least({settings.max_learned_share!r}D, confidence * {settings.max_learned_share!r}D)"
    learned = " OR ".join(f"learned_{f} IS NOT NULL" for f in features)
    staged = df.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).selectExpr(
        "*", f"(({learned}) AND confidence >= {settings.min_learned_confidence!r}D) AS _use", f"{share} AS _share"
    )
    mixed = staged.selectExpr(
        "*",
        *[
            f"_share * coalesce(learned_{f}, 0D) + (1D - _share) * coalesce(stated_{f}, 0D) AS _mix_{f}"
            for f in features
        ],
    ).withColumn("_total", X.total(f"_mix_{f}" for f in features))
    return mixed.selectExpr(
        "*",
        *[
            f"IF(_use, IF(_mix_{f} > 0, try_divide(_mix_{f}, _total), NULL), stated_{f}) AS weight_{f}" for f in features
        ],
    ).drop("_use", "_share", "_total", *[f"_mix_{f}" for f in features])


def build_profiles(
    importance: DataFrame,
    ratings: DataFrame | None,
    items: DataFrame,
    mapping: dict[str, list[str]],
    features: list[str] | None = None,
    settings: Settings = DEFAULTS,
    sums: DataFrame | None = None,
) -> DataFrame:
    """One wide profile row per user with stated importances or ratings."""
    features = features or mapped_features(mapping)
    stated = stated_weights(importance, mapping, settings)
    extra = [f for f in features if f not in mapped_features(mapping)]
    stated = stated.withColumns(
        {f"stated_{f}": F.lit(None).cast("double") for f in extra}
        | {f"hard_{f}": F.lit(None).cast("string") for f in extra}
        | {f"place_{f}": F.lit(None).cast("int") for f in extra}
    )
    if sums is None and ratings is None:
        joined = stated.withColumns(
            {"n_given": F.lit(0), "n_liked": F.lit(0), "confidence": F.lit(0.0)}
            | {"sliked": F.array(*[F.lit(0.0)] * len(features))}
            | {f"learned_{f}": F.lit(None).cast("double") for f in features}
        )
    else:
        sums = rating_sums(ratings, items, features, settings) if sums is None else sums
        # Stored: one row a user, read by every later pass, and the elimination stays out of their plans.
        learned = learned_weights(sums, features, settings).drop("n", "sx", "sxx", "sxy", "sy", "syy")
        joined = stated.join(store(learned, "learned-weights"), "user_id", "full")
    joined = joined.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "n_given": F.coalesce("n_given", F.lit(0)),
            "n_liked": F.coalesce("n_liked", F.lit(0)),
        }
    )
    return blend_weights(joined, features, settings)


def profile_view(profiles: DataFrame, features: list[str]) -> DataFrame:
    """Profiles for reading: three weight maps, confidence, hard features, rating count."""

    def weight_map(prefix: str) -> Column:
        entries = F.filter(
            F.array(*[F.struct(F.lit(f).alias("k"), F.col(f"{prefix}_{f}").alias("v")) for f in features]),
            lambda e: e["v"].isNotNull(),
        )
        return F.map_from_entries(entries)

    high = F.array_compact(F.array(*[F.when(F.col(f"hard_{f}").isNotNull(), F.lit(f)) for f in features]))
    return profiles.select(
        "user_id",
        weight_map("weight").alias("feature_weights"),
        weight_map("learned").alias("learned_weights"),
        weight_map("stated").alias("stated_weights"),
        "confidence",
        high.alias("high_importance_features"),
        F.col("n_given").alias("num_ratings"),
    )


def long_weights(profiles: DataFrame, features: list[str], prefix: str = "weight") -> DataFrame:
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"{prefix}_{f}").alias("weight")) for f in features]
    return profiles.select("user_id", F.explode(F.array(*rows)).alias("r")).select("user_id", "r.*").where(
        "weight IS NOT NULL"
    )


def explain_profiles(profiles: DataFrame, features: list[str], top: int = 5) -> DataFrame:
    """Strategy, the `top` strongest features and the hard requirements, as text."""
    entries = F.filter(
        F.array(
            *[
                F.struct((-F.col(f"weight_{f}")).alias("w"), F.lit(i).alias("i"), F.lit(X.readable(f)).alias("n"))
                for i, f in enumerate(features)
            ]
        ),
        lambda e: e["w"].isNotNull(),
    )
    best = F.transform(
        F.slice(F.array_sort(entries), 1, top), lambda e: F.format_string("%s: %.3f", e["n"], -e["w"])
    )
    hard = F.array_compact(F.array(*[F.when(F.col(f"hard_{f}").isNotNull(), X.readable(f)) for f in features]))
    # Wording of the three strategies.
    strategy = (
        F.when(
            F.col("confidence") > 0.6,
            F.format_string("Primarily based on learned patterns from %d ratings", F.col("n_given")),
        )
        .when(F.col("confidence") > 0.3, "Balanced mix of stated preferences and learned patterns")
        .otherwise("Based on stated importance scores")
    )
    return profiles.select(
        "user_id", strategy.alias("strategy"), F.concat_ws(", ", best).alias("top_preferences"),
        F.concat_ws(", ", hard).alias("hard_requirements"),
    )


def explain_importance(importance: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """One sentence per known category, most important first (`rank`)."""
    spark = importance.sparkSession
    names = spark.createDataFrame(
        [(c, ", ".join(f.replace("_rate", "").replace("_", " ") for f in fs)) for c, fs in mapping.items()],
        "category string, names string",
    )
    rows = importance.join(F.broadcast(names), "category")
    order = Window.partitionBy("user_id").orderBy(F.desc("importance"), "ord")
    return rows.select(
        "user_id",
        F.row_number().over(order).alias("rank"),
        "category",
        X.importance_label(F.col("importance")).alias("level"),
        F.concat(
            F.col("category"), F.lit(" ("), F.col("importance").cast("int").cast("string"), F.lit("/100) is "),
            X.importance_label(F.col("importance")), F.lit(" → emphasizing "), F.col("names"),
        ).alias("sentence"),
    )


def predicted_stars(features: list[str], prefix: str = "learned") -> Column:
    """Clipped star rating of an item row joined to a profile row; 3 where nothing was learned."""
    known = F.expr(" OR ".join(f"{prefix}_{f} IS NOT NULL" for f in features))
    score = X.total(f"coalesce({prefix}_{f}, 0D) * coalesce({f}, 0D)" for f in features)
    return F.when(known, X.clip(score / F.lit(0.2), 1, 5)).otherwise(F.lit(3.0))
