"""Offline evaluation on held-out ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.operators.profile import build_profiles, mapped_features, predicted_stars, valid_ratings
from rankflow.operators.scale import z_scores
from rankflow.plans.recommend import recommend

DEFAULTS = Settings()


def split(ratings: DataFrame, held_out: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test); by default a fifth of the (user, item) pairs, by hash, is held out."""
    test = held_out if held_out is not None else F.pmod(F.xxhash64("user_id", "item"), F.lit(5)) == 0
    return ratings.where(~test), ratings.where(test)


def mean_absolute_error(predicted: DataFrame, test: DataFrame) -> DataFrame:
    """`predicted` (`user_id`, `item`, `stars`) against held-out ratings."""
    both = test.join(predicted, ["user_id", "item"])
    return both.agg(F.avg(F.abs(F.col("rating") - F.col("stars"))).alias("mae"), F.count(F.lit(1)).alias("predictions"))


def precision_at(ranked: DataFrame, test: DataFrame, k: int, liked_stars: float = 3.5) -> DataFrame:
    """Mean share of the first k recommendations that are held-out liked items, over users who have one."""
    liked = test.where(F.col("rating") >= liked_stars).select("user_id", "item")
    hits = ranked.where(F.col("rank") <= k).join(liked, ["user_id", "item"], "left_semi")
    per_user = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    users = liked.select("user_id").distinct().join(per_user, "user_id", "left")
    return users.agg(
        F.avg(F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"), F.count(F.lit(1)).alias("users")
    )


def predict(profiles: DataFrame, pairs: DataFrame, items: DataFrame, features: list[str]) -> DataFrame:
    """Star predictions for (user, item) pairs from the learned weights."""
    rows = pairs.select("user_id", "item").join(profiles, "user_id").join(items.select("item", *features), "item")
    return rows.select("user_id", "item", predicted_stars(features).alias("stars"))


def evaluate(
    importance: DataFrame, ratings: DataFrame, items: DataFrame, mapping: dict[str, list[str]],
    k: int = 5, held_out: Column | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """`metric`, `value`: MAE of predicted stars and precision@k of the recommendations."""
    features = mapped_features(mapping)
    train, test = split(valid_ratings(ratings), held_out)
    with_z = z_scores(items.select("item", *features), features)
    profiles = build_profiles(importance, train, with_z, mapping, features, settings)
    mae = mean_absolute_error(predict(profiles, test, items, features), test)
    ranked = recommend(importance, train, with_z, mapping, settings, profiles, k)
    precision = precision_at(ranked, test, k)
    return mae.select(F.lit("mae").alias("metric"), F.col("mae").alias("value")).unionByName(
        precision.select(F.lit(f"precision_at_{k}").alias("metric"), F.col("precision").alias("value"))
    )
