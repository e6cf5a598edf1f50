"""User requests as JSON text: star ratings by item and importances by request key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.config import REQUEST_KEYS

REQUEST_SCHEMA = "struct<ratings: map<string,double>, weights: map<string,double>>"


def parse_requests(requests: DataFrame, keys: dict[str, str] = REQUEST_KEYS) -> DataFrame:
    """`user_id`, `body` -> adds `request`; text that is no JSON object gives NULL parts."""
    return requests.withColumn("request", F.from_json("body", REQUEST_SCHEMA))


def request_importance(parsed: DataFrame, keys: dict[str, str] = REQUEST_KEYS) -> DataFrame:
    """`user_id`, `category`, `importance`, `ord` (place in the request); unknown keys are ignored."""
    known = parsed.sparkSession.createDataFrame(list(keys.items()), "key string, category string")
    rows = parsed.select("user_id", F.posexplode(F.map_entries("request.weights")).alias("ord", "e"))
    return (
        rows.select("user_id", "ord", F.col("e.key").alias("key"), F.col("e.value").alias("importance"))
        .join(F.broadcast(known), "key")
        .select("user_id", "category", "importance", "ord")
    )


def request_ratings(parsed: DataFrame) -> DataFrame:
    return parsed.select("user_id", F.explode("request.ratings").alias("item", "rating"))
