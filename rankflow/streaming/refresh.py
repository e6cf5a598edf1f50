"""Profiles that absorb a stream of ratings.

The stream is reduced to the additive sums per user; state is one row of sums per user, not the
ratings, in hash buckets of users: a micro-batch reads and rewrites the buckets of its users only.
Repeated deliveries of a rating id are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from rankflow.config import Settings
from rankflow.operators.profile import add_sums, rating_sums
from rankflow.sources.buckets import BUCKETS, last_mark, read_buckets, upsert_buckets

DEFAULTS = Settings()


def fresh_ratings(stream: DataFrame, event_time: str = "ts", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["rating_id"])


def refresh_profiles(
    stream: DataFrame, items: DataFrame, features: list[str], table: str, checkpoint: str,
    settings: Settings = DEFAULTS, event_time: str = "ts", late: str = "1 day", buckets: int = BUCKETS,
) -> StreamingQuery:
    """Adds each micro-batch's sums to the stored sums; `items` is a stored table with `z_<f>`.

    The table's mark is the last batch number, so a batch that is delivered again after a failure is
    not added twice; one that failed half-way left no version and is added whole.
    """

    def absorb(batch: DataFrame, number: int) -> None:
        path = f"{table}/sums"
        done = last_mark(batch.sparkSession, path)
        if done is None or done < number:
            new = rating_sums(batch, items, features, settings)
            upsert_buckets(new, path, "user_id", buckets, number, lambda old, more: add_sums(old, more, features))

    return (
        fresh_ratings(stream, event_time, late)
        .writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .foreachBatch(absorb)
        .start()
    )


def stored_sums(spark, table: str) -> DataFrame:
    return read_buckets(spark, f"{table}/sums")
