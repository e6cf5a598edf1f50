"""Tables kept in hash buckets of their key, so that an upsert rewrites only the buckets it touches.

Rows lie under `data/write=N/bucket=K`. A version is a small list with one row per bucket that says
which write holds it; it is stored last, under `version=N`, so a reader sees either all of a write
or nothing of it, and one that has begun keeps the files it began with. The list also keeps the
schema and a mark (the number of the last micro-batch, say).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.session import store
from rankflow.sources.warehouse import newest_version, upsert

BUCKETS = 64

LIST_SCHEMA = "bucket int, write long, schema string, mark long"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _list(spark: SparkSession, path: str) -> list | None:
    """The newest version's row per bucket, or None without a version."""
    version = newest_version(spark, path)
    if version is None:
        return None
    return spark.read.schema(LIST_SCHEMA).parquet(f"{path}/version={version}").orderBy("bucket").collect()


def _rows(spark: SparkSession, path: str, listed: list) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(listed[0].schema))
    paths = [f"{path}/data/write={b.write}/bucket={b.bucket}" for b in listed if b.write is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the newest version, or None. Files of older versions are not listed."""
    listed = _list(spark, path)
    return None if listed is None else _rows(spark, path, listed)


def last_mark(spark: SparkSession, path: str) -> int | None:
    listed = _list(spark, path)
    return listed[0].mark if listed else None


def upsert_buckets(
    new: DataFrame, path: str, key: str, buckets: int = BUCKETS, mark: int | None = None,
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> list[int]:
    """Merges rows into the stored table and returns the buckets written; the first call makes the table.

    `merge(old, new)` gives the rows of the touched buckets, by default `upsert`; it must keep the
    key of every row. Null keys are one key. What a failed attempt left behind is overwritten.
    """
    spark = new.sparkSession
    merge = merge or (lambda old, rows: upsert(old, rows, key))
    listed = _list(spark, path)
    version = (newest_version(spark, path) or 0) + 1
    buckets = len(listed) if listed else buckets
    if listed is not None:  # equal keys of other types would hash into other buckets
        kept = T.StructType.fromJson(json.loads(listed[0].schema))
        new = new.withColumn(key, F.col(key).cast(kept[key].dataType))
    rows = store(new, "new-rows")
    touched = sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())
    if listed is None:
        empty = rows.drop("_seq").where("false")
        listed = [T.Row(bucket=k, write=None, schema=empty.schema.json(), mark=None) for k in range(buckets)]
    merged = merge(_rows(spark, path, [listed[k] for k in touched] or listed[:1]), rows)
    if touched:
        # rebalancing splits a bucket that outgrows a task and gives small ones one file each
        placed = merged.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
        placed.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/write={version}")
    schema, held = merged.schema.json(), set(touched)
    entries = [(b.bucket, version if b.bucket in held else b.write, schema, b.mark if mark is None else mark) for b in listed]
    spark.createDataFrame(entries, LIST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return touched
