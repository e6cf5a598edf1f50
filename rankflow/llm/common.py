"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankflow.session import store

#: ASCII bytes that separate words; `bytes.split()` splits on exactly these.
SPACES = rb" \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """`name`, or the first `name_2`, `name_3`... that no column has (compared without case)."""
    low, k, found = {x.lower() for x in taken}, 1, name
    while found.lower() in low:
        k += 1
        found = f"{name}_{k}"
    return found


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply `work` to every Arrow batch; it needs no state besides the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def fold_of(key: str, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo `folds`: the fold a labelled row belongs to (null key: fold 0)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def crc_fold(key: object, folds: int = 5) -> int:
    return zlib.crc32(str(key).encode()) % folds


def salted(rows: DataFrame, small: DataFrame, keys: list[str], by: Column, salts: int = 64, how: str = "left") -> DataFrame:
    """Join `rows` to `small` (at most one row a key) so that a hot key spreads over `salts` tasks.

    Null keys match nothing. `small` is repeated once a salt, so it must be far smaller than `rows`.
    """
    salt = fresh([*rows.columns, *small.columns], "_salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


@contextmanager
def tidy(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them ends, and Arrow batches are small, since rows hold whole texts."""
    held = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    } | (more or {})
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """A table written to the shared folder and read back; the shuffles on the way leave no files. `batch` bounds the bytes of an Arrow batch."""
    with tidy(df.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": batch} if batch else None):
        return store(df, name)
