"""Whole-table ordered work (ids, forward fill) without a single-task window.

Rows are range-partitioned on a unique order key, the slice number is stored with them, and
only one small summary row per slice meets in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.session import cut, width


def slices(df: DataFrame, order: list, count: int | None = None) -> DataFrame:
    count = count or width(df)
    return cut(df.repartitionByRange(count, *order).withColumn("_slice", F.spark_partition_id()))


def with_sequential_id(df: DataFrame, order: list, name: str, count: int | None = None) -> DataFrame:
    """1, 2, 3 ... over the whole table in `order`."""
    parts = slices(df, order, count)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_slice").orderBy(*order)
    return (
        parts.join(offsets, "_slice")
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_slice", "_offset")
    )


def forward_fill(df: DataFrame, order: list[str], columns: list[str], count: int | None = None) -> DataFrame:
    """Last known value in `order`, for each of `columns`; leading gaps stay NULL."""
    parts = slices(df, order, count)
    key = F.struct(*order)
    last = parts.groupBy("_slice").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns]
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_slice", *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns])
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.join(carried, "_slice", "left").withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_in_{c}")) for c in columns}
    )
    return filled.drop("_slice", *[f"_in_{c}" for c in columns])
