"""Filling of missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.config import EMPTY_DEFAULT, EMPTY_DEFAULTS
from rankflow.functions.blocks import meet
from rankflow.functions.cells import nearest_cells
from rankflow.functions.expr import attach
from rankflow.functions.ordered import forward_fill
from rankflow.functions.quantiles import quantiles


def empty_default(column: str) -> float:
    for word, value in EMPTY_DEFAULTS.items():
        if word in column.lower():
            return value
    return EMPTY_DEFAULT


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    q = quantiles(df, columns, [0.5])
    return q.select(*[F.col(c)[0].alias(c) for c in columns])


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, smallest on a tie; counted before it is compared."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    counts = (
        df.select(F.explode(F.array(*rows)).alias("e"))
        .select("e.*")
        .where("v IS NOT NULL")
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = [
        F.min(F.when(F.col("column") == c, F.struct((-F.col("n")).alias("n"), F.col("v"))))["v"].alias(c)
        for c in columns
    ]
    return counts.agg(*best)


def fill_values(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """One row with the value each column is filled with; unknown strategies mean the median."""
    if strategy == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in columns])
    if strategy == "most_frequent":
        return modes(df, columns)
    return medians(df, columns)


def fill_with(df: DataFrame, values: DataFrame, columns: list[str], defaults: bool = False) -> DataFrame:
    def filled(c: str) -> Column:
        last = [F.lit(empty_default(c))] if defaults else []
        return F.coalesce(F.col(c), F.col(f"_s.{c}"), *last)

    return attach(df, values).withColumns({c: filled(c) for c in columns}).drop("_s")


def fill_every_gap(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median per column, a fixed default for a column without any value: no gap survives."""
    return fill_with(df, medians(df, columns), columns, defaults=True)


def remaining_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    left = remaining_gaps(df, columns).first().asDict()
    bad = {c: n for c, n in left.items() if n}
    if bad:
        raise ValueError(f"missing values remain after imputation: {bad}")
    return df


def impute(
    df: DataFrame,
    columns: list[str],
    strategy: str = "median",
    key: str | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """mean, median, most_frequent, knn (needs `key`) or forward_fill (needs a unique `order`)."""
    if strategy == "knn":
        return knn_impute(df, key, columns)
    if strategy == "forward_fill":
        return fill_with(forward_fill(df, order, columns), medians(df, columns), columns)
    return fill_with(df, fill_values(df, columns, strategy), columns)


def _nearest(prefix: str, columns: list[str], wanted: str, k: int) -> Column:
    """The k nearest rows of one block that know `wanted`: (distance, key, value) sorted."""

    def entry(d):
        both = [F.col(f"{prefix}{c}").isNotNull() & d[c].isNotNull() for c in columns]
        shared = reduce(Column.__add__, [b.cast("int") for b in both])
        parts = [F.when(b, F.pow(F.col(f"{prefix}{c}") - d[c], F.lit(2.0))).otherwise(0.0) for b, c in zip(both, columns)]
        distance = F.sqrt(F.try_divide(F.lit(float(len(columns))) * reduce(Column.__add__, parts), shared))
        return F.struct(distance.alias("d"), d["_key"].alias("k"), d[wanted].alias("v"))

    known = F.filter(F.col("_rows"), lambda d: d[wanted].isNotNull())
    near = F.filter(F.transform(known, entry), lambda e: e["d"].isNotNull())
    return F.when(F.col(f"{prefix}{wanted}").isNull(), F.slice(F.array_sort(near), 1, k))


def _candidates(df: DataFrame, key: str, columns: list[str], k: int, blocks: int | None) -> DataFrame:
    """`_id` and per column the candidates (distance, key, value) of a row's gap, by blocks of the catalog, in SQL."""
    incomplete = df.where(_gaps(columns)).select(F.col(key).alias("_id"), *[F.col(c).alias(f"_q_{c}") for c in columns])
    donors = df.select(F.col(key).alias("_key"), *columns)
    partial = meet(incomplete, donors, "_key", blocks).select(
        "_id", *[_nearest("_q_", columns, c, k).alias(c) for c in columns]
    )
    return partial.groupBy("_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in columns])


def _candidates_in_cells(df: DataFrame, key: str, columns: list[str], k: int, blocks: int | None) -> DataFrame:
    """The same from whole cells: no expression is evaluated for a pair."""
    incomplete = df.where(_gaps(columns)).select(F.col(key).alias("_id"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(columns)])
    donors = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(columns)])
    entry = F.struct(F.col("_d").alias("d"), F.col("_key").alias("k"), F.col("_v").alias("v"))
    return nearest_cells(incomplete, donors, len(columns), k, blocks).groupBy("_id").agg(
        *[F.collect_list(F.when(F.col("_c") == i, entry)).alias(c) for i, c in enumerate(columns)]
    )


def _gaps(columns: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in columns])


#: Types whose differences numpy gives as SQL does; others are left to SQL.
EXACT = (T.DoubleType, T.IntegerType, T.ShortType, T.ByteType)


def knn_impute(df: DataFrame, key: str, columns: list[str], k: int = 5, blocks: int | None = None) -> DataFrame:
    """Mean of the k nearest donors per gap; distance over the coordinates both rows know.

    Incomplete rows meet the catalog block by block and keep k candidates per block, so the
    shuffle carries candidates, never pairs. A gap without any comparable donor gets the mean.
    """
    exact = all(isinstance(df.schema[c].dataType, EXACT) for c in columns)
    merged = (_candidates_in_cells if exact else _candidates)(df, key, columns, k, blocks)

    def mean_of(c: str) -> Column:
        top = F.transform(F.slice(F.array_sort(F.col(c)), 1, k), lambda e: e["v"].cast("double"))
        return F.try_divide(F.aggregate(top, F.lit(0.0), lambda s, v: s + v), F.size(top)).alias(f"_f_{c}")

    found = merged.select(F.col("_id").alias(key), *[mean_of(c) for c in columns])
    filled = df.join(found, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in columns})
    return fill_with(
        filled.drop(*[f"_f_{c}" for c in columns]), df.agg(*[F.avg(c).alias(c) for c in columns]), columns
    )
