"""Dedupe and merge per-file tables into one row per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.ordered import with_sequential_id


def first_per_entity(df: DataFrame, entity: str, order: list[Column | str]) -> DataFrame:
    """First row per entity in `order`; an aggregate, so a frequent entity is combined map-side."""
    rest = [c for c in df.columns if c != entity]
    picked = df.groupBy(entity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(entity, "_r.*")


def merged_names(tables: dict[str, list[str]], entity: str) -> dict[str, dict[str, str]]:
    """Per table: column -> column in the merge; a name already taken gets `_<table>` appended."""
    taken, out = {entity}, {}
    for name, columns in tables.items():
        out[name] = {c: (f"{c}_{name}" if c in taken else c) for c in columns if c != entity}
        taken |= set(out[name].values())
    return out


def outer_merge(tables: dict[str, DataFrame], entity: str) -> DataFrame:
    """Full outer merge of tables with one row per entity: one union, one shuffle, any number of tables."""
    if not tables:
        raise ValueError("nothing to merge")
    names = merged_names({n: df.columns for n, df in tables.items()}, entity)
    renamed = [
        df.select(entity, *[F.col(f"`{c}`").alias(new) for c, new in names[n].items()]) for n, df in tables.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    values = [c for c in stacked.columns if c != entity]
    return stacked.groupBy(entity).agg(*[F.max(f"`{c}`").alias(c) for c in values])


def merge_steps(tables: dict[str, DataFrame], entity: str) -> DataFrame:
    """Entity counts before and after each merge step, from the first table every entity is in."""
    parts = [df.select(entity, F.lit(i).alias("step")) for i, df in enumerate(tables.values())]
    first = reduce(DataFrame.unionByName, parts).groupBy(entity).agg(F.min("step").alias("step"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name")) for i, n in enumerate(tables)])
    counts = first.groupBy().agg(*[F.count_if(F.col("step") == i).alias(f"n{i}") for i in range(len(tables))])
    new = F.array(*[F.col(f"n{i}") for i in range(len(tables))])
    up_to = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.select(F.posexplode(F.arrays_zip(steps.alias("s"), new.alias("n"))).alias("step", "e"))
        .select("step", F.col("e.s.name").alias("name"), F.col("e.n").alias("new_entities"))
        .withColumn("entities_after", F.sum("new_entities").over(up_to))
        .withColumn("entities_before", F.col("entities_after") - F.col("new_entities"))
    )


def number_entities(df: DataFrame, entity: str, name: str = "country_id") -> DataFrame:
    return with_sequential_id(df, [entity], name)
