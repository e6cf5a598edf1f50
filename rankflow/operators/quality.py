"""Schema, type, range, consistency and business-rule checks, with automatic fixes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.config import WAREHOUSE_FEATURES
from rankflow.functions.expr import clip, total
from rankflow.operators.schema_rules import narrow_features


@dataclass(frozen=True)
class ColumnSpec:
    kind: str  # "numeric" or "string"
    required: bool = False
    unique: bool = False
    low: float | None = None
    high: float | None = None


WAREHOUSE_SPEC = {"country_name": ColumnSpec("string", required=True, unique=True)} | {
    c: ColumnSpec("numeric", low=0.0, high=1.0) for c in WAREHOUSE_FEATURES
}


def schema_check(df: DataFrame, spec: dict[str, ColumnSpec]) -> dict[str, list[str]]:
    return {
        "missing_required": [c for c, s in spec.items() if s.required and c not in df.columns],
        "unexpected": [c for c in df.columns if c not in spec],
    }


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def type_check(df: DataFrame, spec: dict[str, ColumnSpec]) -> DataFrame:
    """One row per mismatching column; a text column converts if under half of it would be lost."""
    schema = "column string, expected string, actual string, lost double, convertible boolean"
    types = dict(df.dtypes)
    numeric = [c for c, s in spec.items() if s.kind == "numeric" and c in types and not _numeric(df, c)]
    text = [c for c, s in spec.items() if s.kind == "string" and c in types and types[c] != "string"]
    parts = []
    for c in numeric:
        lost = F.avg(F.col(c).try_cast("double").isNull().cast("double"))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit("numeric").alias("expected"),
                F.lit(types[c]).alias("actual"),
                lost.alias("lost"),
                F.coalesce(lost < 0.5, F.lit(False)).alias("convertible"),
            )
        )
    for c in text:
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit("string").alias("expected"),
                F.lit(types[c]).alias("actual"),
                F.max(F.lit(0.0)).alias("lost"),
                F.lit(True).alias("convertible"),
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def fix_types(df: DataFrame, checks: list) -> DataFrame:
    for row in checks:
        if row["convertible"]:
            target = "double" if row["expected"] == "numeric" else "string"
            df = df.withColumn(row["column"], F.col(row["column"]).try_cast(target))
    return df


def _ranged(df: DataFrame, spec: dict[str, ColumnSpec]) -> list[str]:
    return [c for c, s in spec.items() if s.low is not None and c in df.columns and _numeric(df, c)]


def range_check(df: DataFrame, spec: dict[str, ColumnSpec]) -> DataFrame:
    columns = _ranged(df, spec)
    parts = []
    for c in columns:
        x, s = F.col(c), spec[c]
        bad = F.count_if((x < s.low) | (x > s.high))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(s.low).alias("expected_low"),
                F.lit(s.high).alias("expected_high"),
                F.min(x).cast("double").alias("actual_low"),
                F.max(x).cast("double").alias("actual_high"),
                F.count(x).alias("checked"),
                bad.alias("violations"),
                F.try_divide(bad * 100.0, F.count(x)).alias("violation_percentage"),
            ).alias(c)
        )
    if not parts:
        return df.sparkSession.createDataFrame(
            [],
            "column string, expected_low double, expected_high double, actual_low double, actual_high double,"
            " checked long, violations long, violation_percentage double",
        )
    return df.agg(*parts).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def fix_ranges(df: DataFrame, spec: dict[str, ColumnSpec]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), spec[c].low, spec[c].high) for c in _ranged(df, spec)})


def consistency_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: gaps above 25 %, zero variance, fewer than three distinct values."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    distinct = (
        df.select(F.explode(F.array(*rows)).alias("e"))
        .select("e.*")
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.try_divide(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)) * 100.0, F.sum("n")).alias(
                "missing_percentage"
            ),
            F.count("v").alias("distinct_values"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("known"),
        )
    )
    issue = (
        F.when(F.col("known") == 0, None)
        .when((F.col("distinct_values") == 1) & (F.col("known") > 1), "zero variance")
        .when(F.col("distinct_values") < 3, "very few unique values")
    )
    return distinct.select(
        "column", "missing_percentage", (F.col("missing_percentage") > 25).alias("high_missing"), "distinct_values",
        issue.alias("issue"),
    )


RULE_SCHEMA = "rule string, passed boolean, measure double, samples long, detail string"
Rule = Callable[[DataFrame], DataFrame]


def correlation_rule(left: str, right: str, sign: int = -1, tolerance: float = 0.1, min_rows: int = 10) -> Rule:
    """Correlation over complete pairs must have the expected sign; too little data passes."""

    def run(df: DataFrame) -> DataFrame:
        if left not in df.columns or right not in df.columns:
            return df.limit(0).agg(
                F.lit(True).alias("passed"), F.lit(None).cast("double").alias("measure"),
                F.count(F.lit(1)).alias("samples"), F.lit("columns_not_available").alias("detail"),
            )
        both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        r = both.agg(F.corr(left, right).alias("measure"), F.count(F.lit(1)).alias("samples"))
        few = F.col("samples") < min_rows
        return r.select(
            (few | F.coalesce(F.col("measure") * F.lit(float(sign)) > tolerance, F.lit(False))).alias("passed"),
            F.when(~few, F.col("measure")).alias("measure"),
            "samples",
            F.when(few, "insufficient_data").otherwise("negative" if sign < 0 else "positive").alias("detail"),
        )

    return run


def completeness_rule(columns: list[str] | None = None, average: float = 0.5, minimum: float = 0.2) -> Rule:
    def run(df: DataFrame) -> DataFrame:
        features = columns or narrow_features(df)
        if not features:
            return df.limit(0).agg(
                F.lit(False).alias("passed"), F.lit(None).cast("double").alias("measure"),
                F.count(F.lit(1)).alias("samples"), F.lit("no_feature_columns_found").alias("detail"),
            )
        share = total(f"int({c} IS NOT NULL)" for c in features) / F.lit(float(len(features)))
        r = df.select(share.alias("s")).agg(F.avg("s").alias("a"), F.min("s").alias("m"), F.count("s").alias("n"))
        return r.select(
            F.coalesce((F.col("a") >= average) & (F.col("m") >= minimum), F.lit(False)).alias("passed"),
            F.col("a").alias("measure"),
            F.col("n").alias("samples"),
            F.format_string("minimum %.6f", F.col("m")).alias("detail"),
        )

    return run


def inconsistent_rows(
    df: DataFrame, key: str, columns: list[str], pair: tuple[str, str] | None = None, limit: float = 0.8
) -> DataFrame:
    """Rows with over three known features that are all equal, or with both of a pair above `limit`."""
    known = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    enough = F.size(known) > 3
    issues = [F.when(enough & (F.size(F.array_distinct(known)) == 1), "all features have identical values")]
    if pair and all(c in df.columns for c in pair):
        issues.append(F.when(enough & (F.col(pair[0]) > limit) & (F.col(pair[1]) > limit), "both high"))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def consistency_rule(key: str, columns: list[str] | None = None, pair=None, limit: float = 0.8) -> Rule:
    def run(df: DataFrame) -> DataFrame:
        bad = inconsistent_rows(df, key, columns or narrow_features(df), pair, limit)
        return bad.agg(F.count(F.lit(1)).alias("n")).select(
            (F.col("n") == 0).alias("passed"),
            F.col("n").cast("double").alias("measure"),
            F.col("n").alias("samples"),
            F.lit("inconsistent rows").alias("detail"),
        )

    return run


def run_rules(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """One row per rule. A rule that cannot be planned on this table counts as failed."""
    spark, out = df.sparkSession, None
    for name, rule in rules.items():
        try:
            one = rule(df).select(
                F.lit(name).alias("rule"), "passed", F.col("measure").cast("double").alias("measure"),
                F.col("samples").cast("long").alias("samples"), "detail",
            )
        except Exception as error:  # a broken user rule must not stop the others
            one = spark.createDataFrame([(name, False, None, None, f"error: {type(error).__name__}")], RULE_SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], RULE_SCHEMA)


def feature_quality(df: DataFrame, columns: list[str], scale: float = 1.0) -> DataFrame:
    """.5 completeness + .3 min(variance / (scale/2), 1) + .2 range / scale, per column.

    `scale` is the width of the feature scale: 1 for rates, 10 for the 0-10 form.
    """
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        completeness = F.try_divide(F.count(x), F.count(F.lit(1)))
        variance = F.coalesce(F.variance(x), F.lit(0.0))
        used = F.coalesce((F.max(x) - F.min(x)) / F.lit(scale), F.lit(0.0))
        score = F.when(F.count(x) == 0, 0.0).otherwise(
            completeness * 0.5 + F.least(variance / F.lit(scale / 2.0), F.lit(1.0)) * 0.3 + used * 0.2
        )
        parts.append(
            F.struct(
                F.lit(c).alias("column"), score.alias("score"), completeness.alias("completeness"),
                variance.alias("variance"), F.coalesce(F.min(x), F.lit(0.0)).alias("low"),
                F.coalesce(F.max(x), F.lit(0.0)).alias("high"),
            ).alias(c)
        )
    return df.agg(*parts).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def quality_advice(quality: DataFrame) -> DataFrame:
    """Overall score and the columns below .5, from the (one row per column) quality table."""
    return quality.agg(
        F.avg("score").alias("overall_quality_score"),
        F.array_sort(F.collect_list(F.when(F.col("score") < 0.5, F.col("column")))).alias("improve_collection_for"),
        (F.avg("score") < 0.6).alias("improve_overall"),
    )


@dataclass
class Validation:
    status: str
    valid: bool
    data: DataFrame | None
    schema: dict
    fixes: list[str] = field(default_factory=list)
    types: DataFrame | None = None
    ranges: DataFrame | None = None
    consistency: DataFrame | None = None
    rules: DataFrame | None = None
    quality: DataFrame | None = None


def validate(
    df: DataFrame,
    spec: dict[str, ColumnSpec],
    rules: dict[str, Rule],
    key: str,
    strict: bool = False,
    auto_fix: bool = True,
) -> Validation:
    """All checks in order, each on the data the previous fixes produced.

    Only the reports reach the driver; they have one row per column or rule.
    """
    schema = schema_check(df, spec)
    schema_ok = not schema["missing_required"]
    if not schema_ok and strict:
        return Validation("failed", False, df if auto_fix else None, schema)
    fixes, current = [], df

    types = type_check(df, spec)
    mismatches = types.collect()
    types_ok = all(r["convertible"] for r in mismatches)
    if auto_fix:
        current = fix_types(current, mismatches)
        fixes += [f"convert_{r['column']}_to_{r['expected']}" for r in mismatches if r["convertible"]]

    ranges = range_check(current, spec)
    out_of_range = [r["column"] for r in ranges.where("violations > 0").collect()]
    if auto_fix:
        current = fix_ranges(current, {c: spec[c] for c in out_of_range})
        fixes += [f"clip_{c}_to_range" for c in out_of_range]

    numeric = [f.name for f in current.schema if isinstance(f.dataType, T.NumericType)]
    consistency = consistency_check(current, numeric) if numeric else None
    no_copies = True
    if key in current.columns:
        no_copies = current.groupBy(key).count().where("count > 1").isEmpty()
    report = run_rules(current, rules)
    rules_ok = report.where(~F.col("passed")).isEmpty()
    features = narrow_features(current)
    quality = feature_quality(current, features) if features else None

    valid = schema_ok and types_ok and not out_of_range and no_copies and rules_ok
    status = "passed" if valid else "passed_with_fixes" if auto_fix else "failed"
    return Validation(
        status, valid or auto_fix, current if auto_fix else None, schema, fixes, types, ranges, consistency, report,
        quality,
    )
