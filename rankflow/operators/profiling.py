"""Column profiles, duplicates and per-file summaries as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.functions.expr import attach
from rankflow.functions.quantiles import quantiles

DEFAULTS = Settings()


def missing_strategy(rate: Column, settings: Settings = DEFAULTS) -> Column:
    # Names of the three tiers.
    return (
        F.when(rate <= settings.low_missing, "median_imputation")
        .when(rate <= settings.high_missing, "regional_or_global_median")
        .otherwise("leave_null_and_flag")
    )


def _stack(wide: DataFrame, columns: list[str]) -> DataFrame:
    return wide.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def missing_profile(df: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    total = F.count(F.lit(1))
    parts = []
    for c in columns:
        missing = F.count_if(F.col(c).isNull())
        rate = F.coalesce(F.try_divide(missing, total), F.lit(0.0))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                missing.alias("missing_count"),
                rate.alias("missing_rate"),
                F.count(c).alias("non_null_count"),
                missing_strategy(rate, settings).alias("strategy"),
            ).alias(c)
        )
    return _stack(df.agg(*parts), columns)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Location, spread, IQR fences and counts beyond them: one quantile pass, one counting pass."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    marked = attach(df.select(*columns), q)
    parts = []
    for c in columns:
        x, s = F.col(c).cast("double"), F.col(f"_s.{c}")
        reach = F.lit(1.5) * (s[2] - s[0])
        low, high = s[0] - reach, s[2] + reach
        outliers = F.count_if((x < low) | (x > high))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.max(s[1]).alias("median"),
                F.stddev(x).alias("std"),
                F.max(s[0]).alias("q25"),
                F.max(s[2]).alias("q75"),
                F.max(low).alias("iqr_lower_bound"),
                F.max(high).alias("iqr_upper_bound"),
                F.count_if(x < low).alias("outliers_lower"),
                F.count_if(x > high).alias("outliers_upper"),
                outliers.alias("total_outliers"),
                F.try_divide(outliers, F.count(x)).alias("outlier_rate"),
                F.count_if(x < 0).alias("negative_values"),
                F.count_if(x == 0).alias("zero_values"),
            ).alias(c)
        )
    return _stack(marked.agg(*parts), columns)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with how often."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    counts = duplicates(df, column)
    return counts.agg(
        F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicated_values"),
    )


def quality_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share, range, spread and the two warning flags of the feature report."""
    q = quantiles(df, columns, [0.25, 0.75])
    marked = attach(df.select(*columns), q)
    types = dict(df.dtypes)
    parts = []
    for c in columns:
        x, s = F.col(c).cast("double"), F.col(f"_s.{c}")
        reach = F.lit(3.0) * (s[1] - s[0])
        extreme = F.count_if((x < s[0] - reach) | (x > s[1] + reach))
        share = F.try_divide(F.count_if(x.isNull()) * 100.0, F.count(F.lit(1)))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("data_type"),
                F.count_if(x.isNull()).alias("missing_count"),
                share.alias("missing_percentage"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev(x).alias("std"),
                (share > 50).alias("mostly_missing"),
                (extreme > F.count(x) * 0.1).alias("many_extremes"),
            ).alias(c)
        )
    return _stack(marked.agg(*parts), columns)


def validation_summary(files: DataFrame) -> DataFrame:
    """Totals over a per-file report (`status`, `row_count`, `indicator_type`, `warnings` int)."""
    ok = F.col("status") == "success"
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("successful_validations"),
        F.count_if(~ok).alias("failed_validations"),
        F.coalesce(F.try_divide(F.count_if(ok), F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_data_rows"),
        F.coalesce(F.sum(F.when(ok, F.col("row_count"))), F.lit(0)).alias("estimated_entities"),
        F.array_sort(F.collect_set(F.when(ok, F.col("indicator_type")))).alias("detected_indicators"),
        F.coalesce(F.sum(F.when(ok, F.col("warnings"))), F.lit(0)).alias("total_warnings"),
    )
