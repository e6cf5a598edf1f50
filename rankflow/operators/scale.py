"""Scaling, outliers and feature selection. Bounds come from one aggregate, rows are only projected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.config import LOWER_IS_BETTER
from rankflow.functions.expr import attach, clip
from rankflow.functions.quantiles import quantiles


def is_inverted(column: str, lower_is_better=LOWER_IS_BETTER) -> bool:
    return any(word in column.lower() for word in lower_is_better)


def _unit(x: Column, low: Column, high: Column, inverted: bool) -> Column:
    """Winsorized min-max; a constant column becomes 0.5 on every row, missing rows included.

    Clipping the moved value to [0, 1] is the same as clipping the value to its bounds first.
    """
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    scaled = F.when(low == high, F.lit(0.5)).when(x.isNotNull(), moved)
    return F.lit(1.0) - scaled if inverted else scaled


def with_bounds(df: DataFrame, bounds: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """Adds each column's two bounds as plain numbers `_low<i>`, `_high<i>`, read once from the one-row `bounds`."""
    flat = attach(df, bounds).withColumns(
        {f"_low{i}": F.col(f"_s.{c}")[0] for i, c in enumerate(columns)} | {f"_high{i}": F.col(f"_s.{c}")[1] for i, c in enumerate(columns)}
    )
    return flat.drop("_s"), {c: (F.col(f"_low{i}"), F.col(f"_high{i}")) for i, c in enumerate(columns)}


def without_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[f"_{end}{i}" for i in range(len(columns)) for end in ("low", "high")])


def winsor_scale(
    df: DataFrame,
    columns: list[str],
    lower: float = 1.0,
    upper: float = 99.0,
    lower_is_better=LOWER_IS_BETTER,
    **quantile_options,
) -> DataFrame:
    """Clip to two percentiles, move to [0, 1], flip the lower-is-better columns."""
    bounds = quantiles(df, columns, [lower / 100, upper / 100], **quantile_options)
    flat, ends = with_bounds(df, bounds, columns)
    scaled = {c: _unit(F.col(c).cast("double"), *ends[c], is_inverted(c, lower_is_better)) for c in columns}
    return without_bounds(flat.withColumns(scaled), columns)


def winsor_report(
    df: DataFrame, columns: list[str], lower: float = 1.0, upper: float = 99.0, lower_is_better=LOWER_IS_BETTER
) -> DataFrame:
    """One row per column: original statistics, bounds, clipped counts, statistics after scaling."""
    bounds = quantiles(df, columns, [lower / 100, upper / 100])
    marked, ends = with_bounds(df.select(*columns), bounds, columns)
    parts = []
    for c in columns:
        x, (low, high) = F.col(c).cast("double"), ends[c]
        inverted = is_inverted(c, lower_is_better)
        y = _unit(x, low, high, inverted)
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(x).alias("original_min"),
                F.max(x).alias("original_max"),
                F.avg(x).alias("original_mean"),
                F.stddev(x).alias("original_std"),
                F.max(low).alias("winsor_lower_bound"),
                F.max(high).alias("winsor_upper_bound"),
                F.count_if(x < low).alias("values_clipped_lower"),
                F.count_if(x > high).alias("values_clipped_upper"),
                F.count_if((x < low) | (x > high)).alias("total_clipped"),
                F.lit(inverted).alias("inverted"),
                F.min(y).alias("final_min"),
                F.max(y).alias("final_max"),
                F.avg(y).alias("final_mean"),
                F.stddev(y).alias("final_std"),
                F.count_if(x.isNull()).alias("missing_count"),
                F.try_divide(F.count_if(x.isNull()), F.count(F.lit(1))).alias("missing_rate"),
            ).alias(c)
        )
    wide = marked.agg(*parts)
    return wide.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


SCALERS = ("minmax", "standard", "robust", "none")


def fit_scaler(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    """One row; per column a struct (center, scale). A zero spread is stored as scale 1."""
    if method not in SCALERS:
        raise ValueError(f"unknown scaling method: {method}")
    if method == "robust":
        wide = quantiles(df, columns, [0.25, 0.5, 0.75])
        center = {c: F.col(c)[1] for c in columns}
        spread = {c: F.col(c)[2] - F.col(c)[0] for c in columns}
    else:
        first, second = {
            "minmax": (F.min, lambda x: F.max(x) - F.min(x)),
            "standard": (F.avg, F.stddev_pop),
            "none": (lambda x: F.max(F.lit(0.0)), lambda x: F.max(F.lit(1.0))),
        }[method]
        wide = df.agg(
            *[F.struct(first(F.col(c)).alias("center"), second(F.col(c)).alias("spread")).alias(c) for c in columns]
        )
        center = {c: F.col(f"{c}.center") for c in columns}
        spread = {c: F.col(f"{c}.spread") for c in columns}
    return wide.select(
        *[
            F.struct(
                center[c].cast("double").alias("center"),
                F.when(spread[c] == 0, 1.0).otherwise(spread[c].cast("double")).alias("scale"),
            ).alias(c)
            for c in columns
        ]
    )


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"_s.{c}.center")) / F.col(f"_s.{c}.scale") for c in columns}
    return attach(df, fitted).withColumns(scaled).drop("_s")


def scale(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    fitted = fit_scaler(df, columns, method)
    return df if method == "none" else apply_scaler(df, fitted, columns)


def z_scores(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """Population z-scores in new columns; missing counts as 0, a constant column gives 0."""
    moments = df.selectExpr(*[f"coalesce({c}, 0D) AS {c}" for c in columns]).agg(
        *[F.expr(f"named_struct('m', avg({c}), 's', stddev_pop({c})) AS {c}") for c in columns]
    )
    return (
        attach(df, moments)
        .selectExpr(
            "*",
            *[f"coalesce(try_divide(coalesce({c}, 0D) - _s.{c}.m, _s.{c}.s), 0D) AS {prefix}{c}" for c in columns],
        )
        .drop("_s")
    )


def _limits(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    """One row: per column the numbers the outlier test and the 5-95 % cap need."""
    q = quantiles(df, columns, [0.05, 0.25, 0.75, 0.95])
    moments = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev(c).alias("s")).alias(c) for c in columns])
    if method != "zscore":
        return q.select(
            *[
                F.struct(
                    F.col(c)[0].alias("p05"), F.col(c)[1].alias("q1"), F.col(c)[2].alias("q3"), F.col(c)[3].alias("p95")
                ).alias(c)
                for c in columns
            ]
        )
    return attach(q, moments).select(
        *[
            F.struct(
                F.col(c)[0].alias("p05"), F.col(c)[3].alias("p95"), F.col(f"_s.{c}.m"), F.col(f"_s.{c}.s")
            ).alias(c)
            for c in columns
        ]
    )


def _is_outlier(c: str, method: str) -> Column:
    x, s = F.col(c), f"_s.{c}"
    if method == "zscore":
        flag = F.abs(F.try_divide(x - F.col(f"{s}.m"), F.col(f"{s}.s"))) > 3
    else:
        reach = F.lit(1.5) * (F.col(f"{s}.q3") - F.col(f"{s}.q1"))
        flag = (x < F.col(f"{s}.q1") - reach) | (x > F.col(f"{s}.q3") + reach)
    return F.coalesce(flag, F.lit(False))


def flag_outliers(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Adds `<column>_outlier`. Methods: `zscore` (> 3 sample std), anything else is 1.5 x IQR."""
    return (
        attach(df, _limits(df, columns, method))
        .withColumns({f"{c}_outlier": _is_outlier(c, method) for c in columns})
        .drop("_s")
    )


def outlier_report(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    flagged = flag_outliers(df, columns, method)
    wide = flagged.agg(
        *[F.count_if(F.col(f"{c}_outlier")).alias(c) for c in columns], F.count(F.lit(1)).alias("_n")
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("r"), "_n").select(
        "r.column", "r.outliers", F.try_divide(F.col("r.outliers") * 100.0, F.col("_n")).alias("percentage")
    )


def treat_outliers(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """A column with at least one outlier is clipped, as a whole, to its 5th-95th percentiles."""
    limits = _limits(df, columns, method)
    marked = attach(df.select(*columns), limits)
    hit = marked.agg(*[F.bool_or(_is_outlier(c, method)).alias(c) for c in columns])
    treated = {
        c: F.when(F.col(f"_hit.{c}"), clip(F.col(c), F.col(f"_s.{c}.p05"), F.col(f"_s.{c}.p95"))).otherwise(
            F.col(c)
        )
        for c in columns
    }
    return attach(attach(df, limits), hit, "_hit").withColumns(treated).drop("_s", "_hit")


def variance_report(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    wide = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.*", (F.col("r.variance") > F.lit(threshold)).alias("selected")
    )


def select_features(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """Drop the columns whose population variance does not exceed the threshold."""
    kept = {r["column"] for r in variance_report(df, columns, threshold).where("selected").collect()}
    return df.drop(*[c for c in columns if c not in kept])


def feature_importance(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Uniform, or |correlation with the target| (0 where undefined)."""
    if target is None:
        wide = df.agg(*[F.max(F.lit(1.0 / len(columns))).alias(c) for c in columns])
    else:
        wide = df.agg(*[F.coalesce(F.abs(F.corr(F.col(c), F.col(target))), F.lit(0.0)).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("column"), F.when(F.isnan(c), 0.0).otherwise(F.col(c)).alias("importance"))
        for c in columns
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
