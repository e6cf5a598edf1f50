"""Column expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """Add a one-row result to every row as a struct, through a scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct("*").alias(name)).scalar())


# Vector arithmetic over plain columns is written as SQL text: one expression to parse instead of
# one call per operator, and the sums stay in generated code.


def plus(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def dot(left: list[str], right: list[str]) -> str:
    return plus(f"{a} * {b}" for a, b in zip(left, right))


def norm(parts: list[str]) -> str:
    return f"sqrt({dot(parts, parts)})"


def cosine(left: list[str], right: list[str]) -> str:
    """0 where either vector has no length."""
    return f"coalesce(try_divide({dot(left, right)}, {norm(left)} * {norm(right)}), 0D)"


def euclidean(left: list[str], right: list[str]) -> str:
    return f"sqrt({plus(f'({a} - {b}) * ({a} - {b})' for a, b in zip(left, right))})"


def manhattan(left: list[str], right: list[str]) -> str:
    return plus(f"abs({a} - {b})" for a, b in zip(left, right))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan}


def total(parts) -> Column:
    return F.expr(plus(parts))


def named(prefix: str, features: list[str]) -> list[str]:
    return [f"{prefix}{f}" for f in features]


def array_dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def array_cosine(a, b) -> Column:
    return F.coalesce(F.try_divide(array_dot(a, b), F.sqrt(array_dot(a, a)) * F.sqrt(array_dot(b, b))), F.lit(0.0))


def clip(x: Column, low, high) -> Column:
    """`greatest`/`least` skip NULLs, so a missing value has to be kept by hand."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def match_key(name: Column) -> Column:
    """Lower case, no punctuation, no white space; letters of every script are kept."""
    text = F.lower(F.trim(F.coalesce(name.cast("string"), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", ""), r"(?U)\s+", "")


def importance_weight(importance: Column) -> Column:
    return (
        F.when(importance <= 0, F.lit(0.0))
        .when(importance >= 100, F.lit(1.0))
        .otherwise(F.pow(importance / F.lit(100.0), F.lit(1.5)))
    )


def importance_label(importance: Column) -> Column:
    # Wording of the four levels.
    return (
        F.when(importance >= 90, "extremely important")
        .when(importance >= 70, "very important")
        .when(importance >= 50, "moderately important")
        .otherwise("somewhat important")
    )


def stars_in_range(stars: Column) -> Column:
    return stars.between(1, 5)


def stars_to_unit(stars: Column) -> Column:
    return F.when(stars_in_range(stars), stars * F.lit(0.2))


def unit_to_stars(unit: Column) -> Column:
    return F.when(unit.between(0.2, 1.0), unit / F.lit(0.2))


def ratings_map_to_unit(ratings: Column) -> Column:
    return F.transform_values(ratings, lambda _, stars: stars_to_unit(stars))


def is_positive(stars: Column, threshold: float = 3.5) -> Column:
    return stars >= F.lit(float(threshold))


def is_unit_positive(unit: Column, threshold: float = 3.5) -> Column:
    if not 1 <= threshold <= 5:
        raise ValueError(f"star threshold must lie in 1-5, got {threshold}")
    return unit >= F.lit(float(threshold) * 0.2)


def scale_score(score: Column, scaling: str = "linear") -> Column:
    if scaling == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-10.0) * (score - F.lit(0.5))))
    if scaling == "exponential":
        return F.when(score > 0, score * score).otherwise(F.lit(0.0))
    return clip(score, 0, 1)


def readable(feature: str) -> str:
    return feature.replace("_rate", "").replace("_", " ").title()


def low_is_good(feature: str, polarity: str) -> bool:
    """Cleaned features are all high-is-good; "compat" reads cost and crime the other way round."""
    return polarity == "compat" and ("cost" in feature.lower() or "crime" in feature.lower())
