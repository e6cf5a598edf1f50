"""Validation and feature processing in front of the ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rankflow.operators.impute import impute
from rankflow.operators.profiling import quality_profile
from rankflow.operators.quality import WAREHOUSE_SPEC, Validation, completeness_rule, consistency_rule, correlation_rule, validate
from rankflow.operators.scale import outlier_report, scale, select_features, treat_outliers
from rankflow.operators.schema_rules import wide_features


def process_features(
    df: DataFrame,
    key: str,
    features: list[str] | None = None,
    imputation: str = "median",
    outliers: str = "iqr",
    scaling: str = "none",
    selection: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """Extract, fill, cap outliers, scale and optionally drop flat features; the key stays."""
    features = wide_features(df, features)
    keep = list(dict.fromkeys([key, *(order or []), *features]))
    filled = impute(df.select(*keep), features, imputation, key, order).select(key, *features)
    capped = treat_outliers(filled, features, outliers)
    scaled = scale(capped, features, scaling)
    return select_features(scaled, features) if selection else scaled


@dataclass
class Preprocessed:
    data: DataFrame
    validation: Validation
    quality: DataFrame
    outliers: DataFrame


def default_rules(key: str, features: list[str]) -> dict:
    """Safety and crime are both high-is-good after cleaning, so their correlation must be positive."""
    return {
        "safety_crime_relation": correlation_rule("safety_rate", "crime_rate", sign=1),
        "feature_completeness": completeness_rule(features),
        "value_consistency": consistency_rule(key, features),
    }


def preprocess(df: DataFrame, key: str = "country_name", spec=None, rules=None, **options) -> Preprocessed:
    """Validate with fixes, then process; the caller stores or caches `data` for many requests."""
    spec = spec or WAREHOUSE_SPEC
    features = wide_features(df, options.get("features") or [c for c in spec if c in df.columns and c != key])
    checked = validate(df, spec, rules if rules is not None else default_rules(key, features), key)
    fixed = checked.data if checked.data is not None else df
    return Preprocessed(
        process_features(fixed, key, **dict(options, features=features)),
        checked,
        quality_profile(fixed, features),
        outlier_report(impute(fixed.select(key, *features), features), features),
    )
