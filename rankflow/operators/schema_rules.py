"""Rules that look at column names and types only; they pick the columns of a Spark job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.config import COLUMN_SYNONYMS, ENTITY_WORDS, INDICATOR_WORDS, WAREHOUSE_NAMES


def entity_column(columns: list[str]) -> str | None:
    return next((c for c in columns if any(word in c.lower() for word in ENTITY_WORDS)), None)


def indicator_type(text: Column) -> Column:
    """First indicator type with one of its words in the (column names + file stem) text; NULL if none."""
    found = F.lit(None).cast("string")
    for name, words in reversed(INDICATOR_WORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.lower(text), F.lit(word))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def narrow_features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(("_rate", "_index"))]


def wide_features(df: DataFrame, target: list[str] | None = None) -> list[str]:
    # Numeric columns that describe the row, not the entity's quality.
    metadata = {"id", "country_id", "year", "population"}
    if target:
        chosen = [c for c in target if c in df.columns]
    else:
        chosen = [c for c in df.columns if c.endswith(("_rate", "_index", "_score"))]
        chosen += [
            c for c in numeric_columns(df) if c not in chosen and c not in metadata and not c.startswith("country")
        ]
    if not chosen:
        raise ValueError("no feature columns found")
    return chosen


# File-name words that give a bare `value` column its meaning.
FILE_WORDS = {
    "cultural_accessibility_score": ["cultural", "accessibility"],
    "tourism_arrivals": ["tourism", "arrival"],
    "natural_spaces_index": ["natural", "space", "protected"],
}


def _from_file(stem: str, names: list[str]) -> str | None:
    return next((n for n in names if any(w in stem for w in FILE_WORDS[n])), None)


def standard_name(column: str, stem: str = "") -> str:
    """Standard indicator name of a raw column.

    Order: exact synonym; bare `value`/`val` by file name; first synonym contained in the name or
    containing it; two-word hints; otherwise the cleaned name itself.
    """
    name, stem = column.lower().strip(), stem.lower()
    synonyms = dict(COLUMN_SYNONYMS, value=_from_file(stem, ["tourism_arrivals", "cultural_accessibility_score"]))
    if synonyms.get(name):
        return synonyms[name]
    if name in ("value", "val") and stem:
        found = _from_file(stem, list(FILE_WORDS))
    else:
        found = next((std for raw, std in synonyms.items() if std and (raw in name or name in raw)), None)
    if not found:
        # Words that together name an indicator.
        hints = [
            (["totalprotected"], "natural_spaces_index"),
            (["protected_area"], "natural_spaces_index"),
            (["health", "care"], "health_care_index"),
            (["cost", "living"], "cost_of_living_index"),
        ]
        found = next((std for words, std in hints if all(w in name for w in words)), None)
    return found or name.replace(" ", "_").replace("-", "_")


def standard_names(columns: list[str], stem: str, entity: str = "country") -> dict[str, str]:
    """Raw -> standard; two columns that would collide are an error, not a silent overwrite."""
    renames = {c: standard_name(c, stem) for c in columns if c != entity}
    seen: dict[str, str] = {}
    for raw, std in renames.items():
        if std in seen:
            raise ValueError(f"columns {seen[std]!r} and {raw!r} both map to {std!r}")
        seen[std] = raw
    return renames


def to_warehouse_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in WAREHOUSE_NAMES.items() if k in df.columns})
