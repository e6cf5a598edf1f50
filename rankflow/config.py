"""Fixed vocabularies and tunable settings."""

from __future__ import annotations

from dataclasses import dataclass

# Preference category -> feature columns.
CATEGORY_FEATURES = {
    "Budget friendliness": ["cost_of_living_rate"],
    "Safety level": ["safety_rate", "crime_rate"],
    "English speaking level": ["english_score_rate"],
    "Public transport access": ["public_transport_rate"],
    "Health care quality": ["health_care_rate"],
    "Culture accessibility rate": ["cultural_accessibility_rate"],
    "Nature and scenery": ["natural_spaces_rate"],
    "Tourism crowd level": ["tourism_arrivals_rate"],
}

# Request key -> preference category.
REQUEST_KEYS = {
    "budget": "Budget friendliness",
    "safety": "Safety level",
    "english": "English speaking level",
    "transport": "Public transport access",
    "health": "Health care quality",
    "culture": "Culture accessibility rate",
    "nature": "Nature and scenery",
    "tourism": "Tourism crowd level",
}

# Cleaned indicator column -> warehouse column.
WAREHOUSE_NAMES = {
    "country": "country_name",
    "crime_index": "crime_rate",
    "safety_index": "safety_rate",
    "english_score": "english_score_rate",
    "health_care_index": "health_care_rate",
    "cost_of_living_index": "cost_of_living_rate",
    "cultural_accessibility_score": "cultural_accessibility_rate",
    "public_transport_quality": "public_transport_rate",
    "tourism_arrivals": "tourism_arrivals_rate",
    "natural_spaces_index": "natural_spaces_rate",
}

WAREHOUSE_FEATURES = [v for k, v in WAREHOUSE_NAMES.items() if k != "country"]

# Indicator type -> words looked for in column names and file stem, first type wins.
INDICATOR_WORDS = {
    "crime": ["crime", "safety"],
    "english": ["english", "proficiency"],
    "health": ["health", "care", "medical"],
    "cost": ["cost", "living", "expense"],
    "cultural": ["cultural", "accessibility", "access"],
    "transport": ["transport", "transportation", "railroad", "public"],
    "tourism": ["tourism", "arrival", "visitor"],
    "natural": ["natural", "space", "environment"],
}

# Words that mark the entity column.
ENTITY_WORDS = ["country", "country_name", "nation"]

# Known raw column names -> standard indicator names, in matching order.
# `None` marks a name whose meaning depends on the file it came from.
COLUMN_SYNONYMS = {
    "crime index": "crime_index",
    "crime_index": "crime_index",
    "safety index": "safety_index",
    "safety_index": "safety_index",
    "english_score": "english_score",
    "english proficiency": "english_score",
    "english_proficiency": "english_score",
    "health_care_index": "health_care_index",
    "healthcare_index": "health_care_index",
    "health care index": "health_care_index",
    "cost_of_living_index": "cost_of_living_index",
    "cost of living index": "cost_of_living_index",
    "cost_of_living": "cost_of_living_index",
    "cultural_accessibility_score": "cultural_accessibility_score",
    "cultural accessibility score": "cultural_accessibility_score",
    "cultural_accessibility": "cultural_accessibility_score",
    "value": None,
    "public_transport_quality": "public_transport_quality",
    "public transport quality": "public_transport_quality",
    "railroad_quality": "public_transport_quality",
    "tourism_arrivals": "tourism_arrivals",
    "tourism arrivals": "tourism_arrivals",
    "international_tourism_arrivals": "tourism_arrivals",
    "natural_spaces_index": "natural_spaces_index",
    "natural spaces index": "natural_spaces_index",
    "natural_space": "natural_spaces_index",
    "totalprotectedareakm2": "natural_spaces_index",
    "total_protected_area_km2": "natural_spaces_index",
}

# Names (or name parts) of indicators where a low raw value is good.
LOWER_IS_BETTER = ["crime_index", "cost_of_living_index", "cost_of_living"]

# Defaults for a column that has no value at all.
EMPTY_DEFAULTS = {"tourism": 0.0, "natural": 0.1}
EMPTY_DEFAULT = 0.5


@dataclass(frozen=True)
class Settings:
    """Every number the ranking and cleaning jobs use."""

    winsor_lower: float = 1.0
    winsor_upper: float = 99.0
    fuzzy_threshold: int = 90
    low_missing: float = 0.10
    high_missing: float = 0.40
    min_ratings: int = 3
    ridge_alpha: float = 1.0
    max_learned_share: float = 0.8
    min_learned_confidence: float = 0.1
    content_weight: float = 0.5
    similarity_weight: float = 0.5
    min_ratings_for_similarity: int = 1
    similarity_confidence: float = 0.3
    liked_stars_unit: float = 0.6
    hard_importance: float = 80.0
    hard_quantile: float = 0.75
    min_results: int = 3
    relaxation_steps: int = 3
    diversity_lambda: float = 0.7
    top_n: int = 5
    use_preprocessing: bool = True
    use_similarity: bool = True
    use_constraints: bool = True
    use_mmr: bool = True
    polarity: str = "high_is_good"  # or "compat": cost/crime constraints read as low-is-good
