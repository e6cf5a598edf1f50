"""Token-set similarity of names, as a vectorized UDF over (name, block of names)."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(text: str) -> str:
    ascii_only = text.encode("ascii", "ignore").decode()
    return re.sub(r"\W", " ", ascii_only).lower().strip()


def _percent(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b).ratio())


def token_set_ratio(a: str, b: str) -> int:
    """0-100. Best pairwise ratio of: shared tokens, shared + rest of a, shared + rest of b."""
    a, b = _clean(a), _clean(b)
    if not a or not b:
        return 0
    if a == b:
        return 100
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    with_left = f"{shared} {' '.join(sorted(left - right))}".strip()
    with_right = f"{shared} {' '.join(sorted(right - left))}".strip()
    return max(_percent(shared, with_left), _percent(shared, with_right), _percent(with_left, with_right))


def _scores(names: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([[token_set_ratio(n, o) for o in block] for n, block in zip(names, others)])


def token_set_scores(name: Column | str, others: Column | str) -> Column:
    """One score per entry of the array `others`."""
    return F.pandas_udf(_scores, "array<int>")(name, others)
