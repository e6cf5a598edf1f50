"""A spread of registered queries against their SQL twins, on the smallest tables."""

import oracle
import pytest

from rankflow.queries import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "numeric_profile", "impute_most_frequent", "forward_fill", "winsor_scale", "treat_outliers", "business_rules",
    "fuzzy_edit_match", "close_names", "outer_merge", "merge_steps", "upsert", "upsert_buckets", "request_ratings", "stated_weights",
    "content_top_n", "similarity_euclidean", "hybrid_scores", "constraint_relaxation",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = all_queries()[name](spark, FOLDER).toPandas()
    assert oracle.differences(got, oracle.connect(FOLDER).execute(all_sql()[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
