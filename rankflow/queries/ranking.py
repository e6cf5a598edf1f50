"""Profiles, scores, constraints, diversity and recommendations over customers and suppliers."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.functions import expr as X
from rankflow.functions.blocks import place
from rankflow.operators import constrain, diversify, profile, scoring
from rankflow.operators.quality import ColumnSpec
from rankflow.operators.scale import z_scores
from rankflow.plans import evaluate as evaluation
from rankflow.plans.recommend import catalog_items, ranking_state, recommend
from rankflow.queries.data import (
    BASE, CONTENT_SQL, FEATURES, HYBRID, HYBRID_LEARNED, LEARNED, MAPPING, POOLED_SQL, Z, cos, each, fixed_confidence,
    importance, items, mmr_sql, on_train, open_pairs, plus, r6, ratings, rd, relax_sql, stored_ratings,
    table, treated_sql,
)

QUERIES, SQL = {}, {}
S = Settings()


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def stated(spark, d):
    return profile.stated_weights(importance(spark, d), MAPPING)


def stated_profiles(spark, d):
    """Profiles that rest on stated importances alone."""
    return profile.build_profiles(importance(spark, d), None, None, MAPPING)


def with_z(spark, d):
    return z_scores(items(spark, d), FEATURES)


def fixed_profiles(spark, d, z_items, rated=None):
    """Stated weights, real rating counts and liked sums, and a confidence SQL can compute as well."""
    sums = profile.rating_sums(ratings(spark, d) if rated is None else rated, z_items, FEATURES)
    both = stated(spark, d).join(sums, "user_id", "left")
    return both.withColumnsRenamed({f"stated_{f}": f"weight_{f}" for f in FEATURES}).withColumns(
        {
            "confidence": fixed_confidence(),
            "n_given": F.coalesce("n_given", F.lit(0)),
            "n_liked": F.coalesce("n_liked", F.lit(0)),
        }
    )


def hybrid(spark, d):
    z_items = with_z(spark, d)
    return scoring.hybrid_scores(fixed_profiles(spark, d, z_items), z_items, FEATURES, S)


def state(spark, d):
    """(users, catalog, cells) with thresholds, requirement order and rated items."""
    z_items, rated = with_z(spark, d), stored_ratings(spark, d)
    return ranking_state(None, rated, z_items, MAPPING, S, fixed_profiles(spark, d, z_items, rated))


def candidates(spark, d):
    """The unrated scored pairs, as a re-ranker is given them."""
    users, catalog, cells = state(spark, d)
    return diversify.Candidates(users, catalog, scoring.score_sql(FEATURES), scoring.UNRATED, cells)


CANDIDATES = """candidates AS (
  SELECT * FROM hybrid h WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = h.user_id AND r.item = h.item))"""
TOP5 = "SELECT user_id, rank, item, {score} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM {source}) WHERE rank <= 5"


# ---- profiles --------------------------------------------------------------------------


@query(
    "stated_weights",
    f"{BASE} SELECT user_id, feature, round(weight, 6) + 0.0 AS weight FROM ("
    + " UNION ALL ".join(f"SELECT user_id, '{f}' AS feature, weight_{f} AS weight FROM stated" for f in FEATURES)
    + ") WHERE weight IS NOT NULL",
)
def stated_weights(spark, d):
    return profile.long_weights(stated(spark, d), FEATURES, "stated").select("user_id", "feature", r6("weight"))


@query(
    "high_importance_features",
    f"{BASE} SELECT DISTINCT user_id, feature FROM shares WHERE importance >= 80",
)
def high_importance_features(spark, d):
    view = profile.profile_view(stated_profiles(spark, d), FEATURES)
    return view.select("user_id", F.explode("high_importance_features").alias("feature"))


@query(
    "rating_normalization",
    f"""{BASE} SELECT user_id, item, rating, round(rating * 0.2, 6) + 0.0 AS unit, round(rating * 0.2 / 0.2, 6) + 0.0 AS stars,
    rating >= 3.5 AS positive, rating * 0.2 >= 3.5 * 0.2 AS unit_positive FROM ratings""",
)
def rating_normalization(spark, d):
    unit = X.stars_to_unit(F.col("rating"))
    return ratings(spark, d).select(
        "user_id", "item", "rating", r6(unit, "unit"), r6(X.unit_to_stars(unit), "stars"),
        X.is_positive(F.col("rating")).alias("positive"), X.is_unit_positive(unit).alias("unit_positive"),
    )


@query(
    "rating_rejects",
    "SELECT event_id, floor(value / 20)::DOUBLE AS rating FROM events WHERE floor(value / 20) NOT BETWEEN 1 AND 5",
)
def rating_rejects(spark, d):
    """Event values read as stars; what is outside 1-5 goes to the side output."""
    stars = table(spark, d, "events").select("event_id", F.floor(F.col("value") / 20).cast("double").alias("rating"))
    return profile.rejected_ratings(stars)


_SUMS = {
    "sx": FEATURES,
    "sxx": [f"{a} * {b}" for a, b in combinations_with_replacement(FEATURES, 2)],
    "sxy": [f"{f} * y" for f in FEATURES],
}


@query(
    "rating_sums",
    f"""{BASE}, x AS (SELECT user_id, item, rating * 0.2 AS y, {each('{f}')}, {', '.join(Z)} FROM ratings JOIN itemz USING (item)),
    g AS (SELECT user_id, count(*) AS n_given FROM ratings GROUP BY user_id)
    SELECT user_id, n_given, count(*) AS n, count(*) FILTER (y >= 0.6) AS n_liked, {rd('sum(y)', 'sy')}, {rd('sum(y * y)', 'syy')},
    {', '.join(f"round(sum({v}), 6) + 0.0 AS {name}{i}" for name, values in _SUMS.items() for i, v in enumerate(values))},
    {', '.join(f"round(coalesce(sum({z}) FILTER (y >= 0.6), 0), 6) + 0.0 AS sliked{i}" for i, z in enumerate(Z))}
    FROM x JOIN g USING (user_id) GROUP BY user_id, n_given""",
)
def rating_sums(spark, d):
    sums = profile.rating_sums(ratings(spark, d), with_z(spark, d), FEATURES)
    sizes = {name: len(values) for name, values in _SUMS.items()} | {"sliked": len(FEATURES)}
    return sums.select(
        "user_id", "n_given", "n", "n_liked", r6("sy"), r6("syy"),
        *[r6(F.col(name)[i], f"{name}{i}") for name, n in sizes.items() for i in range(n)],
    )


@query(
    "learned_weights",
    f"""{LEARNED} SELECT user_id, n_given, {rd('confidence', 'confidence')},
    {each('round(learned_{f}, 6) + 0.0 AS learned_{f}')} FROM learned""",
)
def learned_weights(spark, d):
    sums = profile.rating_sums(ratings(spark, d), items(spark, d), FEATURES)
    return profile.learned_weights(sums, FEATURES).select(
        "user_id", "n_given", r6("confidence"), *[r6(f"learned_{f}") for f in FEATURES]
    )


@query(
    "user_profiles",
    f"""{LEARNED} SELECT user_id, n_given AS num_ratings, {rd('confidence', 'confidence')},
    concat_ws(',', {each("CASE WHEN hard_{f} IS NOT NULL THEN '{f}' END")}) AS high_importance_features,
    {', '.join(f'round({kind}_{f}, 6) + 0.0 AS {kind}_{f}' for kind in ('weight', 'learned', 'stated') for f in FEATURES)} FROM blended""",
)
def user_profiles(spark, d):
    """The weight maps of each profile, entry by entry."""
    z_items = with_z(spark, d)
    view = profile.profile_view(profile.build_profiles(importance(spark, d), ratings(spark, d), z_items, MAPPING), FEATURES)
    maps = {"weight": "feature_weights", "learned": "learned_weights", "stated": "stated_weights"}
    return view.select(
        "user_id", F.col("num_ratings").cast("long").alias("num_ratings"), r6("confidence"),
        F.concat_ws(",", "high_importance_features").alias("high_importance_features"),
        *[r6(F.try_element_at(m, F.lit(f)), f"{kind}_{f}") for kind, m in maps.items() for f in FEATURES],
    )


@query(
    "profile_update",
    f"""{LEARNED} SELECT user_id, n_given, {rd('confidence', 'confidence')},
    {', '.join(f'round({kind}_{f}, 6) + 0.0 AS {kind}_{f}' for kind in ('learned', 'weight') for f in FEATURES)} FROM blended""",
)
def profile_update(spark, d):
    """Profiles after an update: sums of the ratings with an odd user + item are stored, the others' are added, weights blended anew."""
    every = ratings(spark, d)
    later = (F.col("user_id") + F.col("item")) % 2 == 0
    it = items(spark, d)
    merged = profile.add_sums(
        profile.rating_sums(every.where(~later), it, FEATURES), profile.rating_sums(every.where(later), it, FEATURES), FEATURES
    )
    profiles = profile.build_profiles(importance(spark, d), None, it, MAPPING, FEATURES, S, merged)
    return profiles.select("user_id", "n_given", r6("confidence"), *[r6(f"{kind}_{f}") for kind in ("learned", "weight") for f in FEATURES])


_STRONGEST = ", ".join(
    f"CASE WHEN weight_{f} IS NOT NULL THEN {{'w': -weight_{f}, 'i': {i}, 'n': '{X.readable(f)}'}} END" for i, f in enumerate(FEATURES)
)
_REQUIRED = ", ".join(f"CASE WHEN hard_{f} IS NOT NULL THEN '{X.readable(f)}' END" for f in FEATURES)


@query(
    "explain_profiles",
    f"""{LEARNED} SELECT user_id, CASE WHEN confidence > 0.6 THEN 'Primarily based on learned patterns from ' || n_given || ' ratings'
    WHEN confidence > 0.3 THEN 'Balanced mix of stated preferences and learned patterns' ELSE 'Based on stated importance scores' END AS strategy,
    array_to_string(list_transform(list_sort(list_filter([{_STRONGEST}], lambda e: e IS NOT NULL))[1:5], lambda e: format('{{}}: {{:.3f}}', e.n, -e.w)), ', ')
    AS top_preferences, concat_ws(', ', {_REQUIRED}) AS hard_requirements FROM blended""",
)
def explain_profiles(spark, d):
    z_items = with_z(spark, d)
    profiles = profile.build_profiles(importance(spark, d), ratings(spark, d), z_items, MAPPING)
    return profile.explain_profiles(profiles, FEATURES)


_NAMES = ", ".join(
    f"('{c}', '{', '.join(f.replace('_rate', '').replace('_', ' ') for f in fs)}')" for c, fs in MAPPING.items()
)


@query(
    "explain_importance",
    f"""{BASE} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, ord) AS rank, category, level,
    category || ' (' || importance::INT || '/100) is ' || level || ' → emphasizing ' || names AS sentence
    FROM (SELECT *, CASE WHEN importance >= 90 THEN 'extremely important' WHEN importance >= 70 THEN 'very important'
    WHEN importance >= 50 THEN 'moderately important' ELSE 'somewhat important' END AS level FROM importance)
    JOIN (VALUES {_NAMES}) m(category, names) USING (category)""",
)
def explain_importance(spark, d):
    return profile.explain_importance(importance(spark, d), MAPPING)


# ---- scores ----------------------------------------------------------------------------

_CONTENT = f"{BASE}, content AS (SELECT user_id, item, {CONTENT_SQL} AS score FROM stated, items)"


@query(
    "content_top_n",
    f"""{_CONTENT}, unrated AS (SELECT * FROM content c WHERE NOT EXISTS
    (SELECT 1 FROM ratings r WHERE r.user_id = c.user_id AND r.item = c.item)) """
    + TOP5.format(score=rd("score", "score"), source="unrated"),
)
def content_top_n(spark, d):
    """Stated weights -> content score -> without rated items -> best five per user."""
    return scoring.content_ranking(stated_profiles(spark, d), ratings(spark, d), items(spark, d), FEATURES, 5).select(
        "user_id", "rank", "item", r6("score")
    )


@query("content_scores", f"{_CONTENT} SELECT user_id, item, {rd('greatest(0.0, least(1.0, score))', 'score')} FROM content")
def content_scores(spark, d):
    return scoring.content_scores(stated_profiles(spark, d), items(spark, d), FEATURES).select(
        "user_id", "item", r6("score")
    )


@query(
    "score_scaling",
    f"""{_CONTENT} SELECT user_id, item, {rd('1 / (1 + exp(-10 * (score - 0.5)))', 'sigmoid')},
    {rd('CASE WHEN score > 0 THEN score * score ELSE 0 END', 'squared')} FROM content""",
)
def score_scaling(spark, d):
    raw = scoring.content_scores(stated_profiles(spark, d), items(spark, d), FEATURES)
    return raw.select(
        "user_id", "item", r6(X.scale_score(F.col("score"), "sigmoid"), "sigmoid"),
        r6(X.scale_score(F.col("score"), "exponential"), "squared"),
    )


@query(
    "baseline_ranking",
    f"""{BASE}, tens AS (SELECT user_id, {each("coalesce(sum(CASE WHEN feature = '{f}' THEN importance / 10.0 END), 0) AS b_{f}")}
    FROM shares GROUP BY user_id),
    plain AS (SELECT user_id, item, {plus(f'{f} * b_{f}' for f in FEATURES)} AS score FROM tens, items) """
    + TOP5.format(score=rd("score", "score"), source="plain"),
)
def baseline_ranking(spark, d):
    return scoring.baseline_ranking(importance(spark, d), items(spark, d), MAPPING, 5).select(
        "user_id", "rank", "item", r6("score")
    )


def _similarity_sql(metric: str) -> str:
    z, p = Z, [f"p_{f}" for f in FEATURES]
    if metric == "cosine":
        raw = f"SELECT user_id, item, {cos(z, p)} AS score FROM given, itemz WHERE n_liked > 0"
    else:
        parts = [f"pow({a} - {b}, 2)" if metric == "euclidean" else f"abs({a} - {b})" for a, b in zip(z, p)]
        dist = f"sqrt{plus(parts)}" if metric == "euclidean" else plus(parts)
        raw = f"""SELECT user_id, item, 1 - dist / coalesce(nullif(max(dist) OVER (PARTITION BY user_id), 0), 1) AS score
        FROM (SELECT user_id, item, {dist} AS dist FROM given, itemz WHERE n_liked > 0)"""
    return f"{BASE} SELECT user_id, item, {rd('greatest(0.0, least(1.0, score))', 'score')} FROM ({raw})"


def _similarity_query(metric: str):
    def run(spark, d):
        z_items = with_z(spark, d)
        sums = profile.rating_sums(ratings(spark, d), z_items, FEATURES)
        return scoring.similarity_scores(sums, z_items, FEATURES, metric).select("user_id", "item", r6("score"))

    run.__doc__ = f"Similarity ({metric}) of every supplier to each customer's liked suppliers."
    return run


for _metric in ("cosine", "euclidean", "manhattan"):
    query(f"similarity_{_metric}", _similarity_sql(_metric))(_similarity_query(_metric))


@query(
    "similarity_targets",
    f"""{BASE} SELECT user_id, item, {rd(f"greatest(0.0, least(1.0, {cos(Z, [f'p_{f}' for f in FEATURES])}))", 'score')}
    FROM given, itemz JOIN supplier ON item = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE n_liked > 0 AND r_name = 'ASIA'""",
)
def similarity_targets(spark, d):
    """Scored over all suppliers, answered for those of one region."""
    z_items = with_z(spark, d)
    sums = profile.rating_sums(ratings(spark, d), z_items, FEATURES)
    targets = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("item"))
    )
    return scoring.similarity_scores(sums, z_items, FEATURES, targets=targets).select("user_id", "item", r6("score"))


@query(
    "most_similar_items",
    f"""{BASE}, refs AS (SELECT arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS item FROM supplier GROUP BY s_nationkey),
    near AS (SELECT a.item AS user_id, b.item, greatest(0.0, least(1.0, {cos([f'b.{z}' for z in Z], [f'a.{z}' for z in Z])})) AS score
    FROM itemz a JOIN refs ON refs.item = a.item JOIN itemz b ON a.item <> b.item)
    SELECT user_id AS reference, rank, item, {rd('score', 'score')} FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM near) WHERE rank <= 5""",
)
def most_similar_items(spark, d):
    """Nearest suppliers of each nation's supplier with the highest balance."""
    refs = table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("item")
    )
    return scoring.most_similar(with_z(spark, d), refs, FEATURES).select("reference", "rank", "item", r6("score"))


@query(
    "nearest_vectors",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    q AS (SELECT min(vec_id) AS vec_id FROM e GROUP BY label),
    s AS (SELECT a.vec_id AS reference, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score
    FROM e a JOIN q ON q.vec_id = a.vec_id JOIN e b ON a.vec_id <> b.vec_id)
    SELECT reference, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY reference
    ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def nearest_vectors(spark, d):
    """Nearest embeddings of the first vector of each label."""
    e = table(spark, d, "embeddings")
    asked = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id")
    return scoring.nearest_vectors(e, asked, "vec_id", "embedding").select("reference", "rank", "vec_id", r6("score"))


@query(
    "adaptive_weights",
    f"""{HYBRID} SELECT DISTINCT user_id, CASE WHEN blend THEN 'hybrid' ELSE 'content_only' END AS strategy,
    {rd('content_weight', 'content_weight')}, {rd('similarity_weight', 'similarity_weight')} FROM hybrid""",
)
def adaptive_weights(spark, d):
    z_items = with_z(spark, d)
    users = scoring.hybrid_users(fixed_profiles(spark, d, z_items), scoring.catalog_of(z_items, FEATURES), FEATURES, S)
    return users.select("user_id", scoring.strategy().alias("strategy"), r6("content_weight"), r6("similarity_weight"))


@query(
    "hybrid_scores",
    f"""{HYBRID} SELECT user_id, item, {rd('content_score', 'content_score')}, {rd('similarity_score', 'similarity_score')},
    {rd('score', 'score')} FROM hybrid""",
)
def hybrid_scores(spark, d):
    return hybrid(spark, d).select("user_id", "item", r6("content_score"), r6("similarity_score"), r6("score"))


@query(
    "combine_scores",
    f"""{BASE}, c AS (SELECT user_id, item, {CONTENT_SQL} AS score FROM stated, items),
    s AS (SELECT user_id, item, greatest(0.0, least(1.0, {cos(Z, [f'p_{f}' for f in FEATURES])})) AS score FROM given, itemz WHERE n_liked > 0)
    SELECT coalesce(c.user_id, s.user_id) AS user_id, coalesce(c.item, s.item) AS item,
    {rd('0.6 * coalesce(c.score, 0) + 0.4 * coalesce(s.score, 0)', 'score')}
    FROM c FULL JOIN s ON c.user_id = s.user_id AND c.item = s.item""",
)
def combine_scores(spark, d):
    z_items = with_z(spark, d)
    content = scoring.content_scores(stated_profiles(spark, d), z_items, FEATURES)
    sums = profile.rating_sums(ratings(spark, d), z_items, FEATURES)
    similar = scoring.similarity_scores(sums, z_items, FEATURES)
    return scoring.combine_scores(content, similar, 0.6, 0.4).select("user_id", "item", r6("score"))


@query(
    "score_confidence",
    f"""{HYBRID} SELECT user_id, {rd('''greatest(0.1, least(1.0, CASE WHEN max(blend) THEN 0.8 ELSE 0.6 END
    * least(1.0, var_pop(score) * 4) * CASE WHEN max(n_given) > 0 THEN least(1.0, max(n_given) / 8.0) ELSE 1.0 END
    * CASE WHEN max(blend) THEN max(confidence) ELSE 0.5 END))''', 'score_confidence')} FROM hybrid GROUP BY user_id""",
)
def score_confidence(spark, d):
    z_items = with_z(spark, d)
    return scoring.score_confidence(fixed_profiles(spark, d, z_items), z_items, FEATURES).select(
        "user_id", r6("score_confidence")
    )


def _likeness(f: str) -> str:
    t, p = f"z_{f}", f"l_{f}"
    return f"""CASE WHEN {p} IS NULL THEN NULL WHEN abs({t}) < 1e-10 AND abs({p}) < 1e-10 THEN 1.0
    ELSE greatest(0.0, 1 - abs({t} - {p}) / (greatest(abs({t}), abs({p})) + 1e-10)) END"""


_PLAIN = f"{BASE}, plain AS (SELECT user_id, item, {CONTENT_SQL} AS score FROM stated, items), picked AS ({TOP5.format(score='score', source='plain')})"


@query(
    "explain_scores",
    f"""{_PLAIN}, lm AS (SELECT user_id, {each('avg(z_{f}) AS l_{f}')} FROM ratings JOIN itemz USING (item)
    WHERE rating >= 3.5 GROUP BY user_id),
    lik AS (SELECT user_id, {each('CASE WHEN abs(l_{f}) < 1e-9 THEN 0.0 ELSE l_{f} END AS l_{f}')} FROM lm),
    r AS (SELECT k.user_id, k.item, {each('weight_{f}')}, {each('i.{f}')}, {each('z_{f}')}, {each('l_{f}')},
    {plus(f'coalesce(weight_{f}, 0)' for f in FEATURES)} AS tot
    FROM picked k JOIN stated USING (user_id) JOIN itemz i ON i.item = k.item LEFT JOIN lik ON lik.user_id = k.user_id)
    """
    + " UNION ALL ".join(
        f"""SELECT user_id, item, '{f}' AS feature, round(CASE WHEN weight_{f} > 0 THEN weight_{f} / nullif(tot, 0) * {f} END, 6) + 0.0
        AS contribution, round({_likeness(f)}, 6) + 0.0 AS feature_similarity FROM r"""
        for f in FEATURES
    ),
)
def explain_scores(spark, d):
    """Each customer's five best suppliers by content, feature by feature."""
    z_items, profiles = with_z(spark, d), stated_profiles(spark, d)
    best = best_five(spark, d, z_items)
    liked = ratings(spark, d).where(X.is_positive(F.col("rating")))
    return scoring.explain_scores(best.select("user_id", "item"), profiles, z_items, FEATURES, liked).select(
        "user_id", "item", "feature", r6("contribution"), r6("feature_similarity")
    )


# ---- constraints -----------------------------------------------------------------------


@query(
    "category_thresholds",
    f"{BASE} SELECT category, {rd('quantile_cont(value, 0.75)', 'threshold')} FROM ({POOLED_SQL}) GROUP BY category",
)
def category_thresholds(spark, d):
    return constrain.category_thresholds(items(spark, d), MAPPING).select("category", r6("threshold"))


@query(
    "hard_filter",
    f"{HYBRID}, {open_pairs()}, {relax_sql(0)} SELECT user_id, item FROM relaxed WHERE passes",
)
def hard_filter(spark, d):
    users, catalog, cells = state(spark, d)
    return constrain.passing_pairs(users, catalog, FEATURES).select("user_id", "item")


@query(
    "constraint_impact",
    f"""{HYBRID}, {open_pairs()}, {relax_sql(0)} """
    + " UNION ALL ".join(
        f"SELECT user_id, '{f}' AS feature, count(*) FILTER (is_top AND {f} < t_{f}) AS impact FROM relaxed "
        f"GROUP BY user_id HAVING max(t_{f}) IS NOT NULL"
        for f in FEATURES
    ),
)
def constraint_impact(spark, d):
    users, catalog, cells = state(spark, d)
    return constrain.constraint_impact(users, catalog, FEATURES, cells)


@query(
    "constraint_relaxation",
    f"""{HYBRID}, {open_pairs()}, {relax_sql()} SELECT user_id, item, level AS relaxation_level, relaxed
    FROM relaxed WHERE passes""",
)
def constraint_relaxation(spark, d):
    users, catalog, cells = state(spark, d)
    # Worded once a user, not for every pair.
    text = F.concat_ws("", F.transform("relaxed", lambda f: F.concat(F.lit(","), f)))
    relaxed = constrain.relax(users, catalog, FEATURES, S, cells).select("user_id", "_t", "relaxation_level", text.alias("relaxed"))
    return constrain.passing_pairs(relaxed, catalog, FEATURES).select("user_id", "item", "relaxation_level", "relaxed")


@query(
    "constraint_summary",
    f"""{HYBRID}, {open_pairs()}, {relax_sql()} SELECT user_id, count(*) FILTER (passes) AS num_results,
    max(level) AS relaxation_level FROM relaxed GROUP BY user_id""",
)
def constraint_summary(spark, d):
    users, catalog, cells = state(spark, d)
    summary = constrain.constraint_summary(constrain.relax(users, catalog, FEATURES, S, cells), catalog, FEATURES)
    return summary.select("user_id", "num_results", "relaxation_level")


def _removed(f: str) -> str:
    earlier = " AND ".join(f"(NOT coalesce(t_{j} IS NOT NULL AND place_{j} < place_{f}, false) OR {j} >= t_{j})" for j in FEATURES if j != f)
    return f"count(*) FILTER ({f} < t_{f} AND {earlier}) AS r_{f}"


_APPLIED = ", ".join(f"CASE WHEN r_{f} > 0 THEN {{'p': place_{f}, 'x': format('{f} threshold: {{:.2f}}', t_{f})}} END" for f in FEATURES)
_SECTION = "CASE WHEN len({list}) > 0 THEN list_concat([{title}], list_transform({list}, lambda x: '  • ' || x)) ELSE [] END"


@query(
    "explain_constraints",
    f"""{HYBRID}, {open_pairs()}, {relax_sql()}, counted AS (SELECT user_id, count(*) FILTER (passes) AS n, max(level) AS level, max(relaxed) AS relaxed,
    {each('max(t_{f}) AS t_{f}, max(place_{f}) AS place_{f}')}, {', '.join(map(_removed, FEATURES))} FROM relaxed GROUP BY user_id),
    worded AS (SELECT user_id, n, level, list_filter(string_split(relaxed, ','), lambda x: x <> '') AS loose,
      list_transform(list_sort(list_filter([{_APPLIED}], lambda e: e IS NOT NULL)), lambda e: e.x) AS applied FROM counted),
    hard AS (SELECT user_id, string_agg(category, ', ' ORDER BY ord) AS names FROM importance WHERE importance >= 80 GROUP BY user_id)
    SELECT user_id, array_to_string(list_concat(CASE WHEN names IS NOT NULL THEN ['High importance preferences (≥80): ' || names] ELSE [] END,
      {_SECTION.format(list='applied', title="'Applied constraints:'")},
      {_SECTION.format(list='loose', title="'Relaxed constraints (level ' || level || '):'")},
      ['Final results: ' || n || ' items']), chr(10)) AS explanation FROM worded LEFT JOIN hard USING (user_id)""",
)
def explain_constraints(spark, d):
    users, catalog, cells = state(spark, d)
    summary = constrain.constraint_summary(constrain.relax(users, catalog, FEATURES, S, cells), catalog, FEATURES)
    return constrain.explain_constraints(summary, importance(spark, d))


# ---- diversity -------------------------------------------------------------------------

_MMR = f"{HYBRID}, {CANDIDATES}, {mmr_sql('candidates')}"


@query("mmr", f"{_MMR} SELECT user_id, rank, item, {rd('score', 'score')} FROM picks")
def mmr(spark, d):
    return diversify.mmr(candidates(spark, d), FEATURES).select("user_id", "rank", "item", r6("score"))


@query(
    "diversity_score",
    f"""{_MMR}, near AS (SELECT a.user_id, avg({cos([f'a.{z}' for z in Z], [f'b.{z}' for z in Z])}) AS near
    FROM picks a JOIN picks b ON a.user_id = b.user_id AND a.item < b.item GROUP BY a.user_id)
    SELECT user_id, round(greatest(0.0, least(1.0, 1 - coalesce(near, 0))), 6) + 0.0 AS diversity_score
    FROM (SELECT DISTINCT user_id FROM picks) LEFT JOIN near USING (user_id)""",
)
def diversity_score(spark, d):
    return diversify.diversity_score(diversify.mmr(candidates(spark, d), FEATURES), FEATURES).select(
        "user_id", r6("diversity_score")
    )


def best_five(spark, d, it):
    users = place(scoring.content_users(stated_profiles(spark, d), FEATURES))
    catalog = scoring.pack_items(it.select("item", *FEATURES), FEATURES).select("item", "_i")
    return scoring.top_pairs(users, catalog, scoring.content_sql(FEATURES), 5)


def top_five(spark, d):
    it = items(spark, d)
    return best_five(spark, d, it).join(it, "item")


_CV = "coalesce(stddev_samp({f}) / nullif(avg({f}), 0), 0)"


@query(
    "feature_diversity",
    f"{_PLAIN}, sel AS (SELECT * FROM picked JOIN items USING (item)) "
    + " UNION ALL ".join(
        f"""SELECT user_id, '{f}' AS feature, round({_CV.format(f=f)}, 6) + 0.0 AS coefficient_of_variation,
        round(min({f}), 6) + 0.0 AS low, round(max({f}), 6) + 0.0 AS high,
        CASE WHEN {_CV.format(f=f)} > 0.2 THEN 'high' WHEN {_CV.format(f=f)} > 0.1 THEN 'moderate' ELSE 'low' END AS diversity_level
        FROM sel GROUP BY user_id HAVING count({f}) > 1"""
        for f in FEATURES
    ),
)
def feature_diversity(spark, d):
    return diversify.feature_diversity(top_five(spark, d), FEATURES).select(
        "user_id", "feature", r6("coefficient_of_variation"), r6("low"), r6("high"), "diversity_level"
    )


_DIST = "sqrt" + plus(f"pow(a.{z} - b.{z}, 2)" for z in Z)


@query(
    "clustering",
    f"""{_PLAIN}, sel AS (SELECT user_id, item,
    {each('coalesce(({f} - avg({f}) OVER w) / nullif(stddev_pop({f}) OVER w, 0), 0) AS z_{f}')}
    FROM picked JOIN items USING (item) WINDOW w AS (PARTITION BY user_id))
    SELECT a.user_id, {rd(f'avg({_DIST})', 'average_pairwise_distance')},
    CASE WHEN avg({_DIST}) > 1.5 THEN 'diverse' ELSE 'clustered' END AS clustering_tendency, count(*) AS num_distances
    FROM sel a JOIN sel b ON a.user_id = b.user_id AND a.item < b.item GROUP BY a.user_id HAVING count(*) >= 3""",
)
def clustering(spark, d):
    return diversify.clustering(top_five(spark, d), FEATURES).select(
        "user_id", r6("average_pairwise_distance"), "clustering_tendency", "num_distances"
    )


@query(
    "set_size_label",
    f"""{_PLAIN} SELECT user_id, count(*) AS num_items, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'moderate' END
    AS estimated_diversity FROM picked GROUP BY user_id""",
)
def set_size_label(spark, d):
    return diversify.set_size_label(top_five(spark, d))


_LEVELS = " UNION ALL ".join(
    f"""SELECT user_id, '{f}' AS feature, CASE WHEN {_CV.format(f=f)} > 0.2 THEN 'high' WHEN {_CV.format(f=f)} > 0.1 THEN 'moderate' ELSE 'low' END
    AS level FROM sel GROUP BY user_id HAVING count({f}) > 1"""
    for f in FEATURES
)


@query(
    "diversity_analysis",
    f"""{_PLAIN}, sel AS (SELECT * FROM picked JOIN items USING (item)), levels AS ({_LEVELS}),
    per AS (SELECT user_id, string_agg(feature || '=' || level, ',' ORDER BY feature) AS feature_levels FROM levels GROUP BY user_id),
    zed AS (SELECT user_id, item, {each('coalesce(({f} - avg({f}) OVER w) / nullif(stddev_pop({f}) OVER w, 0), 0) AS z_{f}')}
    FROM sel WINDOW w AS (PARTITION BY user_id)),
    apart AS (SELECT a.user_id, {rd(f'avg({_DIST})', 'average_pairwise_distance')},
    CASE WHEN avg({_DIST}) > 1.5 THEN 'diverse' ELSE 'clustered' END AS clustering_tendency, count(*) AS num_distances
    FROM zed a JOIN zed b ON a.user_id = b.user_id AND a.item < b.item GROUP BY a.user_id HAVING count(*) >= 3)
    SELECT user_id, num_items, CASE WHEN num_items >= 5 THEN 'high' ELSE 'moderate' END AS estimated_diversity, feature_levels,
    average_pairwise_distance, clustering_tendency, num_distances
    FROM (SELECT user_id, count(*) AS num_items FROM picked GROUP BY user_id HAVING count(*) >= 2) LEFT JOIN per USING (user_id) LEFT JOIN apart USING (user_id)""",
)
def diversity_analysis(spark, d):
    """Size label, spread per feature (as `feature=level`) and clustering of each customer's five best suppliers."""
    levels = F.array_sort(F.transform(F.map_entries("feature_levels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    out = diversify.diversity_analysis(top_five(spark, d), FEATURES)
    return out.withColumns({"feature_levels": F.concat_ws(",", levels), "average_pairwise_distance": r6(F.col("average_pairwise_distance"))})


# ---- recommendations -------------------------------------------------------------------

_NEW = f"{_CONTENT}, hybrid AS (SELECT user_id, c.item, score, {each('i.{f}')}, {each('hard_{f}, place_{f}')} FROM content c JOIN items i USING (item) JOIN stated USING (user_id))"
_NO_RATINGS = open_pairs().replace("LEFT JOIN ratings r ON h.user_id = r.user_id AND h.item = r.item", "LEFT JOIN (SELECT NULL AS item) r ON false")


@query(
    "recommend_new_users",
    f"""{_NEW}, {_NO_RATINGS}, {relax_sql()}, kept AS (SELECT * FROM relaxed WHERE passes), {mmr_sql('kept')}
    SELECT user_id, rank, item, {rd('score', 'score')} FROM picks""",
)
def recommend_new_users(spark, d):
    """The whole pipeline for users without any rating."""
    return recommend(importance(spark, d), None, items(spark, d), MAPPING).select("user_id", "rank", "item", r6("score"))


@query(
    "recommend_fixed_confidence",
    f"""{HYBRID}, {open_pairs()}, {relax_sql()}, kept AS (SELECT * FROM relaxed WHERE passes AND score IS NOT NULL),
    {mmr_sql('kept')} SELECT user_id, rank, item, {rd('score', 'score')} FROM picks""",
)
def recommend_fixed_confidence(spark, d):
    """The whole pipeline on rated users, with a confidence SQL can compute as well."""
    z_items, rated = with_z(spark, d), stored_ratings(spark, d)
    return recommend(
        None, rated, z_items, MAPPING, profiles=fixed_profiles(spark, d, z_items, rated)
    ).select("user_id", "rank", "item", r6("score"))


_LEARNED_PICKS = f"""{HYBRID_LEARNED}, {open_pairs()}, {relax_sql()}, kept AS (SELECT * FROM relaxed WHERE passes AND score IS NOT NULL),
    {mmr_sql('kept')}"""


@query("recommend", f"{_LEARNED_PICKS} SELECT user_id, rank, item, {rd('score', 'score')} FROM picks")
def recommend_all(spark, d):
    return recommend(importance(spark, d), stored_ratings(spark, d), items(spark, d), MAPPING).select(
        "user_id", "rank", "item", r6("score")
    )


@query(
    "recommend_content_only",
    f"""{_CONTENT}, unrated AS (SELECT * FROM content c WHERE NOT EXISTS
    (SELECT 1 FROM ratings r WHERE r.user_id = c.user_id AND r.item = c.item)) """
    + TOP5.format(score=rd("score", "score"), source="unrated"),
)
def recommend_content_only(spark, d):
    """Every switchable part off: stated weights, no similarity, no constraints, no diversity."""
    off = Settings(use_similarity=False, use_constraints=False, use_mmr=False, min_learned_confidence=2.0)
    return recommend(importance(spark, d), stored_ratings(spark, d), items(spark, d), MAPPING, off).select(
        "user_id", "rank", "item", r6("score")
    )


_CAPPED = treated_sql("items")


@query(
    "recommend_preprocessed",
    f"""{BASE}, {_CAPPED}, content AS (SELECT user_id, item, {CONTENT_SQL} AS score FROM stated, treated), unrated AS (SELECT * FROM content c WHERE NOT EXISTS
    (SELECT 1 FROM ratings r WHERE r.user_id = c.user_id AND r.item = c.item)) """
    + TOP5.format(score=rd("score", "score"), source="unrated"),
)
def recommend_preprocessed(spark, d):
    """Content recommendations over the validated and capped table."""
    only_content = Settings(use_similarity=False, use_constraints=False, use_mmr=False, min_learned_confidence=2.0)
    capped = catalog_items(items(spark, d), "item", only_content, spec={f: ColumnSpec("numeric") for f in FEATURES}, rules={})
    return recommend(importance(spark, d), stored_ratings(spark, d), capped, MAPPING, only_content).select(
        "user_id", "rank", "item", r6("score")
    )


_HELD = "(user_id * 31 + item) % 5 = 0"


@query(
    "evaluate_content",
    f"""{_CONTENT}, test AS (SELECT * FROM ratings WHERE {_HELD}), train AS (SELECT * FROM ratings WHERE NOT {_HELD}),
    err AS (SELECT avg(abs(rating - greatest(1.0, least(5.0, score / 0.2)))) AS mae FROM test JOIN content USING (user_id, item)),
    fresh AS (SELECT c.* FROM content c LEFT JOIN train t ON t.user_id = c.user_id AND t.item = c.item WHERE t.item IS NULL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM fresh) WHERE rank <= 5),
    lik AS (SELECT user_id, item FROM test WHERE rating >= 3.5),
    hits AS (SELECT l.user_id, count(t.item) AS hits FROM lik l LEFT JOIN top t ON t.user_id = l.user_id AND t.item = l.item GROUP BY l.user_id)
    SELECT 'mae' AS metric, {rd('mae', 'value')} FROM err UNION ALL SELECT 'precision_at_5', {rd('avg(hits / 5.0)', 'value')} FROM hits""",
)
def evaluate_content(spark, d):
    """Held-out error and precision of the content score read as stars."""
    every = ratings(spark, d)
    train, test = evaluation.split(every, (F.col("user_id") * 31 + F.col("item")) % 5 == 0)
    users = scoring.content_users(stated_profiles(spark, d), FEATURES)
    rows = test.select("user_id", "item").join(users, "user_id").join(scoring.pack_items(items(spark, d), FEATURES), "item")
    score = scoring.content_score(FEATURES)
    stars = rows.select("user_id", "item", X.clip(score / F.lit(0.2), 1, 5).alias("stars"))
    mae = evaluation.mean_absolute_error(stars, test)
    top = scoring.content_ranking(stated_profiles(spark, d), train, items(spark, d), FEATURES, 5)
    precision = evaluation.precision_at(top, test, 5)
    return mae.select(F.lit("mae").alias("metric"), r6("mae", "value")).unionByName(
        precision.select(F.lit("precision_at_5").alias("metric"), r6("precision", "value"))
    )


_GUESS = f"CASE WHEN learned_{FEATURES[0]} IS NULL THEN 3.0 ELSE greatest(1.0, least(5.0, {plus(f'learned_{f} * {f}' for f in FEATURES)} / 0.2)) END"


@query(
    "evaluate",
    on_train(
        f"""{_LEARNED_PICKS}, test AS (SELECT * FROM every_rating WHERE {_HELD}),
    err AS (SELECT avg(abs(rating - {_GUESS})) AS mae FROM test JOIN blended USING (user_id) JOIN items USING (item)),
    lik AS (SELECT user_id, item FROM test WHERE rating >= 3.5),
    hits AS (SELECT l.user_id, count(t.item) AS hits FROM lik l LEFT JOIN picks t ON t.user_id = l.user_id AND t.item = l.item GROUP BY l.user_id)
    SELECT 'mae' AS metric, {rd('mae', 'value')} FROM err UNION ALL SELECT 'precision_at_5', {rd('avg(hits / 5.0)', 'value')} FROM hits""",
        f"({_HELD})",
    ),
)
def evaluate(spark, d):
    held = (F.col("user_id") * 31 + F.col("item")) % 5 == 0
    return evaluation.evaluate(importance(spark, d), stored_ratings(spark, d), items(spark, d), MAPPING, 5, held)
