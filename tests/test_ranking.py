import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.functions import cells as cells_module
from rankflow.functions.blocks import meet_rows, place, rated_cells
from rankflow.operators import constrain, diversify, profile, scoring
from rankflow.operators.constrain import pack_thresholds, pack_values, relax, thresholds_of
from rankflow.plans.recommend import recommend

MAPPING = {"A": ["a_rate"], "B": ["b_rate", "c_rate"]}
FEATURES = ["a_rate", "b_rate", "c_rate"]


def catalog(spark, n=30, seed=1):
    x = np.random.default_rng(seed).random((n, 3))
    rows = [(f"i{k:03d}", *map(float, r)) for k, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "item string, a_rate double, b_rate double, c_rate double")


def test_ridge_from_sums_equals_direct_fit(spark):
    x, items = catalog(spark)
    stars = [5.0, 1.0, 4.0, 3.0, 2.0, 5.0]
    rows = [("u", f"i{k:03d}", s) for k, s in enumerate(stars)] + [("u", "unknown", 4.0), ("u", "i009", 0.0), ("v", "i001", 4.0)]
    ratings = spark.createDataFrame(rows, "user_id string, item string, rating double")
    half = ratings.where("item < 'i003'"), ratings.where("item >= 'i003'")
    whole = profile.rating_sums(ratings, items, FEATURES)
    added = profile.add_sums(*[profile.rating_sums(h, items, FEATURES) for h in half], FEATURES)
    xs = x[: len(stars)]
    xs = (xs - xs.mean(0)) / xs.std(0)
    y = np.array(stars) * 0.2
    w = np.linalg.solve(xs.T @ xs + np.eye(3), xs.T @ (y - y.mean()))
    r2 = 1 - ((y - y.mean() - xs @ w) ** 2).sum() / (((y - y.mean()) ** 2).sum() + 1e-10)
    want = np.abs(w) / np.abs(w).sum()
    for sums in (whole, added):
        got = {r.user_id: r for r in profile.learned_weights(sums, FEATURES).collect()}
        assert np.allclose([got["u"][f"learned_{f}"] for f in FEATURES], want)
        assert np.isclose(got["u"].confidence, 0.7 * max(0, r2) + 0.3 * 7 / 10)
        assert got["v"].confidence == 0 and got["v"].learned_a_rate is None


def test_edge_users(spark):
    _, items = catalog(spark)
    importance = spark.createDataFrame(
        [("zero", "A", 0.0, 0), ("zero", "B", 0.0, 1), ("odd", "Nope", 90.0, 0), ("one", "A", 70.0, 0)],
        "user_id string, category string, importance double, ord int",
    )
    got = {r.user_id: r for r in profile.stated_weights(importance, MAPPING).collect()}
    assert [round(got["zero"][f"stated_{f}"], 6) for f in FEATURES] == [0.333333] * 3
    assert "odd" not in got and got["one"].stated_a_rate == 1 and got["one"].stated_b_rate is None
    every = spark.createDataFrame([("one", f"i{k:03d}", 3.0) for k in range(30)], "user_id string, item string, rating double")
    out = recommend(importance, every, items, MAPPING).toPandas()
    assert set(out.user_id) == {"zero"} and sorted(out["rank"]) == [1, 2, 3, 4, 5]


def test_mmr_with_and_without_candidate_table(spark):
    x, items = catalog(spark, 40)
    score = x @ np.array([0.5, 0.3, 0.2])
    z = (x - x.mean(0)) / x.std(0)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    picked = []
    for _ in range(5):
        near = (u @ u[picked].T).max(1) if picked else np.zeros(len(x))
        worth = 0.7 * score - 0.3 * near
        worth[picked] = -9
        picked.append(int(worth.argmax()))
    want = [f"i{k:03d}" for k in picked]
    pairs = items.select(F.lit("u").alias("user_id"), "*", (F.col("a_rate") * 0.5 + F.col("b_rate") * 0.3 + F.col("c_rate") * 0.2).alias("score"))
    table = diversify.mmr(pairs, FEATURES).toPandas().sort_values("rank")
    assert table.item.tolist() == want
    users = spark.createDataFrame([("u", 0.5, 0.3, 0.2)], "user_id string, weight_a_rate double, weight_b_rate double, weight_c_rate double")
    state = place(scoring.content_users(users, FEATURES))
    packed = scoring.pack_items(items, FEATURES).select("item", "_i")
    direct = diversify.mmr_over_catalog(state, packed, FEATURES, scoring.content_sql(FEATURES), "true").toPandas()
    assert direct.sort_values("rank").item.tolist() == want
    plain = diversify.mmr(pairs, FEATURES, Settings(diversity_lambda=1.0)).toPandas().sort_values("rank")
    assert plain.item.tolist() == [f"i{k:03d}" for k in np.argsort(-score)[:5]]
    few = diversify.mmr_over_catalog(state, packed, FEATURES, scoring.content_sql(FEATURES), "item < 'i003'").toPandas()
    assert sorted(few.item) == ["i000", "i001", "i002"]


def test_top_pairs_equals_full_sort(spark):
    x, items = catalog(spark, 200)
    users = spark.createDataFrame([(i, i / 7, 0.3, 1 - i / 7) for i in range(7)], "user_id int, weight_a_rate double, weight_b_rate double, weight_c_rate double")
    full = scoring.top_items(scoring.content_scores(users, items, FEATURES), 4)
    packed = scoring.pack_items(items, FEATURES).select("item", "_i")
    short = scoring.top_pairs(place(scoring.content_users(users, FEATURES)), packed, scoring.content_sql(FEATURES), 4, groups=8)
    order = ["user_id", "rank", "item"]
    assert full.select(order).orderBy(order).collect() == short.select(order).orderBy(order).collect()


def test_pairs_meet_by_an_equi_join(spark):
    _, items = catalog(spark)
    users = spark.createDataFrame([(1, 0.1, 0.2, 0.7)], "user_id int, weight_a_rate double, weight_b_rate double, weight_c_rate double")
    plan = scoring.content_scores(users, items, FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_copies_of_the_catalog_are_not_broadcast(spark):
    """The planner does not count the copies a catalog is sent in, so it would collect them all."""
    _, items = catalog(spark)
    users = spark.createDataFrame([(1, 0.1, 0.2, 0.7)], "user_id int, weight_a_rate double, weight_b_rate double, weight_c_rate double")
    plan = scoring.content_scores(users, items, FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


def test_relaxation_loosens_the_costliest_requirement(spark):
    x, items = catalog(spark, 40, seed=4)
    users = spark.createDataFrame(
        [("u", 0.2, 0.4, 0.4, None, 0.97, 0.97, None, 1000, 1001)],
        "user_id string, weight_a_rate double, weight_b_rate double, weight_c_rate double, t_a_rate double,"
        " t_b_rate double, t_c_rate double, place_a_rate int, place_b_rate int, place_c_rate int",
    )
    t = {1: 0.97, 2: 0.97}
    score = x @ np.array([0.2, 0.4, 0.4])
    top = score >= np.percentile(score, 75)
    level, loosened = 0, []
    while sum((x[:, 1] >= t[1]) & (x[:, 2] >= t[2])) < 3 and level < 3:
        level += 1
        f = max((1, 2), key=lambda i: (sum(top & (x[:, i] < t[i])), -i))
        t[f] *= 0.9**level
        loosened.append(FEATURES[f])
    for polarity, sign in (("high_is_good", 1),):
        s = Settings(polarity=polarity)
        cat = pack_values(scoring.catalog_of(items, FEATURES), FEATURES, s)
        packed = pack_thresholds(users, FEATURES, s).select(
            "user_id", scoring.pack_weights([*FEATURES]), "_t", "_place", F.array().cast("array<string>").alias("_rated")
        )
        fields = {f"w{i}": f"_u.w{i}" for i in range(3)} | {f"q{i}": "0D" for i in range(3)} | {"wc": "1D", "ws": "0D"}
        state = place(packed.withColumn("_u", scoring._packed("_u", fields)))
        got = thresholds_of(relax(state, cat, FEATURES, s), FEATURES, s).first()
        assert got.relaxed == loosened and got.relaxation_level == level
        assert np.isclose(got.t_b_rate, t[1]) and np.isclose(got.t_c_rate, t[2]) and got.t_a_rate is None


@pytest.mark.parametrize("kept", [1, 4])
def test_certified_picks_equal_a_full_search(spark, monkeypatch, kept):
    """Floors so high that most users have to go past the catalog again."""
    monkeypatch.setattr(diversify, "KEPT", kept)
    monkeypatch.setattr(diversify, "SAMPLE", 30)
    x, items = catalog(spark, 150, seed=8)
    weights = np.random.default_rng(3).random((12, 3))
    names = "user_id int, weight_a_rate double, weight_b_rate double, weight_c_rate double"
    users = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weights)], names)
    packed = scoring.pack_items(items, FEATURES).select("item", "_i")
    got = diversify.mmr_over_catalog(
        place(scoring.content_users(users, FEATURES)), packed, FEATURES, scoring.content_sql(FEATURES), "item < 'i100' OR user_id % 2 = 0"
    ).toPandas().sort_values(["user_id", "rank"])
    for i, w in enumerate(weights):
        mine = x if i % 2 == 0 else x[:100]
        score = mine @ w / w.sum()
        z = (mine - mine.mean(0)) / mine.std(0)
        u, picked = z / np.linalg.norm(z, axis=1, keepdims=True), []
        for _ in range(5):
            worth = 0.7 * score - 0.3 * ((u @ u[picked].T).max(1) if picked else 0)
            worth[picked] = -9
            picked.append(int(worth.argmax()))
        assert got[got.user_id == i].item.tolist() == [f"i{k:03d}" for k in picked]


def test_recommendations_without_ratings_and_with_integer_keys(spark):
    x, items = catalog(spark)
    numbered = items.selectExpr("int(substring(item, 2, 3)) AS item", *FEATURES)
    importance = spark.createDataFrame([(7, "A", 60.0, 0), (8, "B", 70.0, 0)], "user_id long, category string, importance double, ord int")
    got = recommend(importance, None, numbered, MAPPING, Settings(use_mmr=False), n=3).toPandas().sort_values(["user_id", "rank"])
    assert got[got.user_id == 7].item.tolist() == np.argsort(-x[:, 0])[:3].tolist()
    assert got[got.user_id == 8].item.tolist() == np.argsort(-(x[:, 1] + x[:, 2]))[:3].tolist()


def test_equal_ratings_teach_nothing(spark):
    _, items = catalog(spark)
    rows = [("u", f"i{k:03d}", 3.0) for k in range(7)]
    sums = profile.rating_sums(spark.createDataFrame(rows, "user_id string, item string, rating double"), items, FEATURES)
    got = profile.learned_weights(sums, FEATURES).first()
    assert [got[f"learned_{f}"] for f in FEATURES] == [1 / 3] * 3 and np.isclose(got.confidence, 0.7 + 0.21)


def test_learning_needs_no_python(spark):
    _, items = catalog(spark)
    ratings = spark.createDataFrame([("u", "i001", 3.0)], "user_id string, item string, rating double")
    plan = profile.learned_weights(profile.rating_sums(ratings, items, FEATURES), FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sums_are_kept_per_placed_user(spark):
    """One shuffle by user in front of the sums, none behind: no task holds sums of users it does not own."""
    _, items = catalog(spark)
    rows = [(f"u{i % 7}", f"i{i % 30:03d}", 1.0 + i % 5) for i in range(100)] + [(None, "i001", 3.0), ("u1", "nowhere", 2.0)]
    sums = profile.rating_sums(spark.createDataFrame(rows, "user_id string, item string, rating double"), items, FEATURES)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "REPARTITION_BY_NUM" in plan
    assert plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM") and "ENSURE_REQUIREMENTS" not in plan[: plan.index("REPARTITION_BY_NUM")]
    got = {r.user_id: (r.n_given, r.n) for r in sums.collect()}
    assert got["u1"] == (16, 15) and got[None] == (1, 1) and len(got) == 8


def uneven(spark, users=9, items=60):
    """Items with equal rows, missing values and a repeated key; users with ratings, thresholds and shares."""
    rng = np.random.default_rng(5)
    rows = [(k, *[None if v < 0.1 else round(float(v), 1) for v in rng.random(3)]) for k in range(items)]
    rows += [(3, 0.9, 0.9, 0.9), (None, 0.8, 0.8, 0.8), *[(100 + k, *rows[k][1:]) for k in range(10)]]
    table = spark.createDataFrame(rows, "item long, a_rate double, b_rate double, c_rate double")
    weights = [(i, *map(float, rng.random(3))) for i in range(users)] + [(None, 0.1, 0.2, 0.3), (77, 0.0, 0.0, 0.0)]
    state = spark.createDataFrame(weights, "user_id long, weight_a_rate double, weight_b_rate double, weight_c_rate double")
    state = state.selectExpr(
        "*", *[f"IF(user_id % 3 = 0, double(NULL), round(weight_{f} - 0.5, 1)) AS proto_{f}" for f in FEATURES],
        "0.6D AS content_weight", "IF(user_id % 3 = 0, 0D, 0.4D) AS similarity_weight",
        *[f"IF(user_id % 4 = {i}, 0.5D, NULL) AS t_{f}" for i, f in enumerate(FEATURES)], *[f"1 AS place_{f}" for f in FEATURES],
    )
    state = pack_thresholds(state.withColumn("_u", scoring.pack_weights(FEATURES, True)), FEATURES).select("user_id", "_u", "_t", "_place")
    ratings = spark.createDataFrame([(u, int(i)) for u in range(users) for i in rng.integers(0, 110, 12)], "user_id long, item long")
    return place(state), pack_values(scoring.catalog_of(table, FEATURES), FEATURES), rated_cells(state, ratings)


@pytest.mark.parametrize("block", [16384, 20])
def test_cells_rank_like_sql(spark, monkeypatch, block):
    """Whole cells give the rows that SQL gives, and no row for a pair is made."""
    monkeypatch.setattr(cells_module, "ITEMS", block)
    users, items, cells = uneven(spark)
    wanted = f"{scoring.UNRATED} AND {scoring.passes_sql(FEATURES)}"
    for score in (scoring.score_sql(FEATURES), scoring.content_sql(FEATURES)):
        got = scoring.top_pairs(users, items, score, 4, wanted, cells=cells)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
        pairs = meet_rows(users, items, "item", cells).where(wanted).selectExpr("user_id", "item", f"{score} AS score")
        want = scoring.top_items(pairs, 4).select("user_id", "rank", "score").orderBy("user_id", "rank").collect()
        assert got.select("user_id", "rank", "score").orderBy("user_id", "rank").collect() == want
        same = ["user_id", "rank", "item"]
        once = scoring.top_items(pairs.where("item <> 3"), 4).orderBy(same).select(same).collect()
        again = scoring.top_pairs(users, items.where("item <> 3"), score, 4, wanted, cells=cells).orderBy(same).select(same).collect()
        assert once == again


@pytest.mark.parametrize("block", [16384, 20])
def test_spread_in_cells_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(cells_module, "ITEMS", block)
    users, items, _ = uneven(spark)
    parts = scoring.variances(users, items, ["content", "cosine", "hybrid"], ["vc", "vs", "v"])
    assert "FlatMapCoGroupsInArrow" in parts._jdf.queryExecution().executedPlan().toString()
    sql = {"vc": scoring.content_sql(FEATURES), "vs": scoring.cosine_sql(FEATURES), "v": scoring.score_sql(FEATURES)}
    want = meet_rows(users.where("user_id IS NOT NULL"), items, "item").groupBy("user_id").agg(*[F.expr(f"var_pop({e}) AS {n}") for n, e in sql.items()])
    a, b = (d.toPandas().set_index("user_id").sort_index() for d in (parts, want))
    assert np.allclose(a[b.columns], b, atol=1e-12) and ((a == 0) == (b == 0)).all().all()


@pytest.mark.parametrize("block", [16384, 40])
def test_picks_in_cells_equal_those_of_sql(spark, monkeypatch, block):
    monkeypatch.setattr(cells_module, "ITEMS", block)
    monkeypatch.setattr(diversify, "KEPT", 2)
    monkeypatch.setattr(diversify, "SAMPLE", 30)
    users, items, cells = uneven(spark, items=120)
    items = items.where("item IS NOT NULL AND item <> 3")
    score, wanted = scoring.score_sql(FEATURES), f"{scoring.UNRATED} AND {scoring.passes_sql(FEATURES)}"
    got = diversify.mmr_over_catalog(users, items, FEATURES, score, wanted, cells=cells)
    want = diversify.mmr_over_catalog(users, items, FEATURES, score, f"({wanted})", cells=cells)
    a, b = (d.toPandas().sort_values(["user_id", "rank"]).reset_index(drop=True) for d in (got, want))
    assert a["item"].tolist() == b["item"].tolist() and np.allclose(a["score"], b["score"], atol=1e-12) and len(a) > 20


@pytest.mark.parametrize("block", [16384, 20, 4])
def test_impact_in_cells_equals_sql(spark, monkeypatch, block):
    """The exact percentile and what thresholds remove above it, without a row for a pair."""
    monkeypatch.setattr(cells_module, "ITEMS", block)
    users, items, cells = uneven(spark, items=90)
    score, low = scoring.score_sql(FEATURES), constrain.MISSING
    needed = users.where("user_id IS NOT NULL AND user_id % 4 < 3")
    pairs = meet_rows(needed, items, "item", cells).where(scoring.UNRATED).selectExpr("*", f"{score} AS score")
    cuts = pairs.groupBy("user_id").agg(F.expr("percentile(score, 0.75) AS _cut"))
    fails = [F.expr(f"count_if(score >= _cut AND _g.g{i} < _t.t{i} AND _g.g{i} <> {low})").alias(f) for i, f in enumerate(FEATURES)]
    want = {r.user_id: r for r in pairs.join(cuts, "user_id").groupBy("user_id").agg(F.max("_cut").alias("cut"), *fails).collect()}
    exact = {r.user_id: r["_cut"] for r in constrain._cutoffs(needed, items, cells).select("user_id", "_cut").collect()}
    assert exact.keys() == want.keys() and all(abs(exact[u] - r.cut) < 1e-15 for u, r in want.items())
    got = constrain.constraint_impact(users, items, FEATURES, cells)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.user_id, r.feature): r.impact for r in got.collect()}
    assert found and found == {(u, f): want[u][f] for u, f in found} and any(found.values())


def test_analysis_passes_the_catalog_once(spark):
    users, items, _ = uneven(spark)
    best = scoring.top_pairs(users, items, scoring.content_sql(FEATURES), 5).join(items.where("item > 3").select("item", *FEATURES), "item")
    out = diversify.diversity_analysis(best, FEATURES)
    assert "FlatMapCoGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.user_id for r in out.collect()} <= {*range(9), 77}


@pytest.mark.parametrize("wanted", [scoring.UNRATED, f"{scoring.UNRATED} AND (user_id % 2 = 0 OR item < 4)"])
def test_picks_equal_those_of_the_candidate_table(spark, monkeypatch, wanted):
    """Without a table of all pairs: repeated items, users with few candidates, directions and scores of the picks."""
    monkeypatch.setattr(diversify, "LEADERS", 1)
    users, items, cells = uneven(spark, items=120)
    users = place(users.where("user_id IS NOT NULL"))
    for catalog in (items.where("item IS NOT NULL"), items):
        given = diversify.Candidates(users, catalog, scoring.score_sql(FEATURES), wanted, cells)
        got = diversify.mmr(given, FEATURES)
        want = diversify.mmr(given.rows(FEATURES), FEATURES)
        assert got.columns == want.columns
        a, b = (sorted(map(tuple, d.collect())) for d in (got, want))
        assert len(a) == len(b) > 20 and [r[:3] for r in a] == [r[:3] for r in b]
        assert np.allclose([r[3:] for r in a], [r[3:] for r in b], atol=1e-9)


def test_too_few_different_items_end_the_search(spark, monkeypatch):
    """Copies of three items: no floor brings a fourth."""
    monkeypatch.setattr(diversify, "KEPT", 1)
    rows = [(k % 3, float(k % 3) / 2, 0.5, 1 - float(k % 3) / 4) for k in range(60)]
    items = spark.createDataFrame(rows, "item long, a_rate double, b_rate double, c_rate double")
    users = spark.createDataFrame([(1, 0.5, 0.3, 0.2)], "user_id long, weight_a_rate double, weight_b_rate double, weight_c_rate double")
    packed = scoring.pack_items(items, FEATURES)
    given = diversify.Candidates(place(scoring.content_users(users, FEATURES)), packed, scoring.content_sql(FEATURES), "true")
    got = diversify.mmr(given, FEATURES).groupBy("rank", "item").count().orderBy("rank").collect()
    want = diversify.mmr(given.rows(FEATURES), FEATURES).groupBy("rank", "item").count().orderBy("rank").collect()
    assert got == want and [r["count"] for r in got] == [20, 20, 20]


def test_passing_pairs_compare_items_once_a_set(spark):
    """The rows that SQL gives for every pair, repeated and missing keys too; users do not meet the catalog."""
    users, items, _ = uneven(spark)
    got = constrain.passing_pairs(users, items, FEATURES).select("user_id", "item")
    want = meet_rows(users, items, "item").where(scoring.passes_sql(FEATURES)).select("user_id", "item")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_passing" in plan and "Broadcast" not in plan
    assert plan.index("REPARTITION_BY_NUM") < plan.index("ENSURE_REQUIREMENTS")
    a, b = (sorted(map(str, d.collect())) for d in (got, want))
    assert a == b and len(a) > 200 and len({r.user_id for r in got.collect()}) > 5


def cell(tiny=1.0):
    """A block of items and a shard of users as they reach numpy."""
    rng = np.random.default_rng(2)
    packed = lambda **fields: pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    wide = lambda letter, rows: {f"{letter}{i}": rows[:, i] for i in range(rows.shape[1])}
    x, w = rng.random((300, 3)), rng.random((40, 3))
    w[:, 0] *= tiny
    known = (rng.random((300, 3)) < 0.9).astype(float)
    known[:5] = [1, 0, 0]
    u, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x - 0.5, rng.random((40, 3)) - 0.5))
    t = np.where(rng.random((40, 3)) < 0.4, 0.6, -np.inf)
    items = pa.table({
        "item": pa.array(range(300)), "_g": packed(**wide("g", x)),
        "_i": packed(**wide("c", x * known), **wide("k", known), **wide("x", x), **wide("u", u)),
    })
    users = pa.table({
        "user_id": pa.array(range(40)), "_t": packed(**wide("t", t)),
        "_u": packed(**wide("w", w), **wide("q", q), wc=np.full(40, 0.6), ws=np.full(40, 0.4)),
    })
    return x, t, cells_module.Users(users), cells_module.Items(items)


def test_only_items_past_the_thresholds_are_scored(monkeypatch):
    x, t, users, items = cell()
    pairs, product = [], cells_module.View.product
    monkeypatch.setattr(cells_module.View, "product", lambda *a: pairs.append(product(*a)) or pairs[-1])
    got = cells_module.best("plain", 300, False, True)(users, items)
    passing = sum(int((x >= row).all(1).sum()) for row in t)
    assert sum(p.size for p in pairs) == got.num_rows == passing < 0.5 * 40 * 300


@pytest.mark.parametrize("tiny", [1.0, 1e-42])
@pytest.mark.parametrize("kind", ["content", "plain", "hybrid"])
def test_short_floats_only_preselect(kind, tiny):
    """Rough scores are right but for the slack they come with; weights out of the range of short floats take long ones."""
    _, _, users, items = cell(tiny)
    float_, view, every = cells_module.real(users, items), cells_module.View(items), slice(0, 40)
    assert float_ is (np.float32 if tiny == 1 else np.float64)
    r, c = np.divmod(np.arange(40 * 300), 300)
    exact = cells_module.SCORES[kind][1](users, view, r, c).reshape(40, 300)
    rough, slack = cells_module.approximate(kind, users, view, every, float_)
    assert (np.abs(rough - exact) < slack[:, None]).all() and slack.max() < 1e-4
    order = np.lexsort((c, -exact.ravel(), r)).reshape(40, 300)[:, :7]
    got = cells_module.best(kind, 7, False, False)(users, items)
    assert got["item"].to_pylist() == (order % 300).ravel().tolist() and got["score"].to_pylist() == exact.ravel()[order].ravel().tolist()


def test_sums_less_what_is_rated():
    """Mean and spread of the unrated items, from sums over all; with one or two items left they are looked at one by one."""
    x, _, users, items = cell()
    users.t = None
    sets = [[], [3, 5], list(range(299)), list(range(2, 300)), list(range(300))] * 8
    users.rated = np.repeat(np.arange(40), [len(s) for s in sets]), pa.array([i for s in sets for i in s], pa.int64())
    got = cells_module.moments("plain", True, False)(users, items).to_pydict()
    left = [np.delete(x, s, 0) for s in sets]
    assert got["_n"] == [len(v) for v in left if len(v)]
    for i in range(3):
        assert np.allclose(got[f"_m{i}"], [v[:, i].mean() for v in left if len(v)], atol=1e-14, rtol=0)
        assert np.allclose(got[f"_s{i}"], [v[:, i].var() * len(v) for v in left if len(v)], atol=1e-13, rtol=1e-9)


@pytest.mark.parametrize("block", [16384, 40])
def test_picks_of_one_pass_equal_those_of_many(spark, monkeypatch, block):
    """A catalog that a cell can hold goes past the users once for all picks; a larger one as often as it takes."""
    monkeypatch.setattr(cells_module, "ITEMS", block)
    users, items, cells = uneven(spark, items=120)
    users, items = place(users.where("user_id IS NOT NULL")), items.where("item IS NOT NULL")
    given = diversify.Candidates(users, items, scoring.score_sql(FEATURES), scoring.UNRATED, cells)
    rows = {}
    for whole in (cells_module.WHOLE, 0):
        monkeypatch.setattr(cells_module, "WHOLE", whole)
        rows[whole] = sorted(tuple(r) for r in diversify.mmr(given, FEATURES).collect())
    one, many = rows.values()
    assert len(one) == len(many) > 20 and [r[:3] for r in one] == [r[:3] for r in many]
    assert np.allclose([r[3:] for r in one], [r[3:] for r in many], atol=1e-9)


def test_ratings_go_to_their_users_without_the_values_of_items(spark, monkeypatch):
    """The shuffle by user carries three numbers a rating; a catalog too large to be sent gives the same sums."""
    _, items = catalog(spark)
    items = items.selectExpr("*", *[f"{f} - 0.5D AS z_{f}" for f in FEATURES])
    rows = [(f"u{i % 7}", f"i{i % 30:03d}", 1.0 + i % 5) for i in range(100)] + [(None, "i001", 3.0), ("u1", "nowhere", 2.0), ("u2", None, 4.0)]
    ratings = spark.createDataFrame(rows, "user_id string, item string, rating double")
    found = []
    for sent in (profile.SENT, 0):
        monkeypatch.setattr(profile, "SENT", sent)
        sums = profile.rating_sums(ratings, items, FEATURES)
        plan = sums._jdf.queryExecution().executedPlan().toString()
        moved = plan.split("REPARTITION_BY_NUM")[1].split("\n")[1]
        assert ("a_rate" in moved) == (sent == 0)
        found.append(sums.orderBy("user_id").toPandas())
    one, other = found
    assert one.user_id.tolist() == other.user_id.tolist() and len(one) == 8
    for c in one.columns[1:]:
        assert np.allclose(np.array(one[c].tolist()), np.array(other[c].tolist()), atol=1e-12)


def test_evaluation_builds_profiles_once(spark, monkeypatch):
    from rankflow.plans import evaluate, recommend as plan

    _, items = catalog(spark)
    importance = spark.createDataFrame([("u", "A", 60.0, 0)], "user_id string, category string, importance double, ord int")
    ratings = spark.createDataFrame([("u", f"i{k:03d}", 1.0 + k % 5) for k in range(12)], "user_id string, item string, rating double")
    built = []
    for module in (evaluate, plan):
        monkeypatch.setattr(module, "build_profiles", lambda *a, f=module.build_profiles: built.append(1) or f(*a))
    got = {r.metric: r.value for r in evaluate.evaluate(importance, ratings, items, MAPPING, 3).collect()}
    assert set(got) == {"mae", "precision_at_3"} and len(built) == 1
