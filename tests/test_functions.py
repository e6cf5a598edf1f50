import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankflow.functions import expr as X
from rankflow.functions.ordered import forward_fill, with_sequential_id
from rankflow.functions.quantiles import quantiles
from rankflow.functions.text import token_set_ratio
from rankflow.operators import impute, scale
from rankflow.operators.match import close_names, resolve_names
from rankflow.operators.schema_rules import standard_name


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bracketed_quantiles_equal_the_builtin(spark, keys):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), [np.nan] * 50])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)) % 3, "v": values, "w": values[::-1] * 7}))
    df = df.select("k", X.no_nan(F.col("v")).alias("v"), X.no_nan(F.col("w")).alias("w"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    wanted = F.array(*map(F.lit, probs))
    small = df.groupBy(*keys).agg(*[F.percentile(c, wanted).alias(c) for c in ("v", "w")]).toPandas()
    large = quantiles(df, ["v", "w"], probs, keys, accuracy=100).toPandas()
    if keys:
        small, large = small.sort_values("k"), large.sort_values("k")
    for c in ("v", "w"):
        assert np.allclose(np.stack(small[c]), np.stack(large[c]), atol=1e-12)


def test_ids_and_fill_do_not_depend_on_slices(spark):
    rows = [(i, None if i % 3 or i < 5 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(7)
    ids = with_sequential_id(df, ["i"], "id", 5).toPandas()
    assert (ids.id == ids.i + 1).all()
    want = pd.DataFrame(rows, columns=["i", "v"]).astype({"v": float}).ffill()
    for n in (1, 6):
        got = forward_fill(df, ["i"], ["v"], n).toPandas().sort_values("i").reset_index(drop=True)
        assert np.allclose(got.v, want.v, equal_nan=True)


def test_clip_keeps_null_and_key_keeps_letters(spark):
    r = spark.range(1).select(
        X.clip(F.lit(None).cast("double"), 0, 1).alias("a"), X.match_key(F.lit(" Côte d'Ivoire ")).alias("b"),
        X.match_key(F.lit("Guinea-Bissau")).alias("c"),
    ).first()
    assert r.a is None and r.b == "côtedivoire" and r.c == "guineabissau"


def test_constant_column_scales_to_half_everywhere(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "i int, crime_index double")
    assert [r.crime_index for r in scale.winsor_scale(df, ["crime_index"]).collect()] == [0.5, 0.5, 0.5]


def test_outliers_cap_only_columns_that_have_some(spark):
    df = spark.createDataFrame([(float(i), 1000.0 if i == 49 else float(i)) for i in range(50)], "a double, b double")
    out = scale.treat_outliers(df, ["a", "b"]).toPandas()
    assert out.a.max() == 49 and out.b.max() < 1000 and out.b.min() > 0


def test_gaps_and_defaults(spark):
    df = spark.createDataFrame([(1.0, None, None), (3.0, None, None), (None, None, None)], "x double, natural_x double, y double")
    out = impute.require_complete(impute.fill_every_gap(df, df.columns), df.columns).toPandas()
    assert out.x.tolist() == [1.0, 3.0, 2.0] and set(out.natural_x) == {0.1} and set(out.y) == {0.5}


def test_knn_equals_brute_force_in_any_number_of_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    x[rng.random((40, 3)) < 0.25] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id int, a double, b double, c double")
    want = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        d = np.sqrt(np.where(both.sum(1) > 0, 3 / np.maximum(both.sum(1), 1) * np.nansum((x - x[i]) ** 2, axis=1), np.nan))
        donors = [k for k in range(40) if not np.isnan(x[k, j]) and not np.isnan(d[k])]
        near = sorted(donors, key=lambda k: (d[k], k))[:5]
        want[i, j] = x[near, j].mean() if near else np.nanmean(x[:, j])
    for blocks in (1, 4):
        got = impute.knn_impute(df, "id", ["a", "b", "c"], blocks=blocks).toPandas().sort_values("id")
        assert np.allclose(got[["a", "b", "c"]].to_numpy(), want)


def test_token_set_ratio():
    assert token_set_ratio("Guinea", "Papua New Guinea") == 100
    assert token_set_ratio("Korea, South", "south korea") == 100
    assert token_set_ratio("France", "Spain") < 60 and token_set_ratio("", "x") == 0


def test_segment_join_finds_every_close_pair(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(150)]
    left = spark.createDataFrame([(n,) for n in names[:75]], "name string").distinct()
    right = spark.createDataFrame([(n,) for n in names[75:]], "std_name string").distinct()
    for threshold in (60, 75, 90):
        got = {(r.name, r.std_name) for r in close_names(left, right, threshold).collect()}
        longest = F.greatest(F.length("name"), F.length("std_name"))
        near = 100.0 * (longest - F.levenshtein("name", "std_name")) / longest >= threshold
        assert got == {(r.name, r.std_name) for r in left.join(right, near).collect()}


def test_ambiguous_fuzzy_match_is_marked(spark):
    known = spark.createDataFrame([("Guinea Bissau",), ("Guinea Conakry",), ("Japan",)], "std_name string")
    asked = spark.createDataFrame([("Guinea",), ("JAPAN ",), ("Atlantis",)], "name string")
    got = {r.name: r for r in resolve_names(asked, known, "token_set", 90).collect()}
    assert got["Guinea"].ambiguous and got["Guinea"].method == "fuzzy"
    assert got["JAPAN"].std_name == "Japan" and got["Atlantis"].method == "rejected"


def test_column_names():
    assert standard_name("Crime Index") == "crime_index"
    assert standard_name("index") == "crime_index"
    assert standard_name("Value", "tourism_2020") == "tourism_arrivals"
    assert standard_name("value", "cultural_x") == "cultural_accessibility_score"
    assert standard_name("val", "natural_x") == "natural_spaces_index"
    assert standard_name("My-New Column") == "my_new_column"


@pytest.mark.parametrize("blocks", [1, 3])
def test_knn_in_cells_equals_sql(spark, blocks):
    """Ties, repeated and missing keys, values that are no numbers; no row or expression for a pair."""
    rng = np.random.default_rng(11)
    rows = [(k, *[None if v < 0.3 else round(float(v), 1) for v in rng.random(3)]) for k in range(80)]
    rows += [(5, 0.4, None, 0.4), (None, None, 0.5, 0.6), (7, None, None, 0.9), (8, None, 0.2, None), (90, float("nan"), 0.5, 0.5)]
    for some in (rows[:-1], rows):
        df = spark.createDataFrame(some, "id long, a double, b double, c double")
        got, want = (f(df, "id", ["a", "b", "c"], 5, blocks) for f in (impute._candidates_in_cells, impute._candidates))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(_rows" not in plan and "_rows" not in plan
        cut = lambda df: sorted(
            (str(r["_id"]), [[(str(e["d"]), e["k"], str(e["v"])) for e in r[c]] for c in "abc"])
            for r in df.select("_id", *[F.expr(f"slice(array_sort({c}), 1, 5) AS {c}") for c in "abc"]).where("size(a) + size(b) + size(c) > 0").collect()
        )
        assert cut(got) == cut(want) and len(cut(got)) > 40
