"""Profiles, quality checks, imputation, scaling and outliers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.operators import impute, profiling, quality, scale
from rankflow.plans.preprocess import preprocess, process_features
from rankflow.queries.data import RAW_SQL, each, r6, raw_items, rd, table, treated_sql
from rankflow.session import store

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPY = ["v7", "v2", "v3"]


def events(spark, d):
    """Event values with gaps in three of the imputation tiers."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", "ts", "event_type",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v7"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v2"),
        F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("v3"),
    )


EVENTS = """WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS v7,
  CASE WHEN event_id % 4 <> 0 THEN value END AS v2, CASE WHEN event_id % 2 <> 0 THEN value END AS v3 FROM events)"""


def union(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query(
    "missing_profile",
    EVENTS
    + union(
        """ SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) / count(*)::DOUBLE, 6) + 0.0 AS missing_rate, count({c}) AS non_null_count,
        CASE WHEN (count(*) - count({c})) / count(*)::DOUBLE <= 0.1 THEN 'median_imputation'
        WHEN (count(*) - count({c})) / count(*)::DOUBLE <= 0.4 THEN 'regional_or_global_median'
        ELSE 'leave_null_and_flag' END AS strategy FROM e""",
        GAPPY,
    ),
)
def missing_profile(spark, d):
    return profiling.missing_profile(events(spark, d), GAPPY).withColumn("missing_rate", r6("missing_rate"))


def _numeric_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {rd(f'min({c})', 'min')}, {rd(f'max({c})', 'max')}, {rd(f'avg({c})', 'mean')},
    {rd('max(q[2])', 'median')}, {rd(f'stddev_samp({c})', 'std')}, {rd('max(q[1])', 'q25')}, {rd('max(q[3])', 'q75')},
    count(*) FILTER ({c} < q[1] - 1.5 * (q[3] - q[1])) AS outliers_lower,
    count(*) FILTER ({c} > q[3] + 1.5 * (q[3] - q[1])) AS outliers_upper,
    count(*) FILTER ({c} < 0) AS negative_values, count(*) FILTER ({c} = 0) AS zero_values
    FROM lineitem, (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM lineitem)"""


@query("numeric_profile", " UNION ALL ".join(_numeric_sql(c) for c in LINE))
def numeric_profile(spark, d):
    p = profiling.numeric_profile(table(spark, d, "lineitem"), LINE)
    numbers = ["min", "max", "mean", "median", "std", "q25", "q75"]
    return p.select(
        "column", *[r6(c) for c in numbers], "outliers_lower", "outliers_upper", "negative_values", "zero_values"
    )


@query(
    "quality_profile",
    EVENTS
    + union(
        """ SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round(100.0 * (count(*) - count({c})) / count(*), 6) + 0.0 AS missing_percentage,
        round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max, round(avg({c}), 6) + 0.0 AS mean,
        round(stddev_samp({c}), 6) + 0.0 AS std, 100.0 * (count(*) - count({c})) / count(*) > 50 AS mostly_missing,
        count(*) FILTER ({c} < q[1] - 3 * (q[2] - q[1]) OR {c} > q[2] + 3 * (q[2] - q[1])) > 0.1 * count({c}) AS many_extremes
        FROM e, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM e)""",
        GAPPY,
    ),
)
def quality_profile(spark, d):
    p = profiling.quality_profile(events(spark, d), GAPPY)
    return p.select(
        "column", "missing_count", r6("missing_percentage"), r6("min"), r6("max"), r6("mean"), r6("std"),
        "mostly_missing", "many_extremes",
    )


@query(
    "duplicate_values",
    "SELECT text AS value, count(*) AS occurrences FROM documents GROUP BY text HAVING count(*) > 1",
)
def duplicate_values(spark, d):
    return profiling.duplicates(table(spark, d, "documents"), "text")


@query(
    "duplicate_count",
    """SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows, count(*) AS duplicated_values
    FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)""",
)
def duplicate_count(spark, d):
    return profiling.duplicate_count(table(spark, d, "documents"), "text")


def _filled(column: str, value: str) -> str:
    return f"round(coalesce({column}, (SELECT {value} FROM e)), 6) + 0.0 AS {column}"


@query("impute_mean", EVENTS + "SELECT event_id, " + ", ".join(_filled(c, f"avg({c})") for c in GAPPY) + " FROM e")
def impute_mean(spark, d):
    out = impute.impute(events(spark, d), GAPPY, "mean")
    return out.select("event_id", *[r6(c) for c in GAPPY])


@query("impute_median", EVENTS + "SELECT event_id, " + ", ".join(_filled(c, f"median({c})") for c in GAPPY) + " FROM e")
def impute_median(spark, d):
    out = impute.impute(events(spark, d), GAPPY, "median")
    return out.select("event_id", *[r6(c) for c in GAPPY])


@query(
    "impute_most_frequent",
    EVENTS
    + "SELECT event_id, "
    + ", ".join(
        f"coalesce({c}, (SELECT {c} FROM e WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
        for c in GAPPY
    )
    + " FROM e",
)
def impute_most_frequent(spark, d):
    return impute.impute(events(spark, d), GAPPY, "most_frequent").select("event_id", *GAPPY)


@query(
    "forward_fill",
    EVENTS
    + "SELECT event_id, "
    + ", ".join(
        f"""round(coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
        (SELECT median({c}) FROM e)), 6) + 0.0 AS {c}"""
        for c in GAPPY
    )
    + " FROM e",
)
def forward_fill(spark, d):
    out = impute.impute(events(spark, d), GAPPY, "forward_fill", order=["ts", "event_id"])
    return out.select("event_id", *[r6(c) for c in GAPPY])


@query(
    "fill_every_gap",
    EVENTS
    + "SELECT event_id, "
    + ", ".join(_filled(c, f"median({c})") for c in GAPPY)
    + ", 0.0::DOUBLE AS tourism_none, 0.5::DOUBLE AS other_none FROM e",
)
def fill_every_gap(spark, d):
    """Two columns without any value fall back to the fixed defaults."""
    none = {"tourism_none": F.lit(None).cast("double"), "other_none": F.lit(None).cast("double")}
    out = impute.fill_every_gap(events(spark, d).withColumns(none), [*GAPPY, *none])
    return out.select("event_id", *[r6(c) for c in GAPPY], *none)


SMALL = ["balance_rate", "discount_rate", "quantity_rate"]


def gappy_items(spark, d):
    """Suppliers with some indicators taken away."""
    raw = store(raw_items(spark, d), "raw-items")
    return raw.select(
        "item",
        *[F.when((F.col("item") + i) % 5 != 0, F.col(c)).alias(c) for i, c in enumerate(SMALL)],
    )


_PAIR = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in SMALL)
_SQUARES = " + ".join(f"coalesce(pow(a.{c} - b.{c}, 2), 0)" for c in SMALL)


@query(
    "impute_knn",
    f"WITH {RAW_SQL}, g AS (SELECT item, "
    + ", ".join(f"CASE WHEN (item + {i}) % 5 <> 0 THEN {c} END AS {c}" for i, c in enumerate(SMALL))
    + f""" FROM raw), near AS (SELECT a.item, b.item AS other, sqrt(3.0 * ({_SQUARES}) / nullif({_PAIR}, 0)) AS dist,
    {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in SMALL)} FROM g a JOIN g b ON a.item <> b.item),
    """
    + ", ".join(
        f"""f_{c} AS (SELECT item, avg(b_{c}) AS v FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY dist, other) AS r
        FROM near WHERE a_{c} IS NULL AND b_{c} IS NOT NULL AND dist IS NOT NULL) WHERE r <= 5 GROUP BY item)"""
        for c in SMALL
    )
    + " SELECT item, "
    + ", ".join(f"round(coalesce(g.{c}, f_{c}.v, (SELECT avg({c}) FROM g)), 6) + 0.0 AS {c}" for c in SMALL)
    + " FROM g "
    + " ".join(f"LEFT JOIN f_{c} USING (item)" for c in SMALL),
)
def impute_knn(spark, d):
    out = impute.impute(gappy_items(spark, d), SMALL, "knn", key="item")
    return out.select("item", *[r6(c) for c in SMALL])


def _winsor(c: str, inverted: bool) -> str:
    x = f"greatest(0.0, least(1.0, (greatest(q_{c}[1], least(q_{c}[2], {c})) - q_{c}[1]) / nullif(q_{c}[2] - q_{c}[1], 0)))"
    unit = f"CASE WHEN q_{c}[1] = q_{c}[2] THEN 0.5 ELSE {x} END"
    return f"round({'1 - ' + unit if inverted else unit}, 6) + 0.0 AS {c}"


@query(
    "winsor_scale",
    "WITH q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS q_{c}" for c in LINE)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(_winsor(c, c == "l_tax") for c in LINE)
    + " FROM lineitem, q",
)
def winsor_scale(spark, d):
    out = scale.winsor_scale(table(spark, d, "lineitem"), LINE, lower_is_better=["tax"])
    return out.select("l_orderkey", "l_linenumber", *[r6(c) for c in LINE])


@query(
    "winsor_report",
    union(
        """SELECT '{c}' AS "column", round(max(q[1]), 6) + 0.0 AS winsor_lower_bound, round(max(q[2]), 6) + 0.0 AS winsor_upper_bound,
        count(*) FILTER ({c} < q[1]) AS values_clipped_lower, count(*) FILTER ({c} > q[2]) AS values_clipped_upper,
        round(avg({c}), 6) + 0.0 AS original_mean, round(avg((greatest(q[1], least(q[2], {c})) - q[1]) / (q[2] - q[1])), 6) + 0.0
        AS final_mean FROM lineitem, (SELECT quantile_cont({c}, [0.01, 0.99]) AS q FROM lineitem)""",
        LINE,
    ),
)
def winsor_report(spark, d):
    r = scale.winsor_report(table(spark, d, "lineitem"), LINE, lower_is_better=[])
    return r.select(
        "column", r6("winsor_lower_bound"), r6("winsor_upper_bound"), "values_clipped_lower", "values_clipped_upper",
        r6("original_mean"), r6("final_mean"),
    )


_SCALERS = {
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "standard": ("avg({c})", "stddev_pop({c})"),
    "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def _scaler_query(method: str):
    def run(spark, d):
        out = scale.scale(table(spark, d, "lineitem"), LINE, method)
        return out.select("l_orderkey", "l_linenumber", *[r6(c) for c in LINE])

    run.__doc__ = f"Line item numbers under the {method} scaler."
    return run


for _method, (_center, _spread) in _SCALERS.items():
    query(
        f"scale_{_method}",
        "WITH s AS (SELECT "
        + ", ".join(f"{_center.format(c=c)} AS m_{c}, {_spread.format(c=c)} AS s_{c}" for c in LINE)
        + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in LINE)
        + " FROM lineitem, s",
    )(_scaler_query(_method))


@query(
    "transform_new_rows",
    """WITH f AS (SELECT median(value) AS m, min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'click')
    SELECT event_id, round((coalesce(CASE WHEN event_id % 4 <> 0 THEN value END, m) - lo) / (hi - lo), 6) + 0.0 AS v2 FROM events, f""",
)
def transform_new_rows(spark, d):
    """Fitted on clicks, applied to every event: the fitted numbers are a one-row table."""
    clicks = table(spark, d, "events").where("event_type = 'click'").select(F.col("value").alias("v2"))
    fill, fitted = impute.medians(clicks, ["v2"]), scale.fit_scaler(clicks, ["v2"], "minmax")
    out = scale.apply_scaler(impute.fill_with(events(spark, d), fill, ["v2"]), fitted, ["v2"])
    return out.select("event_id", r6("v2"))


_IQR = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s FROM events)"


@query(
    "flag_outliers",
    f"""SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS by_iqr,
    abs((value - m) / s) > 3 AS by_zscore FROM events, {_IQR}""",
)
def flag_outliers(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    by_iqr = scale.flag_outliers(e, ["value"], "iqr").withColumnRenamed("value_outlier", "by_iqr")
    both = scale.flag_outliers(by_iqr, ["value"], "zscore").withColumnRenamed("value_outlier", "by_zscore")
    return both.select("event_id", "by_iqr", "by_zscore")


@query(
    "outlier_report",
    union(
        """SELECT '{c}' AS "column", count(*) FILTER ({c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) AS outliers,
        round(100.0 * count(*) FILTER ({c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) / count(*), 6) + 0.0
        AS percentage FROM lineitem, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem)""",
        LINE,
    ),
)
def outlier_report(spark, d):
    return scale.outlier_report(table(spark, d, "lineitem"), LINE).withColumn("percentage", r6("percentage"))


def _treated(t: str, c: str, key: str) -> str:
    return f"""SELECT {key}, round(CASE WHEN (SELECT count(*) FROM {t} WHERE {c} < q[2] - 1.5 * (q[3] - q[2]) OR {c} > q[3] + 1.5 * (q[3] - q[2])) > 0
    THEN greatest(q[1], least(q[4], {c})) ELSE {c} END, 6) + 0.0 AS {c} FROM {t}, (SELECT quantile_cont({c}, [0.05, 0.25, 0.75, 0.95]) AS q FROM {t})"""


@query("treat_outliers", _treated("events", "value", "event_id"))
def treat_outliers(spark, d):
    out = scale.treat_outliers(table(spark, d, "events").select("event_id", "value"), ["value"])
    return out.select("event_id", r6("value"))


@query(
    "variance_selection",
    union("""SELECT '{c}' AS "column", round(var_pop({c}), 6) + 0.0 AS variance, var_pop({c}) > 0.01 AS selected FROM lineitem""", LINE),
)
def variance_selection(spark, d):
    return scale.variance_report(table(spark, d, "lineitem"), LINE).withColumn("variance", r6("variance"))


@query(
    "feature_importance",
    union("""SELECT '{c}' AS "column", round(coalesce(abs(corr({c}, l_extendedprice)), 0), 6) + 0.0 AS importance FROM lineitem""", LINE),
)
def feature_importance(spark, d):
    out = scale.feature_importance(table(spark, d, "lineitem"), LINE, "l_extendedprice")
    return out.withColumn("importance", r6("importance"))


@query(
    "convert_types",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END = 'n/a' AS lost FROM events""",
)
def convert_types(spark, d):
    """Text columns that are mostly numbers become numbers; what does not parse becomes NULL."""
    e = table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"),
    )
    spec = {"k": quality.ColumnSpec("numeric"), "v": quality.ColumnSpec("numeric")}
    fixed = quality.fix_types(e, quality.type_check(e, spec).collect())
    return fixed.select("event_id", "k", F.col("v").isNull().alias("lost"))


RANGES = {"l_discount": (0.0, 0.05), "l_quantity": (1.0, 40.0)}
SPEC = {c: quality.ColumnSpec("numeric", low=lo, high=hi) for c, (lo, hi) in RANGES.items()}


@query(
    "range_check",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {rd(f'min({c})', 'actual_low')}, {rd(f'max({c})', 'actual_high')}, count({c}) AS checked,
        count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS violations FROM lineitem"""
        for c, (lo, hi) in RANGES.items()
    ),
)
def range_check(spark, d):
    return quality.range_check(table(spark, d, "lineitem"), SPEC).select(
        "column", r6("actual_low"), r6("actual_high"), "checked", "violations"
    )


@query(
    "range_fix",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {c})) AS {c}" for c, (lo, hi) in RANGES.items())
    + " FROM lineitem",
)
def range_fix(spark, d):
    return quality.fix_ranges(table(spark, d, "lineitem"), SPEC).select("l_orderkey", "l_linenumber", *RANGES)


JOINED = "(SELECT d.doc_id, quality, toxic, n_chars FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


@query(
    "consistency_check",
    union(
        f"""SELECT '{{c}}' AS "column", round(100.0 * (count(*) - count({{c}})) / count(*), 6) + 0.0 AS missing_percentage,
        100.0 * (count(*) - count({{c}})) / count(*) > 25 AS high_missing, count(DISTINCT {{c}}) AS distinct_values,
        CASE WHEN count({{c}}) = 0 THEN NULL WHEN count(DISTINCT {{c}}) = 1 AND count({{c}}) > 1 THEN 'zero variance'
        WHEN count(DISTINCT {{c}}) < 3 THEN 'very few unique values' END AS issue FROM {JOINED}""",
        ["quality", "toxic", "n_chars"],
    ),
)
def consistency_check(spark, d):
    return quality.consistency_check(labelled(spark, d), ["quality", "toxic", "n_chars"]).withColumn(
        "missing_percentage", r6("missing_percentage")
    )


@query(
    "business_rules",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS c, count(*) AS n FROM lineitem),
    j AS (SELECT ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT) / 3.0 AS s FROM """
    + JOINED
    + """) SELECT 'price_grows' AS rule, c > 0.1 AS passed, round(c, 6) + 0.0 AS measure, n AS samples FROM r
    UNION ALL SELECT 'price_falls', c < -0.1, round(c, 6) + 0.0, n FROM r
    UNION ALL SELECT 'coverage', avg(s) >= 0.5 AND min(s) >= 0.2, round(avg(s), 6) + 0.0, count(*) FROM j""",
)
def business_rules(spark, d):
    lines = quality.run_rules(
        table(spark, d, "lineitem"),
        {
            "price_grows": quality.correlation_rule("l_quantity", "l_extendedprice", sign=1),
            "price_falls": quality.correlation_rule("l_quantity", "l_extendedprice", sign=-1),
        },
    )
    docs = quality.run_rules(labelled(spark, d), {"coverage": quality.completeness_rule(["quality", "toxic", "n_chars"])})
    return lines.unionByName(docs).select("rule", "passed", r6("measure"), "samples")


@query(
    "inconsistent_rows",
    """SELECT l_orderkey * 10 + l_linenumber AS id, 'both high' AS issue FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.05
    UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'all features have identical values' FROM lineitem
    WHERE l_discount = l_tax AND l_tax = l_quantity AND l_quantity = l_extendedprice""",
)
def inconsistent_rows(spark, d):
    rows = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return quality.inconsistent_rows(rows, "id", LINE, ("l_discount", "l_tax"), 0.05)


@query(
    "feature_quality",
    union(
        """SELECT '{c}' AS "column", round(0.5 * count({c}) / count(*) + 0.3 * least(var_samp({c}) / 0.5, 1.0)
        + 0.2 * (max({c}) - min({c})), 6) + 0.0 AS score, round(var_samp({c}), 6) + 0.0 AS variance FROM lineitem""",
        ["l_discount", "l_tax"],
    ),
)
def feature_quality(spark, d):
    q = quality.feature_quality(table(spark, d, "lineitem"), ["l_discount", "l_tax"], scale=1.0)
    return q.select("column", r6("score"), r6("variance"))


@query(
    "process_features",
    f"""WITH g AS (SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN value END, (SELECT median(value) FROM events WHERE event_id % 4 <> 0))
    AS value FROM events), t AS ({_treated('g', 'value', 'event_id').replace('round(', '(').replace(', 6) + 0.0 AS value', ') AS value')})
    SELECT event_id, round((value - (SELECT min(value) FROM t)) / (SELECT max(value) - min(value) FROM t), 6) + 0.0 AS v2 FROM t""",
)
def process_events(spark, d):
    """Median fill -> outlier cap -> min-max scaling."""
    out = process_features(store(events(spark, d), "events"), "event_id", ["v2"], scaling="minmax")
    return out.select("event_id", r6("v2"))


@query(
    "preprocess",
    f"""WITH {RAW_SQL}, filled AS (SELECT item, {each('coalesce({f}, (SELECT median({f}) FROM raw)) AS {f}')} FROM raw),
    {treated_sql('filled')} SELECT item::VARCHAR AS item, {each('round({f}, 4) + 0.0 AS {f}')} FROM treated""",
)
def preprocess_items(spark, d):
    """Validation with fixes and feature processing of the raw supplier indicators."""
    raw = store(raw_items(spark, d), "raw-items")
    names = [c for c in raw.columns if c != "item"]
    spec = {"item": quality.ColumnSpec("string", required=True, unique=True)} | {
        c: quality.ColumnSpec("numeric") for c in names
    }
    data = preprocess(raw, "item", spec, {"complete": quality.completeness_rule(names)}).data
    return data.select(F.col("item").cast("string").alias("item"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in names])
