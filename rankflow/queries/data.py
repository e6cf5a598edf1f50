"""Items, users, importances and ratings drawn from the star-schema tables, in Spark and in SQL.

Items are suppliers with nine indicators from their line items; users are customers; a rating is
1-5 stars from the average quantity a customer orders from a supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.operators.impute import fill_every_gap
from rankflow.operators.profile import NOISE
from rankflow.operators.scale import winsor_scale
from rankflow.session import store

MAPPING = {
    "Balance": ["balance_rate"],
    "Deals": ["discount_rate"],
    "Low tax": ["tax_rate"],
    "Volume": ["quantity_rate"],
    "Revenue": ["revenue_rate"],
    "Activity": ["orders_rate"],
    "Price level": ["price_rate"],
    "Service": ["returns_rate", "open_rate"],
}
FEATURES = [f for fs in MAPPING.values() for f in fs]
LOWER = ["tax_rate", "returns_rate"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c, name: str | None = None):
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name or c) if isinstance(c, str) else out.alias(name) if name else out


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")

    def six(column, name):
        return F.round(column, 6).alias(name)

    per_supplier = lines.groupBy(F.col("l_suppkey").alias("item")).agg(
        six(F.avg("l_discount"), "discount_rate"),
        six(F.avg("l_tax"), "tax_rate"),
        six(F.avg("l_quantity"), "quantity_rate"),
        six(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "revenue_rate"),
        F.count(F.lit(1)).cast("double").alias("orders_rate"),
        six(F.avg("l_extendedprice"), "price_rate"),
        six(F.avg((F.col("l_returnflag") == "R").cast("double")), "returns_rate"),
        six(F.avg((F.col("l_linestatus") == "O").cast("double")), "open_rate"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("balance_rate")
    )
    return suppliers.join(per_supplier, "item", "left").select("item", *FEATURES)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled to [0, 1], high is good, complete; stored, because every step after it reads it."""
    full = store(fill_every_gap(store(raw_items(spark, folder), "raw-items"), FEATURES), "filled-items")
    scaled = winsor_scale(full, FEATURES, lower_is_better=LOWER)
    return store(scaled.select("item", *[F.round(f, 9).alias(f) for f in FEATURES]), "items")


def importance(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    stated = [
        F.struct(
            F.lit(c).alias("category"),
            ((F.col("user_id") * 7 + i * 13) % 101).cast("double").alias("importance"),
            F.lit(i).alias("ord"),
        )
        for i, c in enumerate(MAPPING)
    ]
    rows = users.select("user_id", F.explode(F.array(*stated)).alias("e")).select("user_id", "e.*")
    return rows.where((F.col("user_id") + F.col("ord")) % 5 != 0)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("item")).agg(
        (F.lit(1.0) + F.least(F.lit(4.0), F.floor(F.avg("l_quantity") / 10).cast("double"))).alias("rating")
    )


def stored_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings for queries that read them more than once: lines and orders are joined once."""
    return store(ratings(spark, folder), "ratings")


def fixed_confidence(user="user_id"):
    """Stands in for the learned confidence where a query has to be expressible in SQL."""
    return (F.col(user) % 10) / F.lit(10.0)


# ---- the same in SQL -------------------------------------------------------------------


def plus(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def cos(left, right) -> str:
    def length(v):
        return "sqrt" + plus(f"{x}*{x}" for x in v)

    return f"coalesce({plus(f'{a}*{b}' for a, b in zip(left, right))} / nullif({length(left)} * {length(right)}, 0), 0)"


def each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(f=f) for f in FEATURES)


def clip_sql(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END)"


def rd(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def treated_sql(source: str, name: str = "treated") -> str:
    """`name`: features of `source` (`item`, features), a column with an IQR outlier clipped to its 5th-95th percentiles."""
    q = "q_{f}[2] - 1.5 * (q_{f}[3] - q_{f}[2])", "q_{f}[3] + 1.5 * (q_{f}[3] - q_{f}[2])"
    return f"""fence AS (SELECT {each('quantile_cont({f}, [0.05, 0.25, 0.75, 0.95]) AS q_{f}')} FROM {source}),
beyond AS (SELECT {each('bool_or({f} < ' + q[0] + ' OR {f} > ' + q[1] + ') AS h_{f}')} FROM {source}, fence),
{name} AS (SELECT item, {each('CASE WHEN h_{f} THEN greatest(q_{f}[1], least(q_{f}[4], {f})) ELSE {f} END AS {f}')} FROM {source}, fence, beyond)"""


def _scaled(f: str) -> str:
    low, high = f"b.{f}_lo", f"b.{f}_hi"
    moved = f"greatest(0.0, least(1.0, (greatest({low}, least({high}, x.{f})) - {low}) / nullif({high} - {low}, 0)))"
    unit = f"CASE WHEN {low} = {high} THEN 0.5 ELSE {moved} END"
    return f"round({'1 - ' + unit if f in LOWER else unit}, 9) AS {f}"


def _share() -> str:
    rows = [f"('{c}', '{f}', {len(fs)}, {i})" for c, fs in MAPPING.items() for i, f in enumerate(fs)]
    return f"(VALUES {', '.join(rows)}) m(category, feature, n_features, place)"


CATEGORIES_SQL = "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(MAPPING)) + ") c(category, ord)"

RAW_SQL = """raw AS (
  SELECT s.s_suppkey AS item, s.s_acctbal AS balance_rate, round(avg(l_discount), 6) AS discount_rate,
    round(avg(l_tax), 6) AS tax_rate, round(avg(l_quantity), 6) AS quantity_rate,
    round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue_rate, nullif(count(l_suppkey), 0)::DOUBLE AS orders_rate,
    round(avg(l_extendedprice), 6) AS price_rate,
    round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag IS NOT NULL THEN 0.0 END), 6) AS returns_rate,
    round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 WHEN l_linestatus IS NOT NULL THEN 0.0 END), 6) AS open_rate
  FROM supplier s LEFT JOIN lineitem l ON s.s_suppkey = l.l_suppkey GROUP BY ALL)"""

BASE = f"""WITH {RAW_SQL},
filled AS (SELECT item, {each('coalesce({f}, (SELECT median({f}) FROM raw)) AS {f}')} FROM raw),
bounds AS (SELECT {each('quantile_cont({f}, 0.01) AS {f}_lo, quantile_cont({f}, 0.99) AS {f}_hi')} FROM filled),
items AS (SELECT x.item, {', '.join(_scaled(f) for f in FEATURES)} FROM filled x, bounds b),
moments AS (SELECT {each('avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s')} FROM items),
itemz AS (SELECT i.*, {each('coalesce(({f} - {f}_m) / nullif({f}_s, 0), 0) AS z_{f}')} FROM items i, moments),
importance AS (
  SELECT c_custkey AS user_id, category, ((c_custkey * 7 + ord * 13) % 101)::DOUBLE AS importance, ord
  FROM customer, {CATEGORIES_SQL} WHERE (c_custkey + ord) % 5 <> 0),
shares AS (
  SELECT user_id, feature, category, importance, ord, place,
    CASE WHEN importance <= 0 THEN 0.0 WHEN importance >= 100 THEN 1.0 ELSE pow(importance / 100.0, 1.5) END
      / n_features AS share
  FROM importance JOIN {_share()} USING (category)),
named AS (
  SELECT user_id, {each("sum(CASE WHEN feature = '{f}' THEN share END) AS w_{f}")},
    {each("max(CASE WHEN feature = '{f}' AND importance >= 80 THEN category END) AS hard_{f}")},
    {each("min(CASE WHEN feature = '{f}' AND importance >= 80 THEN ord * 1000 + place END) AS place_{f}")}
  FROM shares GROUP BY user_id),
totals AS (
  SELECT *, {plus(f'coalesce(w_{f}, 0)' for f in FEATURES)} AS tot,
    {plus(f'(w_{f} IS NOT NULL)::INT' for f in FEATURES)} AS cnt FROM named),
stated AS (
  SELECT user_id, {each('CASE WHEN w_{f} IS NOT NULL THEN CASE WHEN tot = 0 THEN 1.0 / cnt ELSE w_{f} / tot END END AS weight_{f}')},
    {each('hard_{f}, place_{f}')} FROM totals),
ratings AS (
  SELECT o_custkey AS user_id, l_suppkey AS item, 1.0::DOUBLE + least(4.0, floor(avg(l_quantity) / 10))::DOUBLE AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
means AS (
  SELECT user_id, count(*) AS n_given, count(*) FILTER (rating * 0.2 >= 0.6) AS n_liked,
    {each('avg(z_{f}) FILTER (rating * 0.2 >= 0.6) AS m_{f}')}
  FROM ratings JOIN itemz USING (item) GROUP BY user_id),
given AS (SELECT user_id, n_given, n_liked, {each('CASE WHEN abs(m_{f}) < 1e-9 THEN 0.0 ELSE m_{f} END AS p_{f}')} FROM means)"""

CONTENT_SQL = (
    "coalesce("
    + plus(f"CASE WHEN weight_{f} > 0 AND {f} IS NOT NULL THEN weight_{f} * {clip_sql(f)} ELSE 0 END" for f in FEATURES)
    + " / nullif("
    + plus(f"CASE WHEN weight_{f} > 0 AND {f} IS NOT NULL THEN weight_{f} ELSE 0 END" for f in FEATURES)
    + ", 0), 0)"
)
Z = [f"z_{f}" for f in FEATURES]
P = [f"p_{f}" for f in FEATURES]

# Hybrid scores of every pair, with the fixed confidence and the stated weights.
HYBRID = f"""{BASE},
profiles AS (
  SELECT s.*, coalesce(n_given, 0) AS n_given, coalesce(n_liked, 0) AS n_liked, {each('g.p_{f}')},
    (s.user_id % 10) / 10.0::DOUBLE AS confidence FROM stated s LEFT JOIN given g USING (user_id)),
parts AS (
  SELECT user_id, item, confidence, n_given, {each('i.{f}')}, {each('hard_{f}, place_{f}')},
    (n_given >= 1 AND confidence >= 0.3 AND n_liked > 0) AS blend, {CONTENT_SQL} AS content_score,
    CASE WHEN n_given >= 1 AND confidence >= 0.3 AND n_liked > 0 THEN greatest(0.0, least(1.0, {cos(Z, P)})) END
      AS similarity_score
  FROM profiles, itemz i),
spread AS (
  SELECT *, var_pop(content_score) OVER (PARTITION BY user_id) AS vc,
    var_pop(similarity_score) OVER (PARTITION BY user_id) AS vs FROM parts),
base AS (
  SELECT *, CASE WHEN confidence > 0.7 THEN 0.6 ELSE 0.5 END::DOUBLE AS c0,
    CASE WHEN confidence < 0.4 THEN 0.7 ELSE 0.5 END::DOUBLE * least(1.0, n_given / 10.0) AS s0 FROM spread),
shifted AS (
  SELECT *, CASE WHEN vc > 1.5 * vs THEN c0 + 0.1 ELSE c0 END AS c1,
    CASE WHEN NOT (vc > 1.5 * vs) AND vs > 1.5 * vc THEN s0 + 0.1 ELSE s0 END AS s1 FROM base),
hybrid AS (
  SELECT *, CASE WHEN blend THEN c1 / (c1 + s1) ELSE 1.0 END AS content_weight,
    CASE WHEN blend THEN s1 / (c1 + s1) ELSE 0.0 END AS similarity_weight,
    CASE WHEN blend THEN c1 / (c1 + s1) * content_score + s1 / (c1 + s1) * coalesce(similarity_score, 0)
      ELSE content_score END AS score FROM shifted)"""



def _ridge_steps(size: int, alpha: float) -> list[dict[str, str]]:
    """Ridge regression on standardized features as rounds of plain column arithmetic, for SQL without arrays.

    The first round reads `n`, `sy`, `syy`, `sx<i>`, `sxx<i>_<j>` (i <= j) and `sxy<i>`; each later
    one reads what the ones before named (a name given again replaces the old value). The last
    gives `r2` and the normalized weights `w<i>`. The system is symmetric and positive definite, so
    elimination needs no pivots: one round per eliminated row, one per solved coefficient.
    """
    if alpha <= 0:
        raise ValueError("elimination without pivots needs a positive ridge penalty")
    ids = range(size)
    upper = [(i, j) for i in ids for j in ids if i <= j]
    at = lambda i, j: f"{min(i, j)}_{max(i, j)}"
    rounds = [
        {"c": "CASE WHEN n > 1 THEN n * 1e0 ELSE 1e0 END"},
        {"ym": "sy / c"} | {f"m{i}": f"sx{i} / c" for i in ids},
        {f"v{at(i, j)}": f"sxx{at(i, j)} / c - m{i} * m{j}" for i, j in upper} | {"tot": "syy - c * ym * ym"},
        {f"inv{i}": f"CASE WHEN v{at(i, i)} > 1e-12 THEN 1e0 / sqrt(v{at(i, i)}) ELSE 0e0 END" for i in ids}
        | {"tot": f"CASE WHEN tot > {NOISE!r} THEN tot ELSE 0e0 END"},
        {f"g{at(i, j)}": f"c * v{at(i, j)} * inv{i} * inv{j}" for i, j in upper}
        | {f"t{i}": f"CASE WHEN tot > 0 THEN (sxy{i} - c * m{i} * ym) * inv{i} ELSE 0e0 END" for i in ids},
        {f"a{at(i, j)}": f"g{at(i, j)} + {float(alpha)!r}e0" if i == j else f"g{at(i, j)}" for i, j in upper}
        | {f"b{i}": f"t{i}" for i in ids},
    ]
    for k in ids:
        rounds.append(
            {f"a{at(i, j)}": f"a{at(i, j)} - a{at(k, i)} * a{at(k, j)} / a{at(k, k)}" for i, j in upper if i > k}
            | {f"b{i}": f"b{i} - a{at(k, i)} * b{k} / a{at(k, k)}" for i in ids if i > k}
        )
    for k in reversed(ids):
        known = "".join(f" - a{at(k, j)} * x{j}" for j in ids if j > k)
        rounds.append({f"x{k}": f"(b{k}{known}) / a{at(k, k)}"})
    fit = plus(f"{'' if i == j else '2e0 * '}g{at(i, j)} * x{i} * x{j}" for i, j in upper)
    rounds.append(
        {"res": f"tot - 2e0 * {plus(f'x{i} * t{i}' for i in ids)} + {fit}", "size": plus(f"abs(x{i})" for i in ids)}
    )
    rounds.append(
        {"r2": "1e0 - res / (tot + 1e-10)"}
        | {f"w{i}": f"CASE WHEN size > 0 THEN abs(x{i}) / size ELSE {1.0 / size!r}e0 END" for i in ids}
    )
    return [r for r in rounds if r]


def _learned() -> str:
    """`learned` and `blended`: weights learned by the same rounds of elimination, and their blend with the stated ones."""
    size, ids = len(FEATURES), range(len(FEATURES))
    sums = ["count(*) AS n", "sum(y) AS sy", "sum(y * y) AS syy"]
    sums += [f"sum({f}) AS sx{i}" for i, f in enumerate(FEATURES)] + [f"sum({f} * y) AS sxy{i}" for i, f in enumerate(FEATURES)]
    sums += [f"sum({FEATURES[i]} * {FEATURES[j]}) AS sxx{i}_{j}" for i in ids for j in ids if i <= j]
    names, steps = {c.split(" AS ")[1] for c in sums} | {"user_id", "n_given"}, []
    for k, step in enumerate(_ridge_steps(size, Settings().ridge_alpha)):
        again = [c for c in step if c in names]
        without = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        steps.append(f"e{k + 1} AS (SELECT {without}, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM e{k})")
        names |= set(step)
    mix = {f: f"share * coalesce(learned_{f}, 0) + (1 - share) * coalesce(weight_{f}, 0)" for f in FEATURES}
    return f"""
seen AS (SELECT user_id, rating * 0.2 AS y, {each('{f}')} FROM ratings JOIN itemz USING (item)),
e0 AS (SELECT user_id, n_given, {', '.join(sums)} FROM seen JOIN (SELECT user_id, count(*) AS n_given FROM ratings GROUP BY user_id) USING (user_id)
  GROUP BY user_id, n_given),
{", ".join(steps)},
learned AS (SELECT user_id, n_given, {', '.join(f'CASE WHEN n_given >= 3 THEN w{i} END AS learned_{f}' for i, f in enumerate(FEATURES))},
  CASE WHEN n_given >= 3 THEN 0.7 * greatest(0.0, r2) + 0.3 * least(1.0, n_given / 10.0) ELSE 0.0 END AS confidence FROM e{len(steps)}),
shared AS (SELECT s.*, {each('learned_{f}')}, coalesce(confidence, 0.0) AS confidence, coalesce(n_given, 0) AS n_given,
  least(0.8, coalesce(confidence, 0.0) * 0.8)::DOUBLE AS share,
  coalesce(learned_{FEATURES[0]} IS NOT NULL AND confidence >= 0.1, false) AS used FROM stated s LEFT JOIN learned USING (user_id)),
mixed AS (SELECT *, {', '.join(f'{e} AS mix_{f}' for f, e in mix.items())} FROM shared),
blended AS (SELECT user_id, n_given, confidence, {each('hard_{f}, place_{f}, learned_{f}, weight_{f} AS stated_{f}')},
  {each('CASE WHEN used THEN CASE WHEN mix_{f} > 0 THEN mix_{f} / ' + plus(f'mix_{f}' for f in FEATURES) + ' END ELSE weight_{f} END AS weight_{f}')}
  FROM mixed)"""


LEARNED = f"{BASE},{_learned()}"
# Hybrid scores with learned weights and confidence.
HYBRID_LEARNED = f"""{LEARNED},
profiles AS (
  SELECT b.* EXCLUDE (n_given), b.n_given, coalesce(n_liked, 0) AS n_liked, {each('g.p_{f}')} FROM blended b LEFT JOIN given g USING (user_id)),
{HYBRID[HYBRID.index("parts AS ("):]}"""


def on_train(sql: str, held: str) -> str:
    """The same SQL where every table but `every_rating` sees only ratings that are not held out."""
    sql = sql.replace("\nratings AS (", "\nevery_rating AS (", 1)
    return sql.replace("),\nmeans AS (", f"),\nratings AS (SELECT * FROM every_rating WHERE NOT {held}),\nmeans AS (", 1)


POOLED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS category, {f} AS value FROM items" for c, fs in MAPPING.items() for f in fs
)


def _threshold(f: str) -> str:
    category = next(c for c, fs in MAPPING.items() if f in fs)
    return f"CASE WHEN hard_{f} IS NOT NULL THEN (SELECT threshold FROM thresholds WHERE category = '{category}') END AS t_{f}"


PASSES = " AND ".join(f"(t_{f} IS NULL OR coalesce({f} >= t_{f}, false))" for f in FEATURES)


def open_pairs(source: str = "hybrid") -> str:
    """`open`: pairs with thresholds, `score` NULL on rated items."""
    return f"""thresholds AS (
  SELECT category, quantile_cont(value, 0.75) AS threshold FROM ({POOLED_SQL}) GROUP BY category),
open AS (
  SELECT h.user_id, h.item, {each('h.{f}')}, {each('h.place_{f}')}, {', '.join(_threshold(f) for f in FEATURES)},
    CASE WHEN r.item IS NULL THEN h.score END AS score
  FROM {source} h LEFT JOIN ratings r ON h.user_id = r.user_id AND h.item = r.item)"""


def relax_sql(rounds: int = 3) -> str:
    required = plus(f"(t_{f} IS NOT NULL)::INT" for f in FEATURES)
    out = f"""cut AS (SELECT *, quantile_cont(score, 0.75) OVER (PARTITION BY user_id) AS cutoff FROM open),
x0 AS (SELECT *, coalesce(score >= cutoff, false) AS is_top, {required} > 0 AS required, 0 AS level, '' AS relaxed FROM cut)"""
    for k in range(1, rounds + 1):
        choices = ", ".join(
            f"CASE WHEN t_{f} IS NOT NULL THEN {{'w': CASE WHEN cutoff IS NOT NULL THEN i_{f}::DOUBLE ELSE t_{f} END,"
            f" 'p': -place_{f}, 'f': '{f}'}} END"
            for f in FEATURES
        )
        out += f""",
n{k} AS MATERIALIZED (SELECT *, count(*) FILTER ({PASSES}) OVER (PARTITION BY user_id) AS n,
  {each('count(*) FILTER (is_top AND coalesce({f} < t_{f}, false)) OVER (PARTITION BY user_id) AS i_{f}')} FROM x{k - 1}),
c{k} AS (SELECT *, CASE WHEN required AND n < 3 THEN list_max(list_filter([{choices}], lambda e: e IS NOT NULL)).f END AS loose
  FROM n{k}),
x{k} AS MATERIALIZED (SELECT user_id, item, score, {each('{f}')}, {each('place_{f}')}, is_top, cutoff, required,
  {', '.join(f"CASE WHEN coalesce(loose = '{f}', false) THEN t_{f} * {0.9 ** k!r}::DOUBLE ELSE t_{f} END AS t_{f}" for f in FEATURES)},
  CASE WHEN loose IS NOT NULL THEN {k} ELSE level END AS level,
  CASE WHEN loose IS NOT NULL THEN relaxed || ',' || loose ELSE relaxed END AS relaxed FROM c{k})"""
    return out + f",\nrelaxed AS (SELECT *, ({PASSES}) AS passes FROM x{rounds})"


def mmr_sql(source: str, n: int = 5, lam: float = 0.7) -> str:
    """`picks`: user_id, rank, item, score, z_<f>; `source` has user_id, item, score and the features."""
    out = f"""m0 AS MATERIALIZED (SELECT user_id, item, score,
  {each('coalesce(({f} - avg({f}) OVER (PARTITION BY user_id)) / nullif(stddev_pop({f}) OVER (PARTITION BY user_id), 0), 0) AS z_{f}')},
  count(*) OVER (PARTITION BY user_id) AS cnt,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS by_score,
  NULL::INT AS rnk, NULL::DOUBLE AS near FROM {source})"""
    keep = ", ".join(f"m.{c}" for c in ["user_id", "item", "score", *Z, "cnt", "by_score"])
    for k in range(1, n + 1):
        out += f""",
p{k} AS MATERIALIZED (SELECT * FROM (SELECT user_id, item, {', '.join(Z)}, row_number() OVER (PARTITION BY user_id
  ORDER BY {lam} * score - {1 - lam!r}::DOUBLE * coalesce(near, 0) DESC, item) AS rn
  FROM m{k - 1} WHERE rnk IS NULL AND cnt > {n}) WHERE rn = 1),
m{k} AS MATERIALIZED (SELECT {keep}, CASE WHEN p.item = m.item THEN {k} ELSE m.rnk END AS rnk,
  greatest(m.near, {cos([f'm.{z}' for z in Z], [f'p.{z}' for z in Z])}) AS near
  FROM m{k - 1} m LEFT JOIN p{k} p ON m.user_id = p.user_id)"""
    return out + f""",
ranked AS (SELECT *, CASE WHEN cnt > {n} THEN rnk ELSE by_score END AS rank FROM m{n}),
picks AS (SELECT user_id, rank, item, score, {', '.join(Z)} FROM ranked WHERE rank <= {n})"""
