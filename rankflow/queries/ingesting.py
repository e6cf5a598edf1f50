"""Entity names, merging, the warehouse table, requests and whole cleaning runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.functions.expr import match_key
from rankflow.operators import match, merge
from rankflow.plans.ingest import ingest, ingest_report
from rankflow.queries.data import BASE, MAPPING, RAW_SQL, importance, r6, ratings, raw_items, table
from rankflow.session import new_folder, store
from rankflow.sources.buckets import read_buckets, upsert_buckets
from rankflow.sources import requests, warehouse
from rankflow.sources.csv_folder import open_folder, validate_folder

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# ---- names -----------------------------------------------------------------------------


def typed_names(spark, d):
    """Part names as a careless source would spell them; every part is one row."""
    key, name = F.col("p_partkey"), F.col("p_name")
    spelled = (
        F.when(key % 5 == 0, F.concat(F.lit("  "), F.upper(name)))
        .when(key % 5 == 1, F.regexp_replace(name, " ", "-"))
        .when(key % 5 == 2, F.concat(F.substring(name, 1, 3), F.lit("x"), F.substring(name, 4, 100)))
        .when(key % 5 == 3, F.concat(F.lit("zz "), F.reverse(name)))
        .otherwise(name)
    )
    return table(spark, d, "part").select(key.alias("id"), spelled.alias("name"))


def dictionary(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("std_name")).distinct()


NAMES = """WITH typed AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '  ' || upper(p_name)
    WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN substr(p_name, 1, 3) || 'x' || substr(p_name, 4)
    WHEN 3 THEN 'zz ' || reverse(p_name) ELSE p_name END AS name FROM part),
dict AS (SELECT DISTINCT p_name AS std_name FROM part),
keyed AS (SELECT min(std_name) AS std_name, regexp_replace(regexp_replace(lower(trim(std_name)), '[^\\w\\s]', '', 'g'), '\\s+', '', 'g') AS k FROM dict GROUP BY 2),
names AS (SELECT DISTINCT trim(name) AS name FROM typed WHERE trim(name) <> ''),
exact AS (SELECT name, std_name FROM (SELECT name, regexp_replace(regexp_replace(lower(trim(name)), '[^\\w\\s]', '', 'g'), '\\s+', '', 'g') AS k FROM names)
  LEFT JOIN keyed USING (k)),
scored AS (SELECT e.name, d.std_name, levenshtein(lower(e.name), lower(d.std_name)) AS edits,
  100.0 * (greatest(length(e.name), length(d.std_name)) - levenshtein(lower(e.name), lower(d.std_name)))
  / greatest(length(e.name), length(d.std_name)) AS score FROM exact e, dict d WHERE e.std_name IS NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, edits, std_name) AS rank FROM scored))"""
_RESOLVED = f"""{NAMES}, resolved AS (SELECT e.name, coalesce(e.std_name, b.std_name) AS std_name,
  CASE WHEN e.std_name IS NOT NULL THEN 'deterministic' WHEN b.std_name IS NOT NULL THEN 'fuzzy' ELSE 'rejected' END AS method
  FROM exact e LEFT JOIN (SELECT * FROM best WHERE rank = 1 AND score >= 80) b USING (name))"""


@query(
    "match_key",
    """SELECT s_suppkey, regexp_replace(regexp_replace(lower(trim(s_name)), '[^\\w\\s]', '', 'g'), '\\s+', '', 'g') AS key FROM supplier""",
)
def match_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", match_key(F.col("s_name")).alias("key"))


@query("exact_match", f"{NAMES} SELECT name, std_name FROM exact")
def exact_match(spark, d):
    return match.exact_matches(typed_names(spark, d), dictionary(spark, d))


@query("fuzzy_edit_match", f"{_RESOLVED} SELECT name, std_name, method FROM resolved")
def fuzzy_edit_match(spark, d):
    """Exact key, then every dictionary name within the threshold by the segment join."""
    out = match.resolve_names(typed_names(spark, d), dictionary(spark, d), "segments", 80)
    return out.select("name", "std_name", "method")


@query("close_names", f"{NAMES} SELECT name, std_name, edits, round(score, 6) + 0.0 AS score FROM scored WHERE score >= 80")
def close_names(spark, d):
    known = dictionary(spark, d)
    left = match.exact_matches(typed_names(spark, d), known).where("std_name IS NULL")
    return match.close_names(left, known, 80).select("name", "std_name", F.col("edits").cast("long").alias("edits"), r6("score"))


@query("name_suggestions", f"{NAMES} SELECT name, rank, std_name, round(score, 6) + 0.0 AS score FROM best WHERE rank <= 3")
def name_suggestions(spark, d):
    known = dictionary(spark, d)
    left = match.exact_matches(typed_names(spark, d), known).where("std_name IS NULL")
    return match.suggestions(left, known, "edit").select("name", "rank", "std_name", r6("score"))


@query("token_set_match")
def token_set_match(spark, d):
    return match.resolve_names(typed_names(spark, d), dictionary(spark, d), "token_set", 90)


@query(
    "match_report",
    f"""{_RESOLVED} SELECT count(*) AS total_names, count(*) FILTER (method = 'deterministic') AS deterministic_matches,
    count(*) FILTER (method = 'fuzzy') AS fuzzy_matches, count(*) FILTER (method = 'rejected') AS rejections,
    round(count(*) FILTER (method <> 'rejected') / count(*)::DOUBLE, 6) + 0.0 AS match_rate
    FROM typed t JOIN resolved r ON trim(t.name) = r.name""",
)
def match_report(spark, d):
    rows = typed_names(spark, d)
    resolved = match.resolve_names(rows, dictionary(spark, d), "segments", 80)
    return match.match_report(match.resolve_rows(rows, "name", resolved)).withColumn("match_rate", r6("match_rate"))


@query(
    "unknown_ids",
    f"""{_RESOLVED} SELECT id, t.name, format('UNKNOWN_{{:03d}}', row_number() OVER (ORDER BY id)) AS assigned_id
    FROM typed t JOIN resolved r ON trim(t.name) = r.name WHERE std_name IS NULL""",
)
def unknown_ids(spark, d):
    rows = typed_names(spark, d)
    resolved = match.resolve_names(rows, dictionary(spark, d), "segments", 80)
    return match.number_unknown(match.resolve_rows(rows, "name", resolved), ["id"]).select("id", "name", "assigned_id")


@query(
    "entity_dictionary",
    "SELECT DISTINCT trim(n) AS std_name FROM (SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region "
    "UNION ALL SELECT c_mktsegment FROM customer) WHERE trim(n) <> ''",
)
def entity_dictionary(spark, d):
    from rankflow.sources.csv_folder import entity_dictionary as distinct_names

    columns = [("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")]
    return distinct_names([table(spark, d, t).select(F.col(c).alias("country")) for t, c in columns])


# ---- merge -----------------------------------------------------------------------------


@query(
    "first_per_entity",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER
    (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 1""",
)
def first_per_entity(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    first = merge.first_per_entity(
        lines, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    )
    return first.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


def user_tables(spark, d):
    """Three tables with one row per user; each knows other users, two share a column name."""
    spend = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_totalprice").alias("top"), F.count(F.lit(1)).cast("double").alias("orders")
    )
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("top"))
    bad = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("errors")
    )
    return {"spend": spend, "seen": seen, "bad": bad}


_USERS = """WITH spend AS (SELECT o_custkey AS user_id, max(o_totalprice) AS top, count(*)::DOUBLE AS orders FROM orders GROUP BY 1),
seen AS (SELECT user_id, max(value) AS top_seen FROM events GROUP BY 1),
bad AS (SELECT user_id, count(*)::DOUBLE AS errors FROM events WHERE event_type = 'error' GROUP BY 1)"""


@query(
    "outer_merge",
    f"{_USERS} SELECT user_id, top, orders, top_seen, errors FROM spend FULL JOIN seen USING (user_id) FULL JOIN bad USING (user_id)",
)
def outer_merge(spark, d):
    return merge.outer_merge(user_tables(spark, d), "user_id")


@query(
    "merge_steps",
    f"""{_USERS}, s AS (SELECT user_id, min(step) AS step FROM (SELECT user_id, 0 AS step FROM spend UNION ALL
    SELECT user_id, 1 FROM seen UNION ALL SELECT user_id, 2 FROM bad) GROUP BY user_id),
    n AS (SELECT k AS step, name, (SELECT count(*) FROM s WHERE step = k) AS new_entities FROM (VALUES (0, 'spend'), (1, 'seen'), (2, 'bad')) v(k, name))
    SELECT step, name, new_entities, sum(new_entities) OVER (ORDER BY step)::BIGINT AS entities_after,
    (sum(new_entities) OVER (ORDER BY step) - new_entities)::BIGINT AS entities_before FROM n""",
)
def merge_steps(spark, d):
    return merge.merge_steps(user_tables(spark, d), "user_id")


@query(
    "number_entities",
    "SELECT c_name, row_number() OVER (ORDER BY c_name) AS country_id FROM customer",
)
def number_entities(spark, d):
    return merge.number_entities(table(spark, d, "customer").select("c_name"), "c_name")


# ---- warehouse -------------------------------------------------------------------------


@query(
    "integrity",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_records, count({c}) AS non_null_records, count(*) - count({c}) AS null_count,
        round(100.0 * count({c}) / count(*), 2) AS completeness_percentage FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"""
        for c in ("n_chars", "quality", "toxic")
    ),
)
def integrity(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return warehouse.integrity(both, ["n_chars", "quality", "toxic"])


@query(
    "insert_counts",
    """SELECT count(*) AS records_processed, count(quality) AS records_inserted, count(*) - count(quality) AS records_rejected
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def insert_counts(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return warehouse.insert_counts(both, ["n_chars", "quality", "toxic"])


@query(
    "upsert",
    """SELECT user_id, last_value, coalesce(n, 0) AS n FROM (
    SELECT c_custkey AS user_id, coalesce(v, c_acctbal) AS last_value, n FROM customer LEFT JOIN (
      SELECT user_id, arg_max(value, event_id) AS v, count(*) AS n FROM events GROUP BY user_id) e ON user_id = c_custkey
    UNION ALL SELECT user_id, arg_max(value, event_id), count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id)""",
)
def upsert(spark, d):
    """Events overwrite the stored value of their user, the latest event last."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("last_value"))
    new = table(spark, d, "events").select("user_id", F.col("value").alias("last_value"), F.col("event_id").alias("_seq"))
    n = new.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return warehouse.upsert(old, new, "user_id").join(n, "user_id", "left").fillna(0, ["n"])


@query(
    "log_summary",
    """SELECT event_type AS process_type, count(*) AS operation_count, sum(event_id)::BIGINT AS total_processed,
    sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS total_inserted, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END)::BIGINT AS total_rejected
    FROM events GROUP BY event_type""",
)
def log_summary(spark, d):
    """The event table read as a processing log."""
    log = table(spark, d, "events").select(
        F.col("event_type").alias("process_type"), F.col("event_id").alias("records_processed"),
        (F.col("value") > 10).cast("long").alias("records_inserted"),
        (F.col("value") <= 10).cast("long").alias("records_rejected"),
    )
    return warehouse.log_summary(log)


@query("item_list", "SELECT DISTINCT p_name FROM part")
def item_list(spark, d):
    return warehouse.item_list(table(spark, d, "part"), "p_name")


@query("export", "SELECT s_name, s_acctbal FROM supplier")
def export(spark, d):
    """Ordered export, written as CSV to the shared folder and returned."""
    return warehouse.export(table(spark, d, "supplier"), ["s_name", "s_acctbal"], "s_name", new_folder(spark, "export"))


# ---- requests --------------------------------------------------------------------------


def request_bodies(spark, d):
    """One JSON request per customer, written by Spark from importances and ratings."""
    weights = importance(spark, d).groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "importance")))).alias("weights")
    )
    stars = ratings(spark, d).groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item").cast("string"), "rating")))).alias("ratings")
    )
    both = weights.join(stars, "user_id", "left")
    return both.select("user_id", F.to_json(F.struct("ratings", "weights")).alias("body"))


KEYS = {c: c.upper() for c in list(MAPPING)[:6]}


@query(
    "request_importance",
    f"{BASE} SELECT user_id, upper(category) AS category, importance FROM importance WHERE category IN ("
    + ", ".join(f"'{c}'" for c in KEYS)
    + ")",
)
def request_importance(spark, d):
    parsed = requests.parse_requests(request_bodies(spark, d))
    return requests.request_importance(parsed, KEYS).select("user_id", "category", "importance")


@query("request_ratings", f"{BASE} SELECT user_id, item::VARCHAR AS item, rating FROM ratings")
def request_ratings(spark, d):
    return requests.request_ratings(requests.parse_requests(request_bodies(spark, d)))


@query("json_numbers", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_numbers(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- whole runs ------------------------------------------------------------------------

FILES = {
    "crime_rate": ("tax_rate", "crime_index"),
    "english": ("quantity_rate", "english_score"),
    "health": ("price_rate", "health care index"),
    "tourism": ("orders_rate", "tourism arrivals"),
}


def csv_folder(spark, d) -> str:
    """Supplier indicators as a folder of per-topic CSVs; every file lacks other suppliers and some cells."""
    folder, raw = new_folder(spark, "csv"), store(raw_items(spark, d), "raw-items")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_name").alias("country"))
    rows = store(raw.join(names, "item"), "named-items")
    for i, (stem, (column, header)) in enumerate(FILES.items()):
        one = rows.where((F.col("item") + i) % 9 != 0).select(
            "country", F.when((F.col("item") + i) % 12 != 0, F.col(column)).alias(header)
        )
        out = f"{folder}/{stem}"
        one.orderBy("country").coalesce(1).write.csv(out, header=True)
    return folder


def _file_values(i: int, column: str, inverted: bool) -> str:
    return f"""f{i} AS (SELECT country, CASE WHEN (item + {i}) % 12 <> 0 THEN {column} END AS v FROM named WHERE (item + {i}) % 9 <> 0),
    g{i} AS (SELECT country, coalesce(v, (SELECT median(v) FROM f{i})) AS v FROM f{i}),
    q{i} AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM g{i}),
    c{i} AS (SELECT country, CASE WHEN lo = hi THEN 0.5 ELSE {'1 - ' if inverted else ''}greatest(0.0, least(1.0, (greatest(lo, least(hi, v)) - lo)
    / nullif(hi - lo, 0))) END AS v FROM g{i}, q{i})"""


_TARGETS = ["crime_rate", "english_score_rate", "health_care_rate", "tourism_arrivals_rate"]
_INGEST = (
    f"WITH {RAW_SQL}, named AS (SELECT r.*, s_name AS country FROM raw r JOIN supplier ON s_suppkey = item), "
    + ", ".join(_file_values(i, column, stem == "crime_rate") for i, (stem, (column, _)) in enumerate(FILES.items()))
    + ", merged AS (SELECT country, c0.v AS crime_rate, c1.v AS english_score_rate, c2.v AS health_care_rate, c3.v AS tourism_arrivals_rate "
    "FROM c0 FULL JOIN c1 USING (country) FULL JOIN c2 USING (country) FULL JOIN c3 USING (country))"
)


@query(
    "ingest",
    _INGEST
    + " SELECT row_number() OVER (ORDER BY country) AS country_id, country AS country_name, "
    + ", ".join(f"round(coalesce({t}, (SELECT median({t}) FROM merged)), 6) + 0.0 AS {t}" for t in _TARGETS)
    + " FROM merged",
)
def ingest_folder(spark, d):
    """CSV folder -> validated, matched, imputed, scaled, merged, filled, numbered table."""
    folder = csv_folder(spark, d)
    return ingest(spark, folder, method="segments").table.select("country_id", "country_name", *[r6(t) for t in _TARGETS])


@query("ingest_report")
def ingest_reports(spark, d):
    return ingest_report(ingest(spark, csv_folder(spark, d), method="segments"))


@query("validate_folder")
def validate_files(spark, d):
    files = open_folder(spark, csv_folder(spark, d))
    return validate_folder(spark, files).files.drop("path", "filename")


@query("warehouse_round_trip", "SELECT s_suppkey, s_acctbal FROM supplier")
def warehouse_round_trip(spark, d):
    """Two versions written, the newest read back."""
    path, rows = new_folder(spark, "warehouse"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    warehouse.write_table(rows.withColumn("s_acctbal", F.lit(0.0)), path)
    warehouse.write_table(rows, path)
    return warehouse.read_table(spark, path)


@query(
    "upsert_buckets",
    """SELECT c_custkey AS user_id, coalesce(v, c_acctbal) AS last_value FROM customer LEFT JOIN (
      SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id) e ON user_id = c_custkey
    UNION ALL SELECT user_id, arg_max(value, event_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id""",
)
def upsert_in_buckets(spark, d):
    """A table stored in buckets of users, events upserted into the buckets they touch, and read back."""
    path = new_folder(spark, "buckets")
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("last_value"))
    new = table(spark, d, "events").select("user_id", F.col("value").alias("last_value"), F.col("event_id").alias("_seq"))
    upsert_buckets(old, path, "user_id")
    upsert_buckets(new, path, "user_id")
    return read_buckets(spark, path)
