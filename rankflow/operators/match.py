"""Resolve raw entity names against a dictionary: exact key, then best fuzzy match, then rejects.

Everything works on the distinct names. Leftovers that only need a match above the threshold
use an exact segment join (edit-distance mode); suggestions for rejects scan the dictionary a
block at a time and keep three candidates per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.blocks import meet
from rankflow.functions.expr import match_key
from rankflow.functions.ordered import with_sequential_id
from rankflow.functions.text import token_set_scores


def edit_similarity(a: Column, b: Column) -> Column:
    """0-100: share of the longer name that needs no edit."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(
        F.try_divide(F.lit(100.0) * (longest - F.levenshtein(a, b)), longest), F.lit(0.0)
    )


def dictionary_keys(dictionary: DataFrame) -> DataFrame:
    """Match key -> standard name; names that share a key resolve to the smallest."""
    return dictionary.groupBy(match_key(F.col("std_name")).alias("_key")).agg(F.min("std_name").alias("std_name"))


def exact_matches(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct trimmed names with their standard name, NULL where the key is unknown."""
    distinct = names.select(F.trim(F.col("name")).alias("name")).where("name <> ''").distinct()
    return distinct.withColumn("_key", match_key(F.col("name"))).join(dictionary_keys(dictionary), "_key", "left").drop(
        "_key"
    )


def suggestions(leftovers: DataFrame, dictionary: DataFrame, method: str = "token_set", top: int = 3) -> DataFrame:
    """`name`, `rank`, `std_name`, `score`: best dictionary entries per leftover.

    Order: score desc, plain edit distance, name.
    """
    names = dictionary.select("std_name").where("std_name IS NOT NULL").distinct()
    pairs = meet(leftovers.select("name"), names, "std_name")
    others = F.transform("_rows", lambda r: r["std_name"])
    if method == "token_set":
        scored = pairs.withColumn("_others", others).withColumn("_scores", token_set_scores("name", "_others"))
        entries = F.zip_with(
            "_others",
            "_scores",
            lambda o, s: F.struct(
                (-s.cast("double")).alias("s"), F.levenshtein(F.lower("name"), F.lower(o)).alias("e"), o.alias("n")
            ),
        )
    elif method == "edit":
        scored = pairs
        entries = F.transform(
            others,
            lambda o: F.struct(
                (-edit_similarity(F.lower("name"), F.lower(o))).alias("s"),
                F.levenshtein(F.lower("name"), F.lower(o)).alias("e"),
                o.alias("n"),
            ),
        )
    else:
        raise ValueError(f"unknown matching method: {method}")
    best = scored.select("name", F.explode(F.slice(F.array_sort(entries), 1, top)).alias("b")).select("name", "b.*")
    order = Window.partitionBy("name").orderBy("s", "e", "n")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("name", "rank", F.col("n").alias("std_name"), (-F.col("s")).alias("score"))
    )


def close_names(leftovers: DataFrame, dictionary: DataFrame, threshold: float = 90) -> DataFrame:
    """Every dictionary entry with edit similarity >= threshold, without comparing all pairs.

    A dictionary name of length L within the threshold differs by at most k(L) edits. Cut into
    k + 1 segments, one segment must survive unchanged in the other name, shifted by at most k.
    So an equi-join on (length, segment number, segment text) loses no match.
    """
    if not 50 < threshold <= 100:
        raise ValueError("the segment join needs a threshold in (50, 100]")
    t = threshold / 100.0
    edits = f"int(floor(_len * {(1 - t) / t!r}D + 1e-9D))"
    known = (
        dictionary.select("std_name").where("std_name <> ''").distinct()
        .selectExpr("std_name", "lower(std_name) AS _d", "length(lower(std_name)) AS _len")
        .selectExpr("*", f"explode(sequence(0, {edits})) AS _seg", f"{edits} + 1 AS _parts")
        .selectExpr("*", "int(floor(_seg * _len / _parts)) AS _from", "int(floor((_seg + 1) * _len / _parts)) AS _to")
        .selectExpr("std_name", "_d", "_len", "_seg", "substring(_d, _from + 1, _to - _from) AS _text")
    )
    asked = (
        leftovers.select("name").where("name <> ''").distinct()
        .selectExpr("name", "lower(name) AS _q", "length(lower(name)) AS _n")
        .selectExpr(
            "*", f"explode(sequence(int(ceil(_n * {t!r}D - 1e-9D)), int(floor(_n / {t!r}D + 1e-9D)))) AS _len"
        )
        .selectExpr("*", f"{edits} AS _k")
        .selectExpr("*", "explode(sequence(0, _k)) AS _seg")
        .selectExpr(
            "*",
            "int(floor(_seg * _len / (_k + 1))) AS _from",
            "int(floor((_seg + 1) * _len / (_k + 1))) - int(floor(_seg * _len / (_k + 1))) AS _size",
        )
        .selectExpr("*", "greatest(0, _from - _k) AS _lo", "least(_n - _size, _from + _k) AS _hi")
        .where("_hi >= _lo")
        .selectExpr("name", "_q", "_len", "_seg", "explode(sequence(_lo, _hi)) AS _at", "_size")
        .selectExpr("name", "_q", "_len", "_seg", "substring(_q, _at + 1, _size) AS _text")
    )
    score = edit_similarity(F.col("_q"), F.col("_d"))
    return (
        asked.join(known, ["_len", "_seg", "_text"])
        .select("name", "std_name", score.alias("score"), F.levenshtein("_q", "_d").alias("edits"))
        .where(F.col("score") >= threshold)
        .distinct()
    )


def resolve_names(
    names: DataFrame, dictionary: DataFrame, method: str = "token_set", threshold: float = 90, margin: float = 0
) -> DataFrame:
    """One row per distinct name: `std_name` (NULL if rejected), `method`, `score`, `ambiguous`.

    `ambiguous` marks fuzzy matches whose runner-up is also above the threshold and within
    `margin` points of the winner.
    """
    exact = exact_matches(names, dictionary)
    leftovers = exact.where("std_name IS NULL")
    if method == "segments":
        # The best similarity of a reject is below the threshold and is not computed here.
        found = close_names(leftovers, dictionary, threshold)
        ranked = Window.partitionBy("name").orderBy(F.desc("score"), "edits", "std_name")
        found = found.withColumn("_rank", F.row_number().over(ranked)).where("_rank <= 2")
    else:
        found = suggestions(leftovers, dictionary, method, top=2).withColumn("edits", F.col("rank"))
    passing = F.when(F.col("score") >= threshold, F.col("score"))
    best = found.groupBy("name").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "edits", "std_name")).alias("b"),
        F.max("score").alias("_top"),
        F.count(passing).alias("_close"),
        F.min(passing).alias("_runner_up"),
    )
    score = F.col("_top")
    ambiguous = (F.col("_close") > 1) & (score - F.col("_runner_up") <= margin)
    fuzzy = best.select(
        "name",
        F.when(score >= threshold, F.col("b.std_name")).alias("_fuzzy"),
        score.alias("_score"),
        (ambiguous & (score >= threshold)).alias("_ambiguous"),
    )
    return exact.join(fuzzy, "name", "left").select(
        "name",
        F.coalesce("std_name", "_fuzzy").alias("std_name"),
        F.when(F.col("std_name").isNotNull(), "deterministic")
        .when(F.col("_fuzzy").isNotNull(), "fuzzy")
        .otherwise("rejected")
        .alias("method"),
        F.when(F.col("std_name").isNotNull(), 100.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
        F.coalesce("_ambiguous", F.lit(False)).alias("ambiguous"),
    )


def resolve_rows(rows: DataFrame, name: str, resolved: DataFrame) -> DataFrame:
    """Attach `std_name` and `method` to every row; empty names are rejects."""
    lookup = resolved.select(F.col("name").alias("_name"), "std_name", "method")
    return (
        rows.withColumn("_name", F.trim(F.col(name)))
        .join(lookup, "_name", "left")
        .withColumn("method", F.coalesce("method", F.lit("rejected")))
        .drop("_name")
    )


def number_unknown(rows: DataFrame, order: list[str]) -> DataFrame:
    """`assigned_id` UNKNOWN_001, UNKNOWN_002 ... over the rejected rows, in `order` (unique)."""
    rejected = rows.where("std_name IS NULL")
    numbered = with_sequential_id(rejected, order, "_no")
    return numbered.withColumn("assigned_id", F.format_string("UNKNOWN_%03d", "_no")).drop("_no")


def match_report(rows: DataFrame) -> DataFrame:
    """Totals per method over resolved rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_names"),
        F.count_if(F.col("method") == "deterministic").alias("deterministic_matches"),
        F.count_if(F.col("method") == "fuzzy").alias("fuzzy_matches"),
        F.count_if(F.col("method") == "rejected").alias("rejections"),
        F.try_divide(F.count_if(F.col("method") != "rejected"), F.count(F.lit(1))).alias("match_rate"),
    )
