"""Features of single texts, and held-out accuracy on the given tables."""

import math

from pyspark.sql import functions as F
from rankflow.llm import toxicity as t
from rankflow.llm.common import crc_fold, table

LEX = {"idiot": 2.0, "moron": 1.0}


def feature(text, name):
    return dict(zip(t.FEATURES, t.features_of(text, LEX), strict=True))[name]


def test_features():
    assert t.features_of(None, LEX) == t.features_of("", LEX) == [0.0] * len(t.FEATURES)
    assert feature("you Idiot! a moron.", "lexicon_log_count") == math.log1p(2)
    assert feature("you Idiot! a moron.", "near_second") == 50.0
    for hidden in ("1d10t", "id.iot", "i*diot", "IDIOOOT", "!diot", "id!ot"):
        assert feature(f"an {hidden} here", "obfuscated_log_count") == math.log1p(1), hidden
    assert feature("i d i o t and a b c", "spaced_letters") == 1.0
    assert feature("clean words only", "lexicon_density") == 0.0
    assert feature("SHOUT it OUT", "capital_words") > 60
    assert feature("x" * 300_000 + " idiot", "lexicon_kinds") == 1.0


def test_held_out_accuracy_and_edges(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    extra = [(None, None, "en", "s", None), (10_000_001, "", None, None, 0), (10_000_002, None, None, None, None)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema)).withColumn("toxic", F.lit("clash")).withColumn("Score", F.lit(1))
    labels = labels.unionAll(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    got = t.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or crc_fold(r.doc_id) == 0) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    good = [r.score for r in held if truth[r.doc_id] == 0]
    bad = [r.score for r in held if truth[r.doc_id] == 1]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) > 0.8 * len(bad) * len(good)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in t.classify(docs, none).collect()} == {0.0}
    assert t.classify(docs.where("false"), none).count() == 0
