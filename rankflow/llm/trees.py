"""Gradient-boosted trees on a bounded sample of labelled rows, shared by the classifiers."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a classifier is fitted on, at most (in expectation: rows are drawn by hash).
MOST_LABELLED = 20_000


def bounded(labelled: DataFrame, by: Column, most: int = MOST_LABELLED) -> DataFrame:
    """All labelled rows, or those whose hash falls under the share that leaves about `most`."""
    rows = labelled.count()
    return labelled if rows <= most else labelled.where(F.pmod(F.xxhash64(by), F.lit(1_000_000)) < int(1e6 * most / rows))


class Scorer:
    """Score of a row: the trees' probability of label 1, then the calibrator's, or the share of 1 without trees."""

    def __init__(self, names: list[str], trees: GBTClassificationModel | None, share: float):
        self.names, self.trees, self.share = names, trees, share
        self.calibrator: IsotonicRegressionModel | None = None

    def raw(self, rows: DataFrame, to: str) -> DataFrame:
        if self.trees is None:
            return rows.withColumn(to, F.lit(self.share))
        vectors = VectorAssembler(inputCols=self.names, outputCol="_vector", handleInvalid="keep").transform(rows)
        scored = self.trees.transform(vectors).withColumn(to, vector_to_array("probability")[1])
        return scored.drop("_vector", "probability", "rawPrediction", "prediction")

    def score(self, rows: DataFrame, to: str = "score") -> DataFrame:
        scored = self.raw(rows, "_raw")
        if self.calibrator is None:
            return scored.withColumnRenamed("_raw", to)
        fitted = self.calibrator.transform(scored)
        value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        return fitted.withColumn(to, value).drop("_raw", "prediction")

    def calibrate(self, rows: DataFrame, label: str) -> None:
        """Isotonic regression of the label on the raw score of rows the trees have not seen."""
        scored = self.raw(rows, "_raw").select(F.col("_raw"), F.col(label).cast("double").alias("_label"))
        if self.trees is not None and scored.agg(F.count_distinct("_label")).first()[0] > 1:
            # trees give few different scores: rows of one score count as one with a weight
            merged = scored.groupBy("_raw").agg(F.avg("_label").alias("_label"), F.count("*").cast("double").alias("_weight"))
            self.calibrator = IsotonicRegression(featuresCol="_raw", labelCol="_label", weightCol="_weight").fit(merged)


def fit(rows: DataFrame, names: list[str], label: str, trees: int = 30, depth: int = 4) -> Scorer:
    """Trees on all of `rows`, which are few; without both labels the score is the share of label 1, or 0."""
    counted = rows.agg(F.avg(F.col(label).cast("double")), F.count_distinct(label)).first()
    share = float(counted[0] or 0.0)
    if counted[1] < 2:
        return Scorer(names, None, share)
    data = VectorAssembler(inputCols=names, outputCol="_vector", handleInvalid="keep").transform(rows)
    learner = GBTClassifier(
        featuresCol="_vector", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=5,
        cacheNodeIds=False, checkpointInterval=-1,
    )
    return Scorer(names, learner.fit(data.withColumn("_label", F.col(label).cast("double"))), share)
