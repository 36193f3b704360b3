"""How detectable labels are, and how well two graphs can be told apart: gradient-boosted trees over edge features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.link import hash_split
from chronoloom.operators.relational import edge_features

STRUCT = ["log_out", "log_in", "log_gap", "repeat", "log_pair", "first"]
ATTR = ["value", "hour_sin", "hour_cos", "weekday"]


def _scores(rows: DataFrame, features: list[str], least: int) -> tuple[float | None, float | None]:
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    train, test = data.where(hash_split(F.col("id"), 0.7)), data.where(~hash_split(F.col("id"), 0.7))
    if min(train.where("label = 1").count(), train.where("label = 0").count()) < least:
        return None, None
    model = GBTClassifier(maxIter=10, maxDepth=4, seed=7).fit(train)
    out = model.transform(test)
    metric = lambda m: BinaryClassificationEvaluator(metricName=m).evaluate(out)
    return metric("areaUnderROC"), metric("areaUnderPR")


def label_detector(edges: DataFrame, positive: str, least: int = 30) -> DataFrame:
    """features, auc, ap for all, attribute and structure features; null under `least` rows of a class."""
    rows = edge_features(edges).join(edges.select("id", (F.col("label") == positive).cast("double").alias("label")), "id").cache()
    out = [(name, *_scores(rows, cols, least)) for name, cols in (("all", STRUCT + ATTR), ("attr", ATTR), ("struct", STRUCT))]
    return edges.sparkSession.createDataFrame(out, "features string, auc double, ap double")


def two_sample_test(a: DataFrame, b: DataFrame, least: int = 200, cap: int = 40_000) -> DataFrame:
    """2 * abs(AUC - 0.5) of a classifier between two graphs' edges; at most `cap` edges of each, by hash: a sampling operator."""
    pick = lambda e: e.orderBy(F.xxhash64("id"), "id").limit(cap)
    fa, fb = pick(edge_features(a)).withColumn("label", F.lit(1.0)), pick(edge_features(b)).withColumn("label", F.lit(0.0))
    auc, _ = _scores(fa.unionByName(fb).cache(), STRUCT + ATTR, least)
    return a.sparkSession.createDataFrame([(auc, None if auc is None else 2 * abs(auc - 0.5))], "auc double, c2st double")
