"""Models of the corpus over the whole feature matrix, judged out of fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.classification import SparseLogistic, metrics, stratified_folds
from lodestone.operators.written import write_once
from lodestone.plans.base import query
from lodestone.plans.reports import BINARY, CONTINUOUS, features
from lodestone.sources import bindings as b

NAMES = [*BINARY, *CONTINUOUS]


def training_rows(spark, d):
    """artist_id, NAMES, label (the corpus is 1), fold; and the number of folds."""
    rows = write_once(features(spark, d).select("artist_id", *NAMES, F.col("is_corpus").alias("label")), "features")  # the folds read them three times
    told, folds = stratified_folds(rows, "artist_id", "label")
    return write_once(told, "folds"), folds


_ORDER = "row_number() OVER (PARTITION BY c_custkey % 5 < 3 ORDER BY md5('42:' || c_custkey), c_custkey)"


@query(f"SELECT c_custkey AS artist_id, CASE WHEN c_custkey % 5 < 3 THEN 1 ELSE 0 END AS label, CAST(({_ORDER} - 1) % 5 AS INTEGER) AS fold FROM customer")
def stratified_fold(spark, d):
    """Every artist's fold."""
    rows = b.artists(spark, d).select("artist_id", F.when(F.col("artist_id") % 5 < 3, 1).otherwise(0).alias("label"))
    return stratified_folds(rows, "artist_id", "label")[0].select("artist_id", "label", "fold")


@query()
def sparse_logistic(spark, d):
    """The L1 model's metrics by fold and (fold -1) over all, each artist judged by the model that hasn't seen its fold."""
    rows, folds = training_rows(spark, d)
    judged = SparseLogistic(rows, NAMES, "label", list(range(folds))).scores(rows)
    judged = judged.select("label", "guess", F.explode(F.array("fold", F.lit(-1))).alias("fold"))
    return metrics(judged, ["fold"])


@query()
def sparse_coefficients(spark, d):
    """The features that the L1 model of all rows keeps, the heaviest first by place."""
    rows, _ = training_rows(spark, d)
    w = SparseLogistic(rows, NAMES, "label", [-1]).coefficients[-1]
    kept = sorted(((n, float(x)) for n, x in zip(NAMES, w, strict=False) if abs(x) > 0.001), key=lambda nx: -abs(nx[1]))
    return spark.createDataFrame([(k + 1, n, round(x, 4)) for k, (n, x) in enumerate(kept)], "place int, feature string, coefficient double")


@query()
def forest_by_fold(spark, d):
    """A forest of 100 trees on the whole matrix, out of fold by the same folds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, folds = training_rows(spark, d)
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    weighted = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.fillna(0.0)).join(F.broadcast(counts), "label").withColumn("weight", F.lit(1.0) / F.col("n")).withColumn("label", F.col("label").cast("double"))
    judged = None
    for fold in range(folds):
        model = RandomForestClassifier(numTrees=100, maxDepth=10, minInstancesPerNode=5, seed=42, weightCol="weight").fit(weighted.where(F.col("fold") != fold))
        own = model.transform(weighted.where(F.col("fold") == fold)).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("guess"), "fold")
        judged = own if judged is None else judged.union(own)
    return metrics(judged, ["fold"])
