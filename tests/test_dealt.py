"""Steps whose tasks are bounded by rows, and rows that are computed once."""

from __future__ import annotations

import math

from conftest import SF
from pyspark.sql import functions as F

from lodestone.operators import clues
from lodestone.operators.order import numbered
from lodestone.operators.statistics import gini_splits
from lodestone.operators.written import write_once
from lodestone.plans import clues as plans_clues
from lodestone.plans import propagation, scalars, training
from lodestone.registry import QUERIES
from lodestone.sources import bindings as b
from lodestone.sources.dossier import dossiers


def most(rows) -> int:
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_links_are_told_apart_in_bounded_tasks(spark, monkeypatch):
    lines = b.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(b.dealt, "__kwdefaults__", {"size": 500})
    for rows in (b.credits(spark, SF), b.artist_labels(spark, SF), QUERIES["import_profile"](spark, SF).where("kind = 'songwriter'")):
        assert most(rows) < 1000 < lines


def test_flags_spread_over_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(b.dealt, "__kwdefaults__", {"size": 500})
    assert propagation.graph(spark, SF).rdd.getNumPartitions() == math.ceil(b.table(spark, SF, "lineitem").count() / 500)


def test_names_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(scalars, "NAMES", 20)
    rows = scalars.names(spark, SF)
    assert rows.rdd.getNumPartitions() == math.ceil(rows.count() / 20) > 1
    assert most(QUERIES["name_candidates"](spark, SF)) < rows.count() / 2


def test_numbered_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = numbered(spark.range(1000).repartition(4).mapInPandas(count, "id long"), [-F.col("id")]).toPandas()
    assert dict(zip(rows["id"], rows["place"], strict=True)) == {k: 1000 - k for k in range(1000)}
    assert seen.value == 1000


def test_axis_buckets_write_their_dossiers_once(spark, monkeypatch):
    from lodestone.operators import evaluation

    rows = spark.range(3).select(F.col("id").alias("artist_id"))
    told = []

    def stop(df, label):
        told.append(label)
        raise InterruptedError

    monkeypatch.setattr(evaluation, "write_once", stop)
    try:
        evaluation.axis_buckets(rows)
    except InterruptedError:
        pass
    assert told == ["dossiers"]


def test_values_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(40).selectExpr("'f' AS feature", "CAST(id % 7 AS DOUBLE) AS value", "CAST(id % 7 < 3 AS INT) AS label")
    got = gini_splits(rows.mapInPandas(count, rows.schema)).collect()
    assert [(r.feature, r.threshold) for r in got] == [("f", 2.5)]
    assert seen.value == 40


def test_dossiers_of_few_measures_leave_the_links_out(spark):
    few = dossiers(spark, SF, {"fans", "albums"})
    assert "l_suppkey" in dossiers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(few.collect()) == sorted(dossiers(spark, SF).select(few.columns).collect())


def test_the_matrix_is_made_once_for_its_folds(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(60).selectExpr("id AS artist_id", *[f"CAST(id % {k + 2} AS DOUBLE) AS {c}" for k, c in enumerate(training.NAMES)], "CAST(id % 2 AS INT) AS is_corpus")
    monkeypatch.setattr(training, "features", lambda spark, d: rows.mapInPandas(count, rows.schema))
    told, folds = training.training_rows(spark, SF)
    assert (told.count(), folds) == (60, 5)
    assert seen.value == 60


def test_clues_read_each_artists_genres_and_labels_once(spark, monkeypatch):
    told = []
    write = lambda df, label: told.append(label) or write_once(df, label)
    monkeypatch.setattr(clues, "write_once", write)
    monkeypatch.setattr(plans_clues, "write_once", write, raising=False)
    plans_clues.entity_context_clues(spark, SF)
    assert told == ["labels", "connected", "sums"]
