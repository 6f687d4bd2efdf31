"""Rank tests, two-by-two tables and split qualities for many features at once.

Running sums over a feature's values are cut into slices, so that no task holds all values of one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.written import write_once


def two_sided(z: Column) -> Column:
    """2 * Phi(-z)."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda x: math.erfc(x / math.sqrt(2)))

    return F.pandas_udf(each, "double")(z)


def unpivot(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, value, label: one row per feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(F.inline(pairs), F.col(label).alias("label")).where("value IS NOT NULL")


SLICES = 64


def running(rows: DataFrame, by: list[str], slice_: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running totals, each row's own included, in the order of slice_ and order within by. A task holds one slice at most."""
    totals = rows.groupBy(*by, slice_).agg(*[F.sum(x).alias(f"__{name}") for name, x in sums.items()])
    before = Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are slices
    totals = totals.select(*by, slice_, *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    inner = Window.partitionBy(*by, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns({name: F.sum(x).over(inner) for name, x in sums.items()}).join(totals, [*by, slice_])
    return inside.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop(*[f"__{name}" for name in sums])


def sliced(counts: DataFrame) -> DataFrame:
    """Adds slice: which of SLICES stretches of its feature's values a value lies in. The bounds, a few numbers for each feature, are gathered once.

    The counts are written for this pass and for the caller's, which would each make them anew from the rows.
    """
    counts = write_once(counts, "counts")
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    bounds = counts.groupBy("feature").agg(F.percentile_approx("value", shares, F.lit(1000)).alias("bounds")).collect()
    if not bounds:
        return counts.withColumn("slice", F.lit(0))
    small = counts.sparkSession.createDataFrame([(r["feature"], sorted(set(r["bounds"]))) for r in bounds], "feature string, bounds array<double>")
    at = F.size(F.filter("bounds", lambda x: x < F.col("value")))
    return counts.join(F.broadcast(small), "feature").withColumn("slice", at).drop("bounds")


def mann_whitney(values: DataFrame) -> DataFrame:
    """(feature, value, label 0/1) -> u (the smaller), z (no tie correction), effect 1 - 2u / (n1 n2).

    Equal values are counted first, so that a window holds the distinct values of a slice.
    """
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("n1"))
    ranked = running(sliced(counts), ["feature"], "slice", ["value"], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("feature").agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    pairs = F.col("n1") * F.col("n2")
    rows = sums.withColumn("u", F.least(u1, pairs - u1))
    sigma = F.sqrt(pairs * (F.col("n1") + F.col("n2") + 1) / 12)
    return rows.select("feature", "n1", "n2", "u", F.when(sigma > 0, F.abs(F.col("u") - pairs / 2) / sigma).alias("z"), F.when(sigma > 0, 1 - 2 * F.col("u") / pairs).otherwise(0.0).alias("effect"))


def two_by_two(values: DataFrame) -> DataFrame:
    """(feature, value 0/1, label 0/1) -> odds ratio (2 places) and chi squared with Yates' correction."""
    cell = lambda v, y: F.sum(F.when((F.col("value") == v) & (F.col("label") == y), 1).otherwise(0))
    t = values.groupBy("feature").agg(cell(1, 1).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(0, 0).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    parts = []
    for o, row, col in (("a", ("a", "b"), ("a", "c")), ("b", ("a", "b"), ("b", "d")), ("c", ("c", "d"), ("a", "c")), ("d", ("c", "d"), ("b", "d"))):
        e = (F.col(row[0]) + F.col(row[1])) * (F.col(col[0]) + F.col(col[1])) / n
        parts.append(F.when(e > 0, F.pow(F.abs(F.col(o) - e) - 0.5, F.lit(2)) / e).otherwise(0.0))
    odds = F.when((F.col("b") * F.col("c") == 0) & (F.col("a") * F.col("d") > 0), float("inf")).when(F.col("b") * F.col("c") == 0, 0.0).otherwise(F.round(F.col("a") * F.col("d") / (F.col("b") * F.col("c")), 2))
    return t.select("feature", "a", "b", "c", "d", (parts[0] + parts[1] + parts[2] + parts[3]).alias("chi2"), odds.alias("odds"))


def gini_splits(values: DataFrame) -> DataFrame:
    """The best threshold of each feature, halfway between neighbouring distinct values, by Gini gain; importance is its share of all gains."""
    counts = sliced(values.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("label").alias("k")))
    rows = running(counts, ["feature"], "slice", ["value"], {"nl": F.col("n"), "kl": F.col("k")})
    # a slice's last value has its neighbour in the next slice
    firsts = counts.groupBy("feature", "slice").agg(F.min("value").alias("first"))
    firsts = firsts.select("feature", "slice", F.lead("first").over(Window.partitionBy("feature").orderBy("slice")).alias("next_first"))
    own = F.lead("value").over(Window.partitionBy("feature", "slice").orderBy("value"))
    rows = rows.withColumn("own_next", own).join(firsts, ["feature", "slice"]).withColumn("next", F.coalesce("own_next", "next_first")).where("next IS NOT NULL")
    rows = rows.join(F.broadcast(counts.groupBy("feature").agg(F.sum("n").alias("nt"), F.sum("k").alias("kt"))), "feature")  # a row for each feature
    gini = lambda k, n: 2 * (k / n) * (1 - k / n)
    nr, kr = F.col("nt") - F.col("nl"), F.col("kt") - F.col("kl")
    gain = gini(F.col("kt"), F.col("nt")) - F.col("nl") / F.col("nt") * gini(F.col("kl"), F.col("nl")) - nr / F.col("nt") * gini(kr, nr)
    best = rows.withColumns({"gain": F.round(gain, 10), "threshold": (F.col("value") + F.col("next")) / 2}).groupBy("feature").agg(F.max_by("threshold", F.struct("gain", -F.col("threshold"))).alias("threshold"), F.max("gain").alias("gain"))
    total = best.agg(F.sum("gain").alias("total"))
    return best.join(F.broadcast(total)).select("feature", "threshold", "gain", F.round(F.when(F.col("total") > 0, F.col("gain") / F.col("total")).otherwise(0.0), 6).alias("importance"))
