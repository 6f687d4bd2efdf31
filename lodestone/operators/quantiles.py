"""Exact quantiles of many groups at once by histogram refinement: no buffer grows with the number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.written import write_once

#: Bins of a round. Values that are still open fall to about 1 / BINS with each.
BINS = 256


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name of shares, the quantile of value at that share, between neighbours by linear interpolation (as median()).

    Null and NaN values are left out; groups without others give no row. Null is a group of its own. by may be empty.

    A quantile asks for the values at two ranks. For each rank a stretch of values [low, high] is known that holds it, with the
    number of values before it. A round counts the values of each open stretch in BINS bins, keeping the least and the greatest
    of each bin, and goes on with the bin that holds the rank, from its least to its greatest value; when these agree, the value
    is found. A bin is split at least between these two, so every round makes progress, whatever the distribution.
    """
    column = F.col(value).cast("double")
    own = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"__{c}") for c in by], *by, column.alias("__value")).where("__value IS NOT NULL AND NOT isnan(__value)")
    own = write_once(own.select(F.concat_ws("\1", F.lit(""), *[f"__{c}" for c in by]).alias("__group"), *by, "__value"), "values")
    groups = own.groupBy("__group").agg(*[F.first(c).alias(c) for c in by], F.count("*").alias("n"), F.min("__value").alias("low"), F.max("__value").alias("high"))
    groups = write_once(groups, "groups")
    place = [F.struct(F.lit(name).alias("share"), ((F.col("n") - 1) * F.lit(float(share))).alias("at")) for name, share in shares.items()]
    ranks = groups.select("__group", "low", "high", F.explode(F.array(*place)).alias("p")).select("__group", "low", "high", "p.share", "p.at")
    ends = F.array_distinct(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long")))
    open_ = ranks.select("__group", F.explode(ends).alias("rank"), F.lit(0).cast("long").alias("before"), "low", "high").distinct()
    found = []
    while True:
        open_ = write_once(open_, "open")
        found.append(open_.where("low = high").select("__group", "rank", F.col("low").alias("__found")))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        stretches = open_.select("__group", "low", "high").distinct()
        inside = own.select("__group", "__value").join(stretches, "__group").where("__value BETWEEN low AND high")
        # halves, so that the width of a stretch of extreme values is finite; the greatest value has a bin of its own
        part = F.coalesce(F.try_divide(F.col("__value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), F.lit(0.0))
        bin_ = F.when(F.col("__value") == F.col("high"), BINS).otherwise(F.least(F.floor(part * BINS), F.lit(BINS - 1))).cast("int")
        counted = inside.groupBy("__group", "low", "high", bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("__value").alias("bin_low"), F.max("__value").alias("bin_high"))
        upto = F.sum("m").over(Window.partitionBy("__group", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        counted = counted.withColumn("passed", F.coalesce(upto, F.lit(0)))
        asked = open_.join(counted, ["__group", "low", "high"]).where((F.col("rank") >= F.col("before") + F.col("passed")) & (F.col("rank") < F.col("before") + F.col("passed") + F.col("m")))
        open_ = asked.select("__group", "rank", (F.col("before") + F.col("passed")).alias("before"), F.col("bin_low").alias("low"), F.col("bin_high").alias("high"))
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    values = write_once(values, "ranks")
    lower = values.select("__group", F.col("rank").alias("__lower"), F.col("__found").alias("__a"))
    upper = values.select("__group", F.col("rank").alias("__upper"), F.col("__found").alias("__b"))
    told = ranks.select("__group", "share", "at", F.floor("at").cast("long").alias("__lower"), F.ceil("at").cast("long").alias("__upper"))
    told = told.join(lower, ["__group", "__lower"]).join(upper, ["__group", "__upper"])
    between = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("at") - F.col("__lower")))
    wide = told.groupBy("__group").agg(*[F.max(F.when(F.col("share") == name, between)).alias(name) for name in shares])
    return groups.select("__group", *by).join(wide, "__group").select(*by, *shares)
