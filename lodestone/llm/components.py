"""Connected components by alternating large and small stars, as joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_paths, fresh_path


def _nearest(edges: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours. The hint puts an exchange of its own under the join that follows, so that AQE can split a hot u."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).hint("rebalance")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges (a, b) -> (node, component): the smallest id that each node of an edge reaches.

    No edges: no rows. Repeated edges and loops change nothing. Each round's tables are written, and deleted once the next
    one's are there; the caller gets the last one.
    """
    spark, written = edges.sparkSession, []

    def cut(df: DataFrame, label: str) -> DataFrame:
        written.append(fresh_path(spark, label))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), label)
        small = large.join(_nearest(large), "u")
        stars = cut(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), label)
        drop_paths(spark, *written[:-1])
        del written[:-1]
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
