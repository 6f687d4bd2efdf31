"""Streaming forms: windowed API health, threshold crossings, expiring duplicates. They take static or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_health(calls: DataFrame, window: str = "24 hours", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """api_name, start, calls, bad: per window of ts; with a watermark where calls is a stream."""
    rows = calls.withWatermark("ts", lateness) if calls.isStreaming else calls
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = rows.groupBy("api_name", at.alias("w")).agg(F.count("*").alias("calls"), F.sum((F.col("status_code") >= 400).cast("long")).alias("bad"))
    return counted.select("api_name", F.col("w.start").alias("start"), "calls", "bad")


def drop_expired_duplicates(rows: DataFrame, key: str, ttl: str) -> DataFrame:
    """Rows whose key hasn't come within ttl before them, in a stream by its watermark, in a static frame by the row before."""
    if rows.isStreaming:
        return rows.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])
    name = "__before"
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts"))
    return rows.withColumn(name, before).where(F.col(name).isNull() | (F.col("ts") > F.col(name) + F.expr(f"INTERVAL {ttl}"))).drop(name)


def stale_sessions(beats: DataFrame, key: str, gap: str = "45 seconds") -> DataFrame:
    """Sessions of heartbeats that are no further apart than gap: key, start, end, beats."""
    rows = beats.withWatermark("ts", gap) if beats.isStreaming else beats
    counted = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def write_crossings(counts: DataFrame, path: str, checkpoint: str, least: int):
    """Starts a query that writes, for every batch of a streaming aggregate (key, n), the keys that have come to the threshold.

    A key is written once: those of earlier batches are left out. A batch has a folder of its own, which a repeated run of it
    replaces.
    """
    key = counts.columns[0]
    spark = counts.sparkSession
    spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{path}/epoch=-1")  # so that there is something to read

    def write(batch: DataFrame, epoch: int) -> None:
        known = batch.sparkSession.read.schema(f"`{key}` {dict(counts.dtypes)[key]}, epoch long").parquet(path).where(F.col("epoch") != epoch).select(key)
        batch.where(F.col("n") >= least).join(known, key, "left_anti").select(*counts.columns).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
