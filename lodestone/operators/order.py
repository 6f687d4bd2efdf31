"""Row numbers over whole tables, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.written import write_once


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in an order, from 1: rows are dealt by ranges, and each range's numbers start after those before it.

    Rows that tie in the order have places in any order among themselves; equal keys share a range. The rows are written before they
    are dealt: the ranges are found by a pass of its own, which would compute them a second time.
    """
    keys = [f"__key{k}" for k in range(len(order))]
    keyed = write_once(rows.withColumns(dict(zip(keys, order, strict=True))), "keyed")
    dealt = write_once(keyed.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    sizes = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return dealt.withColumn("__own", own).join(F.broadcast(sizes), "__range").select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))
