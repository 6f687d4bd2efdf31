"""Joins over entity links: shared contributors, networks, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.containers import union_degrees


def neighbours(links: DataFrame, node: str, via: str, keep: list[str] | None = None) -> DataFrame:
    """Pairs (node, other) that share a via, with via. Links are deduplicated first, so that roles don't multiply pairs."""
    left = links.select(node, via, *(keep or [])).distinct()
    right = links.select(F.col(node).alias("other"), F.col(via)).distinct()
    return left.join(right, via).where(F.col(node) != F.col("other"))


def degrees(links: DataFrame, node: str, via: str, marked: DataFrame | None = None) -> DataFrame:
    """node, degree: how many other nodes share a via with it; with marked (nodes), also how many of these are in it. Nodes (whole numbers) without any are left out.

    The nodes of a via are adaptive containers, which are united for each node, so that no pairs of nodes are made.
    """
    own = links.select(F.col(node).cast("long").alias("node"), F.col(via).alias("via")).where("node IS NOT NULL AND via IS NOT NULL")
    special = None if marked is None else marked.select(F.col(node).cast("long").alias("node")).where("node IS NOT NULL").distinct()
    total = union_degrees(own, special).where("n > 1").select(F.col("node").alias(node), (F.col("n") - 1).alias("degree"), "m")
    if marked is None:
        return total.drop("m")
    self_ = special.select(F.col("node").alias(node), F.lit(1).alias("self"))
    return total.join(self_, node, "left").select(node, "degree", (F.col("m") - F.coalesce("self", F.lit(0))).alias("marked"))


def sharing(links: DataFrame, node: str, via: str, least: int) -> DataFrame:
    """Values of via that at least so many distinct nodes have."""
    return links.groupBy(via).agg(F.countDistinct(node).alias("n_artists")).where(F.col("n_artists") >= least)


def overlap_with(links: DataFrame, marked: DataFrame, node: str, via: str) -> DataFrame:
    """Nodes outside marked that share a via with one inside, with via; the marked links are reduced to distinct vias before the join."""
    hot = links.join(marked.select(node), node, "left_semi").select(via).distinct()
    return links.join(hot, via, "left_semi").join(marked.select(node), node, "left_anti").select(node, via).distinct()


def set_overlaps(members: DataFrame, group: str, member: str, least: int, top: int) -> DataFrame:
    """Pairs of groups that share at least so many members, the top ones."""
    own = members.select(group, member).distinct()
    a, b = own.select(F.col(group).alias("a"), member), own.select(F.col(group).alias("b"), member)
    pairs = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.where(F.col("shared") >= least).orderBy(F.desc("shared"), "a", "b").limit(top)


def all_flagged(links: DataFrame, flags: DataFrame, node: str, via: str, least: int) -> DataFrame:
    """Values of via all of whose nodes are flagged: via, n_artists."""
    rows = links.select(node, via).distinct().join(flags, node)
    return rows.groupBy(via).agg(F.count("*").alias("n_artists"), F.sum(F.col("flag").cast("int")).alias("n_flagged")).where((F.col("n_artists") == F.col("n_flagged")) & (F.col("n_artists") >= least)).drop("n_flagged")


def limit_per(rows: DataFrame, group: str | list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
