"""Every query of the library by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import rules  # noqa: I001  its views come first
from lodestone.plans import aggregates, changelog, clues, connectors, deep, exports, joins, lookups, merges, propagation, reports, resolution, scalars, sequences, stats, stores, texts, training
from lodestone.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "changelog", "clues", "connectors", "deep", "exports", "flagship", "joins", "lookups", "merges", "propagation", "reports", "resolution", "rules", "scalars", "sequences", "stats", "stores", "texts", "training"]

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, deduplicated, decided, scored and rolled up by playlist."""
    return QUERIES["playlist_health"](spark, sf_dir)
