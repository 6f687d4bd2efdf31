"""Scans exported with evidence and entities, and imported again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.evaluation import CATEGORIES
from lodestone.operators.written import folder, write_once
from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources.exports import read_scans, write_scans

PART = 100
_POINTS = [f"(artist_id * {k + 3} + scan_id) % 101" for k in range(len(CATEGORIES))]
_FINDINGS = """SELECT scan_id, artist_id, 'total of ' || score AS finding, 'Catalogue' AS source, CASE WHEN score < 30 THEN 'red_flag' WHEN score > 60 THEN 'green_flag' ELSE 'neutral' END AS evidence_type, CASE artist_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS strength, 'tag ' || artist_id % 4 AS tag FROM b_scan_result
  UNION ALL SELECT scan_id, artist_id, 'a "quoted" line' || chr(10) || 'and another', 'Reviewer', 'red_flag', 'weak', NULL FROM b_scan_result WHERE artist_id % 7 = 0"""


def export(spark, d, bundled=False):
    """The written export's folder and manifest; the results are written for their uses."""
    rows = b.scan_results(spark, d).join(b.artists(spark, d).select("artist_id", "name"), "artist_id").select("scan_id", "artist_id", "name", "verdict", "score", *[F.expr(x).alias(c) for x, c in zip(_POINTS, CATEGORIES, strict=True)])
    rows = write_once(rows, "results")
    plain = rows.select("scan_id", "artist_id", F.concat(F.lit("total of "), F.col("score").cast("string")).alias("finding"), F.lit("Catalogue").alias("source"), F.expr("CASE WHEN score < 30 THEN 'red_flag' WHEN score > 60 THEN 'green_flag' ELSE 'neutral' END").alias("evidence_type"), F.expr("CASE artist_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END").alias("strength"), F.lit(None).cast("string").alias("detail"), F.array(F.concat(F.lit("tag "), (F.col("artist_id") % 4).cast("string"))).alias("tags"))
    odd = rows.where("artist_id % 7 = 0").select("scan_id", "artist_id", F.lit('a "quoted" line\nand another').alias("finding"), F.lit("Reviewer").alias("source"), F.lit("red_flag").alias("evidence_type"), F.lit("weak").alias("strength"), F.lit("é").alias("detail"), F.lit(None).cast("array<string>").alias("tags"))
    labels = b.artist_labels(spark, d).select("artist_id", F.col("label").alias("name"), F.lit("label").alias("kind"), F.lit("released_on").alias("relationship"))
    path = f"{folder(spark)}/export-{uuid.uuid4().hex}"
    return path, write_scans(rows, plain.union(odd), labels, path, PART, "gzip", bundled)


@query(f"""WITH p AS (SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY score, artist_id) - 1) // {PART} AS part, row_number() OVER (PARTITION BY scan_id ORDER BY score, artist_id) AS place FROM b_scan_result JOIN b_artist USING (artist_id))
    SELECT scan_id, CAST(part AS BIGINT) AS part, CAST(min(place) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS rows FROM p GROUP BY 1, 2""")
def scan_parts(spark, d):
    """The parts of every scan's export."""
    return export(spark, d)[1].select("scan_id", "part", "first", "rows")


def _read(spark, d):
    """The export read again: in bundles, as parts of a hundred lines would each be a file."""
    return read_scans(spark, export(spark, d, bundled=True)[0], PART)


@query(f"SELECT scan_id, artist_id, name, verdict, score, {', '.join(f'CAST({x} AS BIGINT) AS {c}' for x, c in zip(_POINTS, CATEGORIES, strict=True))}, 'imported' AS tier FROM b_scan_result JOIN b_artist USING (artist_id)")
def scan_reimport(spark, d):
    """Results as they come back from the export."""
    return _read(spark, d)[0]


@query(f"SELECT scan_id, artist_id, finding, source, evidence_type, strength, coalesce(tag, '') AS tag FROM ({_FINDINGS}) JOIN b_artist USING (artist_id)")
def scan_evidence_reimport(spark, d):
    """Findings as they come back from the export."""
    found = _read(spark, d)[1]
    return found.select("scan_id", "artist_id", "finding", "source", "evidence_type", "strength", F.coalesce(F.get("tags", F.lit(0)), F.lit("")).alias("tag"))


@query("SELECT DISTINCT artist_id, label AS name, 'label' AS kind, 'released_on' AS relationship FROM b_artist_label SEMI JOIN b_scan_result USING (artist_id)")
def scan_entities_reimport(spark, d):
    """Links to entities as they come back from the export."""
    return _read(spark, d)[2]
