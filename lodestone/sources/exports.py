"""Scans as nested JSON in ordered parts, with a manifest; and back into rows.

A scan's artists are lines of JSON, each with its findings, category scores and entities. Lines stand in the report's order in
parts of PART_ROWS, so that no scan is one row or one task; the manifest has a row a part, by which a reader can tell a part
that is missing, cut or changed. A part is a folder with a file of its own, or stands in a bundle: a file of BUNDLE_ROWS lines,
whose places tell their parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.evaluation import CATEGORIES
from lodestone.operators.statistics import running
from lodestone.operators.written import write_once

PART_ROWS = 1000
#: Lines of a bundle, in whole parts.
BUNDLE_ROWS = 100_000
FINDING = "struct<finding:string,source:string,type:string,strength:string,detail:string,tags:array<string>>"
ENTITY = "struct<name:string,type:string,relationship:string>"
#: What the readers take of a line: a use parses its own fields alone.
RESULT = "scan_id bigint, place bigint, artist_id bigint, name string, verdict string, score bigint, radar struct<labels:array<string>,scores:array<bigint>>"
FOUND = f"scan_id bigint, artist_id bigint, red_flags array<{FINDING}>, green_flags array<{FINDING}>, neutral_notes array<{FINDING}>"
NAMED = "artist_id bigint, entities string"
KINDS = {"red_flag": "red_flags", "green_flag": "green_flags", "neutral": "neutral_notes"}


def scan_lines(results: DataFrame, evidence: DataFrame, entities: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """scan_id, part, place, artist_id, body (JSON) of every result.

    results: scan_id, artist_id, name, verdict, score, and the CATEGORIES; evidence: scan_id, artist_id, finding, source,
    evidence_type, strength, detail, tags; entities: artist_id, name, kind, relationship. The order is by score, nulls first, then
    artist. Findings go by strength (strong first), source and text, entities by kind and name; missing ones are empty arrays.
    """
    rank = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "moderate", 1).otherwise(2)
    item = F.struct(rank.alias("rank"), "source", "finding", "evidence_type", "strength", "detail", "tags")
    found = evidence.groupBy("scan_id", "artist_id").agg(F.array_sort(F.collect_list(item)).alias("found"))  # an artist's findings
    shown = F.transform(F.array_sort(F.collect_set(F.struct("kind", "name", "relationship"))), lambda e: F.struct(e["name"].alias("name"), e["kind"].alias("type"), e["relationship"].alias("relationship")))
    named = entities.groupBy("artist_id").agg(F.to_json(shown).alias("named"))  # as JSON once an artist, not once a scan
    order = F.coalesce(F.col("score"), F.lit(-1))
    placed = running(results.withColumn("__slice", order), ["scan_id"], "__slice", ["artist_id"], {"place": F.lit(1)}).drop("__slice")
    rows = placed.join(found, ["scan_id", "artist_id"], "left").join(named, "artist_id", "left")

    def flags(kind: str) -> Column:
        own = F.filter(F.coalesce("found", F.filter(F.array(F.col("found")[0]), lambda x: F.lit(False))), lambda x: x["evidence_type"] == kind)
        return F.transform(own, lambda x: F.struct(x["finding"].alias("finding"), x["source"].alias("source"), x["evidence_type"].alias("type"), x["strength"].alias("strength"), x["detail"].alias("detail"), F.coalesce(x["tags"], F.array().cast("array<string>")).alias("tags")))

    radar = F.struct(F.array(*map(F.lit, CATEGORIES)).alias("labels"), F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in CATEGORIES]).alias("scores"))
    line = F.struct("scan_id", F.col("place").cast("long").alias("place"), "artist_id", "name", "verdict", F.col("score").cast("long").alias("score"), *[flags(k).alias(n) for k, n in KINDS.items()], radar.alias("radar"))
    text = F.to_json(line)
    body = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"entities":'), F.coalesce("named", F.lit("[]")), F.lit("}"))
    return rows.select("scan_id", F.floor((F.col("place") - 1) / part_rows).alias("part"), F.col("place").cast("long").alias("place"), "artist_id", body.alias("body"))


def manifest(lines: DataFrame) -> DataFrame:
    """scan_id, part, first (place), rows, bytes, digest of every part: the MD5 of its lines' MD5s in order."""
    told = F.array_sort(F.collect_list(F.struct("place", F.md5(F.col("body").cast("binary")).alias("d"))))  # PART_ROWS digests
    sums = [F.min("place").alias("first"), F.count("*").alias("rows"), F.sum(F.octet_length("body")).alias("bytes"), told.alias("told")]
    return lines.groupBy("scan_id", "part").agg(*sums).select("scan_id", "part", "first", "rows", "bytes", F.md5(F.array_join(F.transform("told", lambda x: x["d"]), "").cast("binary")).alias("digest"))


def write_scans(results: DataFrame, evidence: DataFrame, entities: DataFrame, path: str, part_rows: int = PART_ROWS, compression: str = "none", bundled: bool = False) -> DataFrame:
    """Writes path/scans (a folder a scan and part, its lines in order, compressed by a codec that Spark knows) and path/manifest; returns the manifest, which is written last.

    bundled: a folder a scan and bundle of about BUNDLE_ROWS lines, as a file for each of many small parts costs more than its lines.
    """
    lines = write_once(scan_lines(results, evidence, entities, part_rows), "lines")
    folder = "bundle" if bundled else "part"
    dealt = lines.withColumn("bundle", F.floor(F.col("part") / max(1, BUNDLE_ROWS // part_rows))) if bundled else lines
    dealt = dealt.repartition("scan_id", folder).sortWithinPartitions("scan_id", folder, "place")
    dealt.select("scan_id", folder, "body").write.partitionBy("scan_id", folder).text(f"{path}/scans", compression=compression)
    manifest(lines).write.parquet(f"{path}/manifest")
    return results.sparkSession.read.parquet(f"{path}/manifest")


def read_scans(spark: SparkSession, path: str, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(results, evidence, entities, faults) of a written export: faults are manifest rows whose part is missing or differs. What is no JSON gives no rows.

    Each is read from the files when it is used, with its own fields alone; part_rows tells the parts of bundles.
    """
    texts = spark.read.text(f"{path}/scans")
    parsed = lambda schema: texts.select(F.from_json("value", schema).alias("l")).where("l.artist_id IS NOT NULL").select("l.*")
    told = spark.read.parquet(f"{path}/manifest")
    place = F.coalesce(F.from_json("value", "place bigint")["place"], F.lit(0))
    part = F.col("part").cast("long") if "part" in texts.columns else F.floor((place - 1) / part_rows)  # no part has a line that is no JSON
    got = manifest(texts.select(F.col("scan_id").cast("long").alias("scan_id"), part.alias("part"), place.alias("place"), F.col("value").alias("body")))
    faults = told.join(got.select("scan_id", "part", F.col("digest").alias("__digest")), ["scan_id", "part"], "left").where("__digest IS NULL OR __digest <> digest").drop("__digest")
    results = parsed(RESULT).select("scan_id", "artist_id", "name", "verdict", "score", *[F.get("radar.scores", F.lit(k)).alias(c) for k, c in enumerate(CATEGORIES)], F.lit("imported").alias("tier"))
    every = F.concat(*[F.col(n) for n in KINDS.values()])
    evidence = parsed(FOUND).select("scan_id", "artist_id", F.explode(every).alias("e")).select("scan_id", "artist_id", "e.finding", "e.source", F.col("e.type").alias("evidence_type"), "e.strength", "e.detail", "e.tags")
    named = parsed(NAMED).distinct().select("artist_id", F.from_json("entities", f"array<{ENTITY}>").alias("entities"))  # an artist's are the same in all its scans: told apart before they are parsed
    entities = named.select("artist_id", F.explode("entities").alias("e")).select("artist_id", "e.name", F.col("e.type").alias("kind"), "e.relationship").distinct()
    return results, evidence, entities, faults


def summary(results: DataFrame) -> DataFrame:
    """scan_id, verdict, n, mean_score: the verdicts of each scan."""
    return results.groupBy("scan_id", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))
