"""The deep tier over the tables: batches of five artists, one response a batch and kind, evidence, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation
from lodestone.operators.deep import deep_evidence, split_batches
from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources.dossier import dossiers

_BODIES = """SELECT artist_id, artist_id // 5 AS batch, 'Artist ' || artist_id AS key, artist_id % 3 = 0 AS has_bio, artist_id % 11 <> 0 AS answered,
    'VERDICT: [' || CASE WHEN fans < 1000 THEN 'suspicious' WHEN fans > 5000 THEN 'AUTHENTIC' ELSE 'UNCLEAR' END || ']' || chr(10) || 'Confidence: ' || CASE artist_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN '[medium]' ELSE 'LOW' END || chr(10)
      || CASE WHEN artist_id % 7 = 0 THEN 'AI_MENTIONED: YES' || chr(10) ELSE '' END || 'GEOGRAPHIC_SPECIFICITY: ' || CASE WHEN nation_id < 9 THEN 'Yes' ELSE 'NO' END || chr(10) || CASE WHEN artist_id % 5 = 0 THEN 'VERIFIABLE_CLAIMS: [YES]' || chr(10) ELSE '' END || 'REASONING: of ' || genre AS bio,
    'IMAGE_TYPE: [' || CASE artist_id % 6 WHEN 0 THEN 'HUMAN_PHOTO' WHEN 1 THEN 'LOGO' WHEN 2 THEN 'STOCK_PHOTO' WHEN 3 THEN 'AI_GENERATED' WHEN 4 THEN 'LANDSCAPE' ELSE '' END || ']' || chr(10) || 'AI_ARTIFACTS_DETECTED: ' || CASE artist_id % 9 WHEN 0 THEN 'YES' WHEN 1 THEN 'UNCERTAIN' ELSE 'NO' END || chr(10) || 'CONFIDENCE: ' || CASE WHEN fans > 3000 THEN 'HIGH' ELSE 'MEDIUM' END AS image,
    'CATEGORY: ' || CASE WHEN fans < 0 THEN 'PFC_GHOST' WHEN fans < 500 THEN 'AI_GENERATED' WHEN fans > 8000 THEN 'LEGITIMATE' ELSE 'INCONCLUSIVE' END || chr(10) || 'CONFIDENCE: ' || CASE WHEN artist_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS synthesis FROM b_artist"""
_FIELD = r"upper(coalesce(nullif(trim(trim(regexp_extract(body, '(?i){0}:\s*(.+?)(?:\n|$)', 1)), '[]'), ''), '{1}'))"


def bodies(spark, d):
    """artist_id, batch, key, has_bio, answered and the texts bio, image, synthesis that a model would have written."""
    a, fans = F.col("artist_id"), F.col("fans")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    bio = F.concat(
        line("VERDICT: [", F.when(fans < 1000, "suspicious").when(fans > 5000, "AUTHENTIC").otherwise("UNCLEAR"), "]"), line("Confidence: ", pick(("HIGH", "[medium]", "LOW", "LOW"), a % 4)), F.when(a % 7 == 0, line("AI_MENTIONED: YES")).otherwise(""),
        line("GEOGRAPHIC_SPECIFICITY: ", F.when(F.col("nation_id") < 9, "Yes").otherwise("NO")), F.when(a % 5 == 0, line("VERIFIABLE_CLAIMS: [YES]")).otherwise(""), F.lit("REASONING: of "), F.col("genre"),
    )
    image = F.concat(line("IMAGE_TYPE: [", pick(("HUMAN_PHOTO", "LOGO", "STOCK_PHOTO", "AI_GENERATED", "LANDSCAPE", ""), a % 6), "]"), line("AI_ARTIFACTS_DETECTED: ", pick(("YES", "UNCERTAIN", *["NO"] * 7), a % 9)), F.lit("CONFIDENCE: "), F.when(fans > 3000, "HIGH").otherwise("MEDIUM"))
    synthesis = F.concat(line("CATEGORY: ", F.when(fans < 0, "PFC_GHOST").when(fans < 500, "AI_GENERATED").when(fans > 8000, "LEGITIMATE").otherwise("INCONCLUSIVE")), F.lit("CONFIDENCE: "), F.when(a % 2 == 0, "HIGH").otherwise("LOW"))
    return b.artists(spark, d).select("artist_id", F.floor(a / 5).alias("batch"), F.concat(F.lit("Artist "), a.cast("string")).alias("key"), (a % 3 == 0).alias("has_bio"), (a % 11 != 0).alias("answered"), bio.alias("bio"), image.alias("image"), synthesis.alias("synthesis"))


def answers(spark, d):
    """Every artist's block of each kind, cut out of the responses of its batch; unanswered artists have none."""
    rows = bodies(spark, d)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("said")) for k in ("bio", "image", "synthesis")])
    told = rows.where("answered").select("batch", "artist_id", "key", F.inline(kinds))
    block = F.concat(F.lit("=== ARTIST ["), F.upper("key"), F.lit("] ===\n"), F.col("said"), F.lit("\n\n"))
    responses = told.groupBy("batch", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("artist_id", block.alias("block")))), lambda x: x["block"]), "").alias("text"))  # five artists a batch
    return split_batches(responses.withColumn("text", F.concat(F.lit("Here is what I found.\n"), "text")), rows.select("batch", "key", "artist_id", "has_bio"))


_CASES = """CASE kind WHEN 'bio' THEN [CASE WHEN ai = 'YES' THEN ['red_flag', 'strong', 'ai_bio'] END, CASE verdict WHEN 'SUSPICIOUS' THEN ['red_flag', sure, 'suspicious_bio'] WHEN 'AUTHENTIC' THEN ['green_flag', sure, 'authentic_bio'] ELSE ['neutral', 'weak', ''] END,
      CASE WHEN geo = 'YES' THEN ['green_flag', 'weak', 'geo_specific_bio'] WHEN has_bio THEN ['red_flag', 'weak', 'no_geo_bio'] END, CASE WHEN claims = 'YES' THEN ['green_flag', 'moderate', 'verifiable_claims'] END]
    WHEN 'image' THEN [CASE WHEN artifacts = 'YES' OR image_type = 'AI_GENERATED' THEN ['red_flag', sure, 'ai_generated_image'] WHEN image_type IN ('ABSTRACT_ART', 'LOGO', 'OTHER') THEN ['red_flag', 'weak', 'abstract_image'] WHEN image_type = 'STOCK_PHOTO' THEN ['red_flag', 'moderate', 'stock_photo']
      WHEN image_type = 'HUMAN_PHOTO' AND artifacts = 'NO' THEN ['green_flag', sure, 'authentic_photo'] ELSE ['neutral', 'weak', ''] END]
    ELSE [CASE category WHEN 'PFC_GHOST' THEN ['red_flag', sure2, 'synth_pfc_ghost'] WHEN 'AI_GENERATED' THEN ['red_flag', sure2, 'synth_ai_generated'] WHEN 'LEGITIMATE' THEN ['green_flag', sure2, 'synth_legitimate'] ELSE ['neutral', 'weak', ''] END] END"""


@query(f"""WITH w AS (SELECT artist_id, batch, has_bio, answered, unnest(['bio', 'image', 'synthesis']) AS kind, unnest([bio, image, synthesis]) AS body FROM ({_BODIES})), sent AS (SELECT DISTINCT batch FROM w WHERE answered),
  f AS (SELECT artist_id, kind, has_bio, answered, {_FIELD.format("VERDICT", "INCONCLUSIVE")} AS verdict, {_FIELD.format("AI_MENTIONED", "NO")} AS ai, {_FIELD.format("GEOGRAPHIC_SPECIFICITY", "NO")} AS geo, {_FIELD.format("VERIFIABLE_CLAIMS", "NO")} AS claims, {_FIELD.format("IMAGE_TYPE", "OTHER")} AS image_type,
    {_FIELD.format("AI_ARTIFACTS_DETECTED", "UNCERTAIN")} AS artifacts, {_FIELD.format("CATEGORY", "INCONCLUSIVE")} AS category, {_FIELD.format("CONFIDENCE", "LOW")} AS confidence FROM w SEMI JOIN sent USING (batch)),
  g AS (SELECT *, CASE confidence WHEN 'HIGH' THEN 'strong' WHEN 'MEDIUM' THEN 'moderate' ELSE 'weak' END AS sure, CASE confidence WHEN 'HIGH' THEN 'strong' ELSE 'moderate' END AS sure2 FROM f),
  i AS (SELECT artist_id, kind, unnest(CASE WHEN answered THEN {_CASES} ELSE [['neutral', 'weak', '']] END) AS x FROM g)
  SELECT artist_id, kind AS collector, x[1] AS evidence_type, x[2] AS strength, x[3] AS tag FROM i WHERE x IS NOT NULL""", name="deep_evidence")
def deep_findings(spark, d):
    """The findings of every artist's biography, image and synthesis."""
    return deep_evidence(answers(spark, d)).select("artist_id", "collector", "evidence_type", "strength", F.coalesce(F.get("tags", F.lit(0)), F.lit("")).alias("tag"))


@query()
def deep_verdicts(spark, d):
    """Verdicts once the deep tier's findings are taken with the others. A test holds them against an evaluation of all findings at once."""
    return evaluation.reevaluate(dossiers(spark, d), deep_evidence(answers(spark, d))).select("artist_id", "verdict", "confidence", "score", "threat")
