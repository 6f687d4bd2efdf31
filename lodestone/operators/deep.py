"""Responses of the deep tier as evidence: blocks and fields of multi-line texts, and ordered rules on the fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import blocks, response_field

# fixed values: fields by kind of response with what counts where one is missing
FIELDS = {
    "bio": {"VERDICT": "INCONCLUSIVE", "CONFIDENCE": "LOW", "AI_MENTIONED": "NO", "GEOGRAPHIC_SPECIFICITY": "NO", "VERIFIABLE_CLAIMS": "NO"},
    "image": {"IMAGE_TYPE": "OTHER", "AI_ARTIFACTS_DETECTED": "UNCERTAIN", "CONFIDENCE": "LOW"},
    "synthesis": {"CATEGORY": "INCONCLUSIVE", "CONFIDENCE": "LOW"},
}
SOURCES = {"bio": "Deep (bio)", "image": "Deep (image)", "synthesis": "Deep (synthesis)"}
SURE = {"HIGH": "strong", "MEDIUM": "moderate"}


@dataclass(frozen=True)
class Said:
    """One rule: what it gives where the condition on the fields holds. strength: None for that of the confidence."""

    condition: str
    kind: str
    strength: str | None
    finding: str
    tag: str | None = None


RED, GREEN, NEUTRAL = "red_flag", "green_flag", "neutral"
# fixed values: groups of rules by kind; of a group the first that holds counts, of a kind all groups
RULES: dict[str, tuple[tuple[Said, ...], ...]] = {
    "bio": (
        (Said("AI_MENTIONED = 'YES'", RED, "strong", "the biography names AI", "ai_bio"),),
        (Said("VERDICT = 'SUSPICIOUS'", RED, None, "the biography looks made up", "suspicious_bio"), Said("VERDICT = 'AUTHENTIC'", GREEN, None, "the biography fits a real artist", "authentic_bio"), Said("TRUE", NEUTRAL, "weak", "the biography decides nothing")),
        (Said("GEOGRAPHIC_SPECIFICITY = 'YES'", GREEN, "weak", "the biography names places", "geo_specific_bio"), Said("has_bio", RED, "weak", "the biography names no place", "no_geo_bio")),
        (Said("VERIFIABLE_CLAIMS = 'YES'", GREEN, "moderate", "the biography can be checked", "verifiable_claims"),),
    ),
    "image": (
        (
            Said("AI_ARTIFACTS_DETECTED = 'YES'", RED, None, "the image has artifacts of AI", "ai_generated_image"), Said("IMAGE_TYPE = 'AI_GENERATED'", RED, None, "the image looks generated", "ai_generated_image"), Said("IMAGE_TYPE IN ('ABSTRACT_ART', 'LOGO', 'OTHER')", RED, "weak", "the image shows no person", "abstract_image"),
            Said("IMAGE_TYPE = 'STOCK_PHOTO'", RED, "moderate", "the image looks like stock", "stock_photo"), Said("IMAGE_TYPE = 'HUMAN_PHOTO' AND AI_ARTIFACTS_DETECTED = 'NO'", GREEN, None, "the image looks authentic", "authentic_photo"), Said("TRUE", NEUTRAL, "weak", "the image decides nothing"),
        ),
    ),
    "synthesis": (
        (
            Said("CATEGORY = 'PFC_GHOST'", RED, None, "synthesis: ghost artist", "synth_pfc_ghost"), Said("CATEGORY = 'AI_GENERATED'", RED, None, "synthesis: made by AI", "synth_ai_generated"), Said("CATEGORY = 'LEGITIMATE'", GREEN, None, "synthesis: legitimate", "synth_legitimate"), Said("TRUE", NEUTRAL, "weak", "synthesis: undecided"),
        ),
    ),
}


def split_batches(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """responses: batch, kind, text (with a block === ARTIST [key] === for each artist); asked: batch, key, and more columns.

    asked with kind and body, which is null where the response has no block of that key; of several blocks the first counts, keys
    in any case. Batches without a response have no rows.
    """
    found = responses.select("batch", "kind", F.posexplode_outer(blocks(F.col("text"))).alias("at", "block")).where("at IS NOT NULL")
    found = found.select("batch", "kind", "at", F.lower("block.key").alias("__key"), F.btrim("block.body", F.lit(" \t\r\n\x0b\x0c")).alias("body"))
    found = found.groupBy("batch", "kind", "__key").agg(F.min_by("body", "at").alias("body"))
    every = asked.join(responses.select("batch", "kind").distinct(), "batch").withColumn("__key", F.lower("key"))
    return every.join(found, ["batch", "kind", "__key"], "left").drop("__key")


def _strength(said: Said, kind: str) -> Column:
    if said.strength:
        return F.lit(said.strength)
    if kind == "synthesis":  # nothing weaker than moderate
        return F.when(F.col("CONFIDENCE") == "HIGH", "strong").otherwise("moderate")
    out = F
    for value, name in SURE.items():
        out = out.when(F.col("CONFIDENCE") == value, name)
    return out.otherwise("weak")


def deep_evidence(rows: DataFrame) -> DataFrame:
    """rows: artist_id, kind (bio, image, synthesis), body, has_bio (whether a biography was sent) -> the columns of collect(), a row a finding.

    Fields are read in any case, up to the line's end, without brackets; missing ones count as given in FIELDS. A null body gives a
    neutral finding, an unknown kind none.
    """
    missing = F.col("body").isNull()
    parts = []
    for at, (kind, fields) in enumerate(FIELDS.items()):
        own = rows.where(F.col("kind") == kind)
        value = lambda f, default: F.upper(F.coalesce(F.nullif(response_field(F.col("body"), f), F.lit("")), F.lit(default)))
        told = own.select("artist_id", "body", F.coalesce("has_bio", F.lit(False)).alias("has_bio"), *[value(f, default).alias(f) for f, default in fields.items()])
        found = []
        for seq, group in enumerate(RULES[kind]):
            said = F
            for rule in group:
                item = F.struct(F.lit(at * 10 + seq).alias("seq"), F.lit(rule.kind).alias("evidence_type"), _strength(rule, kind).alias("strength"), F.lit(rule.finding).alias("finding"), F.array(*([F.lit(rule.tag)] if rule.tag else [])).cast("array<string>").alias("tags"))
                said = said.when(F.expr(rule.condition), item)
            found.append(said.otherwise(None))
        none = F.struct(F.lit(at * 10).alias("seq"), F.lit(NEUTRAL).alias("evidence_type"), F.lit("weak").alias("strength"), F.lit(f"no {kind} response").alias("finding"), F.array().cast("array<string>").alias("tags"))
        items = F.when(missing, F.array(none)).otherwise(F.array_compact(F.array(*found)))
        parts.append(told.select("artist_id", F.lit(kind).alias("collector"), F.lit(SOURCES[kind]).alias("source"), F.inline_outer(items)).where("seq IS NOT NULL"))  # inline() alone would read the fields again for a filter
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("artist_id", "seq", "collector", "evidence_type", "strength", "finding", "source", "tags")
