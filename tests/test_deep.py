"""Responses of the deep tier against a plain reading of them."""

from __future__ import annotations

import re

from conftest import SF

from lodestone.operators.deep import deep_evidence, split_batches
from lodestone.plans import deep


def read(body, name, default):
    m = re.search(rf"{name}:\s*(.+?)(?:\n|$)", body, re.IGNORECASE)
    return ((m[1].strip().strip("[]") if m else "") or default).upper()


def expected(kind, body, has_bio):
    """[(type, strength, tag)] of one response, by statements."""
    if body is None:
        return [("neutral", "weak", None)]
    confidence, out = read(body, "CONFIDENCE", "LOW"), []
    sure = {"HIGH": "strong", "MEDIUM": "moderate"}.get(confidence, "weak")
    if kind == "bio":
        if read(body, "AI_MENTIONED", "NO") == "YES":
            out.append(("red_flag", "strong", "ai_bio"))
        verdict = read(body, "VERDICT", "INCONCLUSIVE")
        out.append({"SUSPICIOUS": ("red_flag", sure, "suspicious_bio"), "AUTHENTIC": ("green_flag", sure, "authentic_bio")}.get(verdict, ("neutral", "weak", None)))
        if read(body, "GEOGRAPHIC_SPECIFICITY", "NO") == "YES":
            out.append(("green_flag", "weak", "geo_specific_bio"))
        elif has_bio:
            out.append(("red_flag", "weak", "no_geo_bio"))
        if read(body, "VERIFIABLE_CLAIMS", "NO") == "YES":
            out.append(("green_flag", "moderate", "verifiable_claims"))
    elif kind == "image":
        shown, artifacts = read(body, "IMAGE_TYPE", "OTHER"), read(body, "AI_ARTIFACTS_DETECTED", "UNCERTAIN")
        if artifacts == "YES" or shown == "AI_GENERATED":
            out.append(("red_flag", sure, "ai_generated_image"))
        elif shown in ("ABSTRACT_ART", "LOGO", "OTHER"):
            out.append(("red_flag", "weak", "abstract_image"))
        elif shown == "STOCK_PHOTO":
            out.append(("red_flag", "moderate", "stock_photo"))
        elif shown == "HUMAN_PHOTO" and artifacts == "NO":
            out.append(("green_flag", sure, "authentic_photo"))
        else:
            out.append(("neutral", "weak", None))
    elif kind == "synthesis":
        strong = "strong" if confidence == "HIGH" else "moderate"
        tag = {"PFC_GHOST": ("red_flag", strong, "synth_pfc_ghost"), "AI_GENERATED": ("red_flag", strong, "synth_ai_generated"), "LEGITIMATE": ("green_flag", strong, "synth_legitimate")}
        out.append(tag.get(read(body, "CATEGORY", "INCONCLUSIVE"), ("neutral", "weak", None)))
    return out


CASES = [
    ("bio", "VERDICT: SUSPICIOUS\nCONFIDENCE: [HIGH]\nAI_MENTIONED: yes\nREASONING: x", True), ("bio", "verdict: authentic\nconfidence: Medium\nGEOGRAPHIC_SPECIFICITY: YES\nVERIFIABLE_CLAIMS: YES", True), ("bio", "nothing of use", False), ("bio", "", True), ("bio", None, True), ("bio", "VERDICT:\nCONFIDENCE: HIGH", None),
    ("image", "IMAGE_TYPE: HUMAN_PHOTO\nAI_ARTIFACTS_DETECTED: NO\nCONFIDENCE: HIGH", None), ("image", "IMAGE_TYPE: HUMAN_PHOTO\nAI_ARTIFACTS_DETECTED: YES", None), ("image", "IMAGE_TYPE: [HUMAN_PHOTO]", None), ("image", "IMAGE_TYPE: stock_photo\r\nCONFIDENCE: HIGH", None), ("image", "", None), ("image", None, None),
    ("synthesis", "CATEGORY: PFC_GHOST\nCONFIDENCE: LOW", None), ("synthesis", "CATEGORY: [LEGITIMATE]\nCONFIDENCE: HIGH\nREASONING: a\nb", None), ("synthesis", "CATEGORY: other", None), ("other", "CATEGORY: PFC_GHOST", None),
]


def test_each_kind_of_response(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "artist_id long, kind string, body string, has_bio boolean")
    got = {}
    for r in sorted(deep_evidence(rows).collect(), key=lambda r: (r.artist_id, r.seq)):
        got.setdefault(r.artist_id, []).append((r.evidence_type, r.strength, r.tags[0] if r.tags else None))
    assert got == {k: w for k, c in enumerate(CASES) if (w := expected(*c)) and c[0] != "other"}
    assert deep_evidence(rows.limit(0)).count() == 0


def test_blocks_of_a_batch(spark):
    text = "Intro\n=== ARTIST [B (live)] ===\nCATEGORY: LEGITIMATE\n\n=== artist [a] ===\nCATEGORY: PFC_GHOST\n=== ARTIST [A] ===\nCATEGORY: second\n"
    responses = spark.createDataFrame([(1, "synthesis", text)], "batch long, kind string, text string")
    asked = spark.createDataFrame([(1, "A", 7), (1, "b (LIVE)", 8), (1, "c", 9), (2, "A", 10)], "batch long, key string, artist_id long")
    got = {r.artist_id: r.body for r in split_batches(responses, asked).collect()}
    assert got[8] == "CATEGORY: LEGITIMATE" and got[9] is None and set(got) == {7, 8, 9} and got[7] == "CATEGORY: PFC_GHOST"


def test_answers_of_the_tables(spark):
    """What is cut out of the batches is what was written for the artist."""
    wrote = {r.artist_id: r for r in deep.bodies(spark, SF).collect()}
    rows = deep.answers(spark, SF).collect()
    assert len(rows) == 3 * len(wrote)
    for r in rows:
        own = wrote[r.artist_id]
        assert r.body == (own[r.kind].strip() if own.answered else None)


def test_deep_verdicts_follow_the_findings(spark):
    got = {r.artist_id: r.verdict for r in deep.deep_verdicts(spark, SF).collect()}
    from lodestone.operators.evaluation import evaluate
    from lodestone.sources.dossier import dossiers

    before = {r.artist_id: r.verdict for r in evaluate(dossiers(spark, SF)).collect()}
    assert set(got) == set(before) and any(got[k] != before[k] for k in got)
