"""Evidence: deduplication, tallies, the decision rules and what follows from a verdict.

Evidence has one row per finding: artist_id, seq, evidence_type, strength, finding, source, tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rules import CONFIDENCE, STRENGTH_RANK, VERDICT_RANGE, is_flagged, lookup

#: Findings with a tag that so many kept ones have are dropped.
MOST_PER_TAG = 2


def strongest(evidence: DataFrame) -> DataFrame:
    """Of findings with the same source and text the strongest stays, the earliest of these; first_seq is where the text first came.

    One shuffle by artist_id serves these windows and the grouping by artist that follows.
    """
    key = ["artist_id", "source", "finding"]
    rank = lookup(STRENGTH_RANK, F.col("strength"))
    best = Window.partitionBy(*key).orderBy(rank.desc(), "seq")
    rows = evidence.repartition("artist_id").withColumns({"rn": F.row_number().over(best), "first_seq": F.min("seq").over(Window.partitionBy(*key))})
    return rows.where("rn = 1").drop("rn")


def gathered(evidence: DataFrame) -> DataFrame:
    """strongest() as artist_id and items, an array in order of strength and first place."""
    order = F.struct((-lookup(STRENGTH_RANK, F.col("strength"))).alias("rank"), F.col("first_seq"), F.col("evidence_type").alias("kind"), "strength", "finding", "source", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return strongest(evidence).groupBy("artist_id").agg(F.sort_array(F.collect_list(order)).alias("items"))


def unique(items: Column) -> Column:
    """strongest() within an array like that of gathered(), in the same order.

    Items are compared with each other only where a source and text occur twice.
    """
    text = F.transform(items, lambda x: F.concat_ws("\0", x["source"], x["finding"]))
    same = lambda x, y: x["source"].eqNullSafe(y["source"]) & x["finding"].eqNullSafe(y["finding"])
    place = lambda x: F.struct(F.coalesce(x["rank"], F.lit(1)), x)
    best = F.array_distinct(F.filter(items, lambda x: ~F.exists(items, lambda y: same(x, y) & (place(y) < place(x)))))
    first = lambda x: F.array_min(F.transform(F.filter(items, lambda y: same(x, y)), lambda y: y["first_seq"]))
    best = F.transform(best, lambda x: x.withField("first_seq", first(x)))
    return F.sort_array(F.when(F.size(F.array_distinct(text)) == F.size(items), items).otherwise(best))


def folded(items: Column) -> Column:
    """A fold over items in their order: a finding whose tags include a full one is dropped.

    The fold carries, beside the kept items, the tags that 1, 2, ... MOST_PER_TAG of them have; the last are the full ones. Where no
    tag occurs often enough, all items stay as they are.
    """
    levels = [f"on_{k + 1}" for k in range(MOST_PER_TAG)]
    none = F.array().cast("array<string>")

    def step(state: Column, item: Column) -> Column:
        counted = item["kind"] != "neutral"
        dropped = counted & F.arrays_overlap(item["tags"], state[levels[-1]])
        raised = [F.array_union(state[levels[0]], item["tags"])]
        raised += [F.array_union(state[now], F.array_intersect(item["tags"], state[before])) for before, now in zip(levels, levels[1:], strict=False)]
        kept = F.concat(state["kept"], F.array(item)).alias("kept")
        return F.when(dropped, state).when(counted & (F.size(item["tags"]) > 0), F.struct(kept, *[x.alias(n) for x, n in zip(raised, levels, strict=True)])).otherwise(F.struct(kept, *[state[n].alias(n) for n in levels]))

    start = F.struct(F.filter(items, lambda x: F.lit(False)).alias("kept"), *[none.alias(n) for n in levels])
    tags = F.flatten(F.transform(F.filter(items, lambda x: x["kind"] != "neutral"), lambda x: x["tags"]))
    return F.when(F.size(tags) - F.size(F.array_distinct(tags)) < MOST_PER_TAG, items).otherwise(F.aggregate(items, start, step, lambda state: state["kept"]))


def deduplicate(evidence: DataFrame) -> DataFrame:
    """gathered(), then folded()."""
    return gathered(evidence).select("artist_id", folded(F.col("items")).alias("items"))


# fixed values: tags that the rules ask for
THREAT_TAGS = {"pfc": ("pfc_label", "pfc_songwriter", "content_farm", "entity_bad_label", "synth_pfc_ghost"), "ai": ("ai_bio", "ai_generated_image", "known_ai_label", "synth_ai_generated"), "ghost": ("synth_pfc_ghost",), "made": ("synth_ai_generated",), "impersonation": ("impersonation",), "pattern": ("high_release_rate", "stream_farm")}
BLOCKLIST_TAGS = ("pfc_label", "pfc_songwriter", "pfc_publisher", "known_ai_artist", "known_ai_label", "known_bad_actor", "entity_confirmed_bad", "entity_suspected", "entity_bad_label", "entity_bad_songwriter", "entity_bad_network", "isrc_pfc_registrant", "ai_generated_music")
CLEAN_SOURCES, CLEAN_TAGS = ("Blocklist", "Entity DB", "pre-check"), ("deezer_ai_clear", "entity_cleared")
#: Points that a red finding takes from the blocklist score, once for each group of tags that it has.
BLOCKLIST_POINTS = ((("known_ai_artist",), 100), (("pfc_label", "known_ai_label"), 100), (("pfc_songwriter",), 80), (("pfc_publisher",), 80), (("isrc_pfc_registrant",), 60), (("entity_bad_network",), 50), (("entity_confirmed_bad",), 100), (("entity_suspected",), 50))
CLEAN_FINDING = "Clean across all blocklists"


def _has(tags: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, names))), F.lit(False))


def consolidate(deduplicated: DataFrame) -> DataFrame:
    """Where no red finding has a blocklist's tag, single clean findings give way to one green finding."""
    hit = F.exists("items", lambda x: (x["kind"] == "red_flag") & _has(x["tags"], BLOCKLIST_TAGS))
    clean = lambda x: (x["kind"] != "red_flag") & (x["source"].isin(*CLEAN_SOURCES) | _has(x["tags"], CLEAN_TAGS) | F.lower(x["finding"]).contains("blocklist"))
    one = F.struct(F.lit(-STRENGTH_RANK["moderate"]).alias("rank"), F.lit(1 << 30).alias("first_seq"), F.lit("green_flag").alias("kind"), F.lit("moderate").alias("strength"), F.lit(CLEAN_FINDING).alias("finding"), F.lit("Blocklist").alias("source"), F.array(F.lit("deezer_ai_clear")).alias("tags"))
    return deduplicated.withColumn("items", F.when(hit, F.col("items")).otherwise(F.concat(F.filter("items", lambda x: ~clean(x)), F.array(one))))


def tallies(deduplicated: DataFrame, empty: bool = True) -> DataFrame:
    """artist_id with counts by kind and strength, weighted totals (3, 2, 1) and what the rules ask of the tags; empty: also of artists without findings.

    The findings are exploded and counted by one aggregate, which shuffles a row for each artist at most.
    """
    rows = deduplicated.select("artist_id", F.explode_outer("items").alias("i"))
    rows = (rows if empty else rows.where("i IS NOT NULL")).select("artist_id", "i.*")
    kind, strength, tags = F.col("kind"), F.col("strength"), F.col("tags")
    red, green = kind == "red_flag", kind == "green_flag"
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    rank = lookup(STRENGTH_RANK, strength)
    best = lambda cond: F.coalesce(F.max(F.when(cond, rank)), F.lit(0))
    columns = {f"{s}_{k}": count((kind == f"{k}_flag") & (strength == s)) for k in ("red", "green") for s in STRENGTH_RANK}
    columns |= {f"{k}_total": F.coalesce(F.sum(F.when(kind == f"{k}_flag", rank)), F.lit(0)) for k in ("red", "green")} | {f"{k}_flags": count(kind == f"{k}_flag") for k in ("red", "green")}
    columns |= {name: some(red & F.array_contains(tags, tag)) for name, tag in (("ai_name", "known_ai_artist"), ("ai_music", "ai_generated_music"), ("pfc_label", "pfc_label"), ("cookie", "cookie_cutter"), ("empty", "empty_catalog"), ("same_day", "same_day_release"), ("short", "stream_farm"))}
    columns |= {"farm": some(red & _has(tags, ("content_farm", "stream_farm"))), "fans_strong": some(green & (strength == "strong") & F.array_contains(tags, "genuine_fans")), "collaborates": some(green & F.array_contains(tags, "collaboration")), "normal_length": some(~red & F.lower("finding").contains("normal track"))}
    columns |= {f"threat_{name}": some(red & _has(tags, names)) for name, names in THREAT_TAGS.items()}
    columns |= {"album_rank": best(green & F.array_contains(tags, "catalog_albums")), "farm_rank": best(red & F.array_contains(tags, "content_farm")), "stuffing_rank": best(red & F.array_contains(tags, "playlist_stuffing"))}
    points = sum((F.when(_has(tags, names), n).otherwise(0) for names, n in BLOCKLIST_POINTS[1:]), F.when(_has(tags, BLOCKLIST_POINTS[0][0]), BLOCKLIST_POINTS[0][1]).otherwise(0))
    columns["listed"] = F.coalesce(F.sum(F.when(red, points)), F.lit(0))
    return rows.groupBy("artist_id").agg(*[v.alias(k) for k, v in columns.items()])


# fixed values
#: Ordered rules: condition, verdict, confidence, name.
RULES = (
    ("ai_name", "Likely Artificial", "high", "known AI name"),
    ("ai_music", "Likely Artificial", "high", "AI content flag"),
    ("pfc_label AND farm", "Likely Artificial", "high", "listed label and farm pattern"),
    ("strong_red >= 3 AND strong_green = 0 AND moderate_green = 0", "Likely Artificial", "medium", "overwhelming red"),
    ("strong_green >= 2 AND strong_red = 0 AND red_total < 4", "Verified Artist", "high", "strong greens dominate"),
    ("platforms >= 3 AND fans_strong AND strong_red = 0 AND red_total < 6", "Verified Artist", "high", "platforms and fans"),
    ("green_total >= 2 * red_total AND green_total >= 4", "Likely Authentic", "medium", "green outweighs"),
    ("red_total >= 2 * green_total AND red_total >= 4", "Suspicious", "medium", "red outweighs"),
    ("pfc_label AND green_total <= red_total * 1.5", "Suspicious", "medium", "listed label alone"),
    ("green_total > red_total", "Likely Authentic", "low", "more green"),
    ("red_total > green_total", "Suspicious", "low", "more red"),
    ("red_flags + green_flags < 5", "Insufficient Data", "low", "too little"),
    ("green_total >= 4 AND red_total >= 4", "Conflicting Signals", "low", "conflict"),
    ("TRUE", "Inconclusive", "low", "mixed"),
)


def decide(rows: DataFrame) -> DataFrame:
    """Adds verdict, confidence and rule: those of the first rule whose condition holds. platforms counts as 0 where missing."""
    if "platforms" not in rows.columns:
        rows = rows.withColumn("platforms", F.lit(0))
    chain = F
    for condition, verdict, confidence, rule in RULES:
        chain = chain.when(F.expr(condition), F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule")))
    return rows.withColumn("d", chain).select("*", "d.*").drop("d")


def verdict_score(rows: DataFrame) -> DataFrame:
    """Adds score: the place within the verdict's range by confidence (0.7) and by the balance of flags (0.3), truncated."""
    green = F.col("strong_green") * 3 + F.col("green_flags") - F.col("strong_green")
    red = F.col("strong_red") * 3 + F.col("red_flags") - F.col("strong_red")
    balance = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (green - red) / F.greatest(green + red, F.lit(1))))
    place = F.coalesce(lookup(CONFIDENCE, F.col("confidence")), F.lit(0.5)) * 0.7 + (balance + 1) / 2 * 0.3
    low = lookup({v: lo for v, (lo, _) in VERDICT_RANGE.items()}, F.col("verdict"))
    high = lookup({v: hi for v, (_, hi) in VERDICT_RANGE.items()}, F.col("verdict"))
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(low + place * (high - low)))).cast("long"))


def threat_category(rows: DataFrame) -> DataFrame:
    """Adds threat: 4 impersonation, 1.5 hybrid, 2 independent AI, 3 fraud farm, 1 ghost artist; null without a suspicious verdict.

    cadence and durations are the quick signals of those names; they count as 0 where rows don't have them.
    """
    for name in ("cadence", "durations"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0))
    t = {name: F.col(f"threat_{name}") for name in THREAT_TAGS}
    category = F.when(~is_flagged(F.col("verdict")), None).when(t["impersonation"], 4.0).when(t["pfc"] & t["ai"], 1.5).when(t["made"] & ~t["ghost"], 2.0).when(t["ai"] & ~t["pfc"] & ~t["ghost"], 2.0).when(t["pfc"] | t["ghost"], 1.0)
    category = category.when(t["pattern"] & (F.col("cadence") >= 65) & (F.col("durations") >= 50), 3.0).otherwise(1.0)
    return rows.withColumn("threat", category)
