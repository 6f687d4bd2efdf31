"""Signals, evidence, decisions and categories over the bound dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import signals as s
from lodestone.functions.rules import lookup
from lodestone.operators import evaluation as e
from lodestone.operators.collectors import RULES, collect, collected_sql
from lodestone.operators.evidence import BLOCKLIST_TAGS, CLEAN_FINDING, consolidate, decide, deduplicate, gathered, tallies, threat_category, verdict_score
from lodestone.operators.order import numbered
from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources.dossier import dossiers

_LIST = "[" + ", ".join(f"'{t}'" for t in BLOCKLIST_TAGS) + "]"
b.SQL["b_found"] = collected_sql("b_dossier")
b.SQL["b_pass1"] = """SELECT artist_id, evidence_type, strength, finding, source, tags, CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END AS rank, min(seq) OVER (PARTITION BY artist_id, source, finding) AS first_seq FROM b_found
  QUALIFY row_number() OVER (PARTITION BY artist_id, source, finding ORDER BY CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END DESC, seq) = 1"""
b.SQL["b_order"] = "SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY rank DESC, first_seq) AS pos FROM b_pass1"
#: The fold by tags, one finding of every artist at a time; used holds the tags of what was kept so far.
b.SQL["b_fold"] = """SELECT DISTINCT artist_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS used, false AS kept FROM b_order UNION ALL
  SELECT artist_id, pos, CASE WHEN dropped OR neutral THEN used ELSE list_concat(used, tags) END, NOT dropped FROM (SELECT o.artist_id, o.pos, f.used, o.tags, o.evidence_type = 'neutral' AS neutral,
    o.evidence_type <> 'neutral' AND len(list_filter(o.tags, lambda t: len(list_filter(f.used, lambda u: u = t)) >= 2)) > 0 AS dropped FROM b_fold f JOIN b_order o ON o.artist_id = f.artist_id AND o.pos = f.pos + 1)"""
b.SQL["b_kept"] = "SELECT o.* FROM b_order o JOIN b_fold f ON o.artist_id = f.artist_id AND o.pos = f.pos WHERE f.kept"
b.SQL["b_hit"] = f"SELECT artist_id, coalesce(bool_or(evidence_type = 'red_flag' AND list_has_any(tags, {_LIST})), false) AS hit FROM b_kept GROUP BY 1"
b.SQL["b_final"] = f"""SELECT k.artist_id, evidence_type, strength, finding, source, tags FROM b_kept k JOIN b_hit h ON k.artist_id = h.artist_id WHERE hit OR evidence_type = 'red_flag' OR NOT (source IN ('Blocklist', 'Entity DB', 'pre-check') OR list_has_any(tags, ['deezer_ai_clear', 'entity_cleared']) OR contains(lower(finding), 'blocklist'))
  UNION ALL SELECT artist_id, 'green_flag', 'moderate', '{CLEAN_FINDING}', 'Blocklist', ['deezer_ai_clear'] FROM b_hit WHERE NOT hit"""


def _tally_sql(view: str) -> str:
    kinds = ", ".join(f"CAST(count(*) FILTER (evidence_type = '{k}_flag' AND strength = '{st}') AS BIGINT) AS {st}_{k}" for k in ("red", "green") for st in ("strong", "moderate", "weak"))
    red = lambda *tags: "coalesce(bool_or(evidence_type = 'red_flag' AND list_has_any(tags, [" + ", ".join(f"'{t}'" for t in tags) + "])), false)"
    level = "CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END"
    return f"""SELECT *, strong_red * 3 + moderate_red * 2 + weak_red AS red_total, strong_green * 3 + moderate_green * 2 + weak_green AS green_total FROM (SELECT artist_id, {kinds}, CAST(count(*) FILTER (evidence_type = 'red_flag') AS BIGINT) AS red_flags, CAST(count(*) FILTER (evidence_type = 'green_flag') AS BIGINT) AS green_flags,
      {red("known_ai_artist")} AS ai_name, {red("ai_generated_music")} AS ai_music, {red("pfc_label")} AS pfc_label, {red("content_farm", "stream_farm")} AS farm, {red("stream_farm")} AS short_, {red("cookie_cutter")} AS cookie, {red("empty_catalog")} AS empty_, {red("same_day_release")} AS same_day, {red("high_release_rate", "stream_farm")} AS pattern,
      {red("pfc_label", "pfc_songwriter", "content_farm", "entity_bad_label", "synth_pfc_ghost")} AS t_pfc, {red("ai_bio", "ai_generated_image", "known_ai_label", "synth_ai_generated")} AS t_ai,
      coalesce(bool_or(evidence_type = 'green_flag' AND strength = 'strong' AND list_contains(tags, 'genuine_fans')), false) AS fans_strong, coalesce(bool_or(evidence_type = 'green_flag' AND list_contains(tags, 'collaboration')), false) AS collaborates, coalesce(bool_or(finding = 'normal track lengths'), false) AS normal_length,
      coalesce(max({level}) FILTER (evidence_type = 'green_flag' AND list_contains(tags, 'catalog_albums')), 0) AS album_rank, coalesce(max({level}) FILTER (evidence_type = 'red_flag' AND list_contains(tags, 'content_farm')), 0) AS farm_rank, coalesce(max({level}) FILTER (evidence_type = 'red_flag' AND list_contains(tags, 'playlist_stuffing')), 0) AS stuffing,
      CAST(coalesce(sum((list_contains(tags, 'known_ai_artist')::INT + list_has_any(tags, ['pfc_label', 'known_ai_label'])::INT + list_contains(tags, 'entity_confirmed_bad')::INT) * 100 + (list_contains(tags, 'pfc_songwriter')::INT + list_contains(tags, 'pfc_publisher')::INT) * 80 + list_contains(tags, 'isrc_pfc_registrant')::INT * 60
        + (list_contains(tags, 'entity_bad_network')::INT + list_contains(tags, 'entity_suspected')::INT) * 50) FILTER (evidence_type = 'red_flag'), 0) AS BIGINT) AS listed FROM {view} GROUP BY 1)"""


_CASES = """WHEN ai_name THEN {0} WHEN ai_music THEN {0} WHEN pfc_label AND farm THEN {0} WHEN strong_red >= 3 AND strong_green = 0 AND moderate_green = 0 THEN {1} WHEN strong_green >= 2 AND strong_red = 0 AND red_total < 4 THEN {2} WHEN platforms >= 3 AND fans_strong AND strong_red = 0 AND red_total < 6 THEN {2}
  WHEN green_total >= 2 * red_total AND green_total >= 4 THEN {3} WHEN red_total >= 2 * green_total AND red_total >= 4 THEN {4} WHEN pfc_label AND green_total <= red_total * 1.5 THEN {4} WHEN green_total > red_total THEN {5} WHEN red_total > green_total THEN {6} WHEN red_flags + green_flags < 5 THEN {7} WHEN green_total >= 4 AND red_total >= 4 THEN {8} ELSE {9} END"""
_VERDICT = "CASE " + _CASES.format("'Likely Artificial'", "'Likely Artificial'", "'Verified Artist'", "'Likely Authentic'", "'Suspicious'", "'Likely Authentic'", "'Suspicious'", "'Insufficient Data'", "'Conflicting Signals'", "'Inconclusive'")
_CONFIDENCE = "CASE " + _CASES.format("'high'", "'medium'", "'high'", "'medium'", "'medium'", "'low'", "'low'", "'low'", "'low'", "'low'")


def _decided_sql(view: str) -> str:
    return f"SELECT *, {_VERDICT} AS verdict, {_CONFIDENCE} AS confidence FROM (SELECT * EXCLUDE (artist_id), t.artist_id FROM ({_tally_sql(view)}) t JOIN (SELECT * EXCLUDE (artist_id), artist_id AS d_id FROM b_dossier) d ON t.artist_id = d_id)"


_CLAMP = "CAST(greatest(0, least(100, {})) AS BIGINT)"
_SCORE = """CAST(floor(lo + ((CASE confidence WHEN 'high' THEN 0.85::DOUBLE WHEN 'medium' THEN 0.55::DOUBLE ELSE 0.25::DOUBLE END) * 0.7::DOUBLE + (greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (g - r) / greatest(g + r, 1))) + 1) / 2 * 0.3::DOUBLE) * (hi - lo)) AS BIGINT)"""
_RANGES = """SELECT *, strong_green * 2 + green_flags AS g, strong_red * 2 + red_flags AS r, CASE verdict WHEN 'Verified Artist' THEN 82 WHEN 'Likely Authentic' THEN 58 WHEN 'Suspicious' THEN 18 WHEN 'Likely Artificial' THEN 0 ELSE 38 END AS lo,
  CASE verdict WHEN 'Verified Artist' THEN 100 WHEN 'Likely Authentic' THEN 81 WHEN 'Suspicious' THEN 37 WHEN 'Likely Artificial' THEN 17 ELSE 57 END AS hi FROM ({})"""
_CADENCE = "CASE WHEN n_dates < 2 THEN 10 WHEN span_days = 0 THEN 80 WHEN n_dates / greatest(span_days / 30.0::DOUBLE, 1) > 8 THEN 90 WHEN n_dates / greatest(span_days / 30.0::DOUBLE, 1) > 4 THEN 65 WHEN n_dates / greatest(span_days / 30.0::DOUBLE, 1) > 2 THEN 35 ELSE 5 END"
_LENGTHS = "CASE WHEN n_dur < 3 THEN 20 ELSE CASE WHEN avg_s < 90 THEN 40 WHEN avg_s < 120 THEN 20 ELSE 0 END + CASE WHEN sd_s < 10 AND n_dur >= 5 THEN 35 WHEN sd_s < 20 THEN 15 ELSE 0 END END"
CATEGORY_SQL = f"""SELECT *, {_CLAMP.format('''CASE WHEN on_deezer THEN 5 ELSE -5 END + CASE WHEN youtube_found THEN 5 ELSE -5 END + CASE WHEN wikipedia_found AND wiki_length >= 30000 THEN 30 WHEN wikipedia_found THEN 15 WHEN err_wikipedia THEN 0 ELSE -5 END + CASE WHEN genius_found THEN 5 WHEN err_genius THEN 0 ELSE -5 END + CASE WHEN n_social_urls >= 4 THEN 30 WHEN n_social_urls >= 2 THEN 15 ELSE 0 END
      + CASE (wikipedia_found AND wiki_length > 0)::INT + (bio_len >= 50)::INT + (genius_found AND genius_followers > 0)::INT WHEN 3 THEN 30 WHEN 0 THEN -30 ELSE 15 END + CASE WHEN realname THEN 15 ELSE 0 END + CASE WHEN mb_bandcamp THEN 5 ELSE 0 END''')} AS platform_presence,
    {_CLAMP.format('''CASE WHEN lastfm_found THEN 15 + CASE WHEN lastfm_listeners >= 100000 THEN 30 WHEN lastfm_listeners >= 10000 THEN 15 ELSE 0 END + CASE WHEN lastfm_ratio >= 2 AND lastfm_ratio <= 30 THEN 15 WHEN lastfm_ratio > 0 THEN -5 ELSE 0 END WHEN err_lastfm THEN 0 WHEN fans = 0 THEN -30 ELSE -15 END + CASE WHEN fans >= 100 THEN 15 WHEN fans > 0 THEN 5 WHEN lastfm_listeners >= 10000 THEN -15 ELSE 0 END''')} AS fan_engagement,
    {_CLAMP.format('''CASE album_rank WHEN 0 THEN 0 WHEN 1 THEN 15 ELSE 30 END + CASE WHEN short_ THEN -30 WHEN normal_length THEN 5 ELSE 0 END - CASE WHEN cookie THEN 15 ELSE 0 END - CASE farm_rank WHEN 3 THEN 30 WHEN 0 THEN 0 ELSE 15 END - CASE WHEN empty_ THEN 30 ELSE 0 END + CASE WHEN collaborates THEN 15 ELSE 0 END
      + CASE WHEN genius_found AND genius_songs >= 1 THEN 5 ELSE 0 END - CASE stuffing WHEN 3 THEN 30 WHEN 2 THEN 15 WHEN 1 THEN 5 ELSE 0 END - CASE WHEN same_day THEN 15 ELSE 0 END''')} AS creative_history,
    {_CLAMP.format('''CASE WHEN shows >= 10 THEN 30 WHEN shows >= 1 THEN 15 WHEN past_events >= 10 THEN 30 WHEN past_events >= 1 THEN 15 ELSE 0 END + CASE WHEN discogs_physical >= 5 THEN 45 WHEN discogs_physical >= 1 THEN 30 ELSE 0 END
      - CASE WHEN shows < 1 AND past_events < 1 AND discogs_physical < 1 THEN 15 * (NOT (err_setlistfm AND err_songkick))::INT + 15 * (NOT err_discogs)::INT WHEN shows < 1 AND past_events < 1 THEN 15 * (NOT (err_setlistfm AND err_songkick))::INT WHEN discogs_physical < 1 THEN 15 * (NOT err_discogs)::INT ELSE 0 END''')} AS irl_presence,
    {_CLAMP.format('''CASE WHEN musicbrainz_found THEN 5 + CASE WHEN mb_relations >= 10 THEN 30 WHEN mb_relations >= 3 THEN 15 ELSE -5 END + CASE WHEN mb_type AND mb_country AND mb_begin THEN 15 ELSE 0 END WHEN err_musicbrainz THEN 0 ELSE -15 END + CASE WHEN n_isnis > 0 THEN 30 ELSE 0 END + CASE WHEN n_ipis > 0 THEN 30 ELSE 0 END
      + CASE WHEN pro_checked AND pro_registered THEN 30 + 5 * (pro_share >= 30)::INT - 15 * pro_zero::INT - 30 * pro_pfc::INT WHEN pro_checked THEN -5 ELSE 0 END - CASE WHEN n_isnis = 0 AND n_ipis = 0 AND NOT pro_registered THEN 5 ELSE 0 END''')} AS industry_signals, {_CLAMP.format("100 - listed")} AS blocklist_status FROM ({_decided_sql("b_final")})"""
_UNDONE = "verdict IN ('Suspicious', 'Likely Artificial') AND fans >= 1000 AND platform_presence = 0 AND fan_engagement = 0 AND irl_presence = 0 AND industry_signals = 0 AND blocklist_status = 100"
EVALUATED_SQL = f"SELECT * REPLACE (CASE WHEN {_UNDONE} THEN 'Inconclusive' ELSE verdict END AS verdict, CASE WHEN {_UNDONE} THEN 'low' ELSE confidence END AS confidence) FROM ({CATEGORY_SQL})"
_THREAT = f"CASE WHEN verdict NOT IN ('Suspicious', 'Likely Artificial') THEN NULL WHEN t_pfc AND t_ai THEN 1.5 WHEN t_ai THEN 2 WHEN t_pfc THEN 1 WHEN pattern AND {_CADENCE} >= 65 AND {_LENGTHS} >= 50 THEN 3 ELSE 1 END"
b.SQL["b_evaluated"] = f"SELECT *, CAST({_THREAT} AS DOUBLE) AS threat, {_SCORE} AS score FROM ({_RANGES.format(EVALUATED_SQL)})"

_FOUND = "SELECT artist_id, seq, evidence_type, strength, finding, source, array_to_string(tags, ',') AS tags FROM ({})"


def _flat(rows):
    return rows.select("artist_id", "seq", "evidence_type", "strength", "finding", "source", F.array_join("tags", ",").alias("tags"))


def _collector(name: str) -> None:
    @query(_FOUND.format(collected_sql("b_dossier", name)), name=f"evidence_{name}")
    def one(spark, d):
        return _flat(collect(dossiers(spark, d), name))


for _name in dict.fromkeys(r.collector for r in RULES):
    _collector(_name)


@query(_FOUND.format("SELECT * FROM b_found"))
def collected_evidence(spark, d):
    """The findings of all collectors."""
    return _flat(collect(dossiers(spark, d)))


@query(_FOUND.format(collected_sql("b_dossier", "catalog")))
def catalog_evidence(spark, d):
    return _flat(collect(dossiers(spark, d), "catalog"))


@query("""WITH r AS (SELECT *, greatest(span_days / 30.0::DOUBLE, 1) / 12 AS y FROM b_dossier WHERE n_dates >= 2)
  SELECT artist_id, concat_ws(';', CASE WHEN span_days = 0 THEN 'strong one day' END, CASE WHEN span_days > 0 AND albums / y > 24 THEN 'strong albums' WHEN span_days > 0 AND albums / y > 12 AND albums >= 3 THEN 'moderate albums' END, CASE WHEN span_days > 0 AND singles / y > 72 THEN 'strong singles' WHEN span_days > 0 AND singles / y > 36 AND singles >= 5 THEN 'moderate singles' END,
    CASE WHEN span_days > 0 AND albums >= 2 AND singles / albums > 10 THEN 'weak ratio' END, CASE WHEN span_days > 0 AND albums + singles > 0 AND (albums + singles) / y <= 18 AND n_dates >= 5 THEN 'weak steady' END) AS findings FROM r WHERE albums + singles > 0 OR span_days = 0""")
def release_evidence(spark, d):
    """The findings on the pace of releases in one line, in the order of the rules."""
    rows = dossiers(spark, d)
    said = {"on one day": "one day", "albums, ": "albums", "singles, ": "singles", "to an album": "ratio", "steady": "steady"}
    short = F
    for part, name in said.items():
        short = short.when(F.col("finding").contains(part), name)
    found = collect(rows, "releases").groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", "strength", short).alias("said")))).alias("items"))
    asked = rows.where("n_dates >= 2 AND (albums + singles > 0 OR span_days = 0)").select("artist_id")
    return asked.join(found, "artist_id", "left").select("artist_id", F.coalesce(F.array_join(F.col("items.said"), ";"), F.lit("")).alias("findings"))


@query(f"SELECT artist_id, strong_red, moderate_red, weak_red, strong_green, moderate_green, weak_green, CAST(red_total AS BIGINT) AS red_total, CAST(green_total AS BIGINT) AS green_total FROM ({_tally_sql('b_pass1')})")
def evidence_tallies(spark, d):
    rows = tallies(gathered(collect(dossiers(spark, d))))
    names = [f"{st}_{k}" for k in ("red", "green") for st in ("strong", "moderate", "weak")] + ["red_total", "green_total"]
    return rows.select("artist_id", *[F.col(c).cast("long").alias(c) for c in names])


@query("SELECT artist_id, first_seq, evidence_type AS kind, strength, finding FROM b_kept")
def evidence_dedup(spark, d):
    """Both passes: equal findings, then the fold by tags."""
    return deduplicate(collect(dossiers(spark, d))).select("artist_id", F.inline("items")).select("artist_id", "first_seq", "kind", "strength", "finding")


@query("SELECT artist_id, evidence_type AS kind, strength, finding, source FROM b_final")
def blocklist_consolidation(spark, d):
    return consolidate(deduplicate(collect(dossiers(spark, d)))).select("artist_id", F.inline("items")).select("artist_id", "kind", "strength", "finding", "source")


def _decided(spark, d):
    rows = dossiers(spark, d)
    return decide(tallies(consolidate(deduplicate(collect(rows)))).join(rows.select("artist_id", "platforms"), "artist_id"))


@query(f"SELECT artist_id, verdict, confidence FROM ({_decided_sql('b_final')})")
def decision_tree(spark, d):
    return _decided(spark, d).select("artist_id", "verdict", "confidence")


@query(f"SELECT artist_id, verdict, {_SCORE} AS score FROM ({_RANGES.format(_decided_sql('b_final'))})", name="verdict_score")
def verdict_scores(spark, d):
    return verdict_score(_decided(spark, d)).select("artist_id", "verdict", "score")


@query(f"SELECT artist_id, CAST({_THREAT} AS DOUBLE) AS threat FROM ({_decided_sql('b_final')})", name="threat_category")
def threat_categories(spark, d):
    quick = e.quick_columns()
    signals = dossiers(spark, d).select("artist_id", quick["cadence"].alias("cadence"), quick["durations"].alias("durations"))
    return threat_category(_decided(spark, d).join(signals, "artist_id")).select("artist_id", "threat")


@query(f"SELECT artist_id, {', '.join(e.CATEGORIES)} FROM ({CATEGORY_SQL})")
def category_scores(spark, d):
    rows = dossiers(spark, d)
    scored = e.category_scores(tallies(consolidate(deduplicate(collect(rows)))).join(rows.drop("seeds"), "artist_id"))
    return scored.select("artist_id", *[F.col(c).cast("long").alias(c) for c in e.CATEGORIES])


@query(f"SELECT artist_id, verdict, confidence FROM ({EVALUATED_SQL})")
def sanity_override(spark, d):
    return e.evaluate(dossiers(spark, d)).select("artist_id", "verdict", "confidence")


@query("SELECT artist_id, verdict, confidence, score, threat FROM b_evaluated")
def evaluation(spark, d):
    """The whole chain: findings, deduplication, consolidation, verdict, categories, sanity, score, threat."""
    return e.evaluate(dossiers(spark, d)).select("artist_id", "verdict", "confidence", "score", "threat")


@query("""SELECT artist_id, CASE verdict WHEN 'Verified Artist' THEN name || ' looks real and established.' || CASE WHEN platforms >= 5 THEN ' On ' || platforms || ' platforms.' ELSE '' END || CASE WHEN fans >= 100000 THEN ' ' || fans || ' fans.' ELSE '' END || CASE WHEN green_flags >= 10 THEN ' ' || green_flags || ' positive signals.' ELSE '' END
    WHEN 'Likely Authentic' THEN name || ' looks legitimate.' || CASE WHEN platforms >= 3 THEN ' On ' || platforms || ' platforms.' ELSE '' END || ' ' || green_flags || ' green and ' || red_flags || ' red flags.' WHEN 'Insufficient Data' THEN 'Too little is known of ' || name || ': ' || (green_flags + red_flags) || ' signals.'
    WHEN 'Conflicting Signals' THEN 'The signals on ' || name || ' conflict: ' || green_flags || ' positive, ' || red_flags || ' negative.' WHEN 'Inconclusive' THEN 'No confident judgement of ' || name || ': ' || green_flags || ' positive, ' || red_flags || ' negative.'
    WHEN 'Suspicious' THEN name || ' shows warning signs.' || CASE WHEN strong_red > 0 THEN ' ' || strong_red || ' strong red flags.' ELSE '' END || CASE WHEN platforms <= 2 THEN ' On ' || platforms || ' platforms alone.' ELSE '' END
    ELSE name || ' looks manufactured.' || CASE WHEN strong_red >= 3 THEN ' ' || strong_red || ' strong red flags.' ELSE '' END || CASE WHEN pfc_label OR farm_rank > 0 THEN ' Releases and label fit a content farm.' ELSE '' END END AS explanation FROM b_evaluated""")
def verdict_explanation(spark, d):
    return e.evaluate(dossiers(spark, d)).select("artist_id", e.explanation().alias("explanation"))


_AXIS_SQL = "CASE " + " ".join(f"WHEN contains(lower(source), '{part}') THEN '{name}'" for part, name in e.AXIS_SOURCES) + " ELSE 'Platform Presence' END"
_TAG_AXIS = " UNION ALL ".join(f"SELECT unnest({list(tags)}) AS tag, '{name}' AS axis" for name, tags in e.AXIS_TAGS.items())
_BY_AXIS = f"""WITH x AS ({_TAG_AXIS}), r AS (SELECT *, row_number() OVER () AS id FROM b_final), t AS (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM r), f AS (SELECT id, arg_min(x.axis, place) AS axis FROM t JOIN x ON t.tag = x.tag GROUP BY 1), a AS (SELECT r.*, coalesce(f.axis, {_AXIS_SQL}) AS axis FROM r LEFT JOIN f ON r.id = f.id)"""


@query(f"{_BY_AXIS} SELECT artist_id, axis, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2")
def axis_classification(spark, d):
    found = consolidate(deduplicate(collect(dossiers(spark, d)))).select("artist_id", F.inline("items"))
    return found.groupBy("artist_id", e.axis(F.col("tags"), F.col("source")).alias("axis")).agg(F.count("*").alias("n"))


_DATA_SQL = """SELECT artist_id, 'Platform Presence' AS axis, unnest([platforms >= 4, wikipedia_found, youtube_found, genius_verified, bio_len >= 200]) AS green, unnest([platforms <= 1, false, false, false, false]) AS red FROM b_dossier UNION ALL SELECT artist_id, 'Fan Engagement', unnest([fans >= 10000, lastfm_listeners >= 1000]), unnest([fans = 0, false]) FROM b_dossier
  UNION ALL SELECT artist_id, 'Creative History', genius_songs >= 5, false FROM b_dossier UNION ALL SELECT artist_id, 'IRL Presence', unnest([shows > 0, past_events > 0, discogs_physical > 0]), false FROM b_dossier UNION ALL SELECT artist_id, 'Industry Signals', unnest([n_isnis > 0, n_ipis > 0, pro_checked AND pro_registered, realname]), unnest([pro_checked AND NOT pro_registered, false, false, false]) FROM b_dossier"""


@query(f"""{_BY_AXIS}, s AS (SELECT artist_id, axis, evidence_type = 'green_flag' AS green, evidence_type = 'red_flag' AS red FROM a WHERE strength <> 'weak' UNION ALL SELECT * FROM ({_DATA_SQL})), c AS (SELECT artist_id, axis, count(*) FILTER (green) AS g, count(*) FILTER (red) AS r FROM s GROUP BY 1, 2)
  SELECT d.artist_id, d.axis, CAST(coalesce(g, 0) AS BIGINT) AS n_green, CAST(coalesce(r, 0) AS BIGINT) AS n_red, coalesce(g, 0) + coalesce(r, 0) < 2 AS padded FROM (SELECT artist_id, unnest({list(e.AXIS_TAGS)}) AS axis FROM b_dossier) d LEFT JOIN c ON d.artist_id = c.artist_id AND d.axis = c.axis""")
def axis_buckets(spark, d):
    return e.axis_buckets(dossiers(spark, d))


QUICK_SQL = f"""SELECT *, CAST(CASE WHEN listeners > 0 THEN CASE WHEN followers = 0 THEN 90 WHEN followers / listeners < 0.001 THEN 90 WHEN followers / listeners < 0.005 THEN 70 WHEN followers / listeners < 0.01 THEN 45 WHEN followers / listeners < 0.03 THEN 25 ELSE 5 END
    WHEN followers = 0 AND popularity > 20 THEN 90 WHEN followers = 0 THEN 60 WHEN popularity / followers > 1 THEN least(90.0, 50 + 10 * popularity / followers) WHEN popularity / followers > 0.1 THEN 30 ELSE 5 END AS DOUBLE) AS follower_ratio, CASE n_genres WHEN 0 THEN 70 WHEN 1 THEN 20 ELSE 0 END AS genre_absence,
  CASE WHEN image_width = 0 THEN 80 WHEN image_width < 300 THEN 40 ELSE 0 END AS image_quality, CASE n_urls WHEN 0 THEN 50 ELSE 0 END AS external_urls, CASE WHEN albums = 0 AND singles = 0 THEN 60 WHEN albums = 0 AND singles > 20 THEN 70 WHEN albums = 0 AND singles <= 5 THEN 30 WHEN singles > 50 AND albums < 2 THEN 75 ELSE 5 END AS catalog_size,
  {_LENGTHS} AS durations, {_CADENCE} AS cadence, CASE WHEN popularity >= 40 AND followers < 500 THEN 80 WHEN popularity >= 30 AND followers < 200 THEN 70 WHEN popularity >= 20 AND followers < 50 THEN 60 ELSE 5 END AS placement,
  CASE WHEN n_pops = 0 THEN 20 WHEN max_pop > 50 AND followers < 300 THEN 80 WHEN avg_pop > 30 AND followers < 500 THEN 55 ELSE 5 END AS popularity_mismatch, CASE WHEN name_ai THEN 100 ELSE CASE WHEN length(trim(name)) <= 3 THEN 15 ELSE 0 END END AS name_points FROM b_dossier"""
_QUICK_SCORE = "CAST(greatest(0, least(100, round((0.15::DOUBLE * follower_ratio + 0.1::DOUBLE * genre_absence + 0.05::DOUBLE * image_quality + 0.1::DOUBLE * external_urls + 0.1::DOUBLE * catalog_size + 0.1::DOUBLE * durations + 0.15::DOUBLE * cadence + 0.1::DOUBLE * placement + 0.1::DOUBLE * popularity_mismatch + 0.05::DOUBLE * name_points) / 1.0::DOUBLE))) AS BIGINT)"
_SIGNALS = "follower_ratio, genre_absence, image_quality, external_urls, catalog_size, durations, cadence, placement, popularity_mismatch, name_points"


@query(f"SELECT artist_id, {_SIGNALS} FROM ({QUICK_SQL})")
def quick_signals(spark, d):
    return dossiers(spark, d).select("artist_id", *[v.alias(k) for k, v in e.quick_columns().items()])


def _quick_score():
    return s.weighted(e.quick_columns(), s.QUICK_WEIGHTS)


@query(f"SELECT artist_id, {_QUICK_SCORE} AS score FROM ({QUICK_SQL})")
def quick_score(spark, d):
    return dossiers(spark, d).select("artist_id", _quick_score().alias("score"))


STANDARD_SQL = f"""SELECT artist_id, {_QUICK_SCORE} AS quick, CASE WHEN NOT genius_found THEN 75 WHEN genius_songs = 0 THEN 80 WHEN genius_songs <= 3 THEN 50 WHEN genius_songs <= 10 THEN 25 ELSE 5 END AS genius, CASE WHEN NOT discogs_found THEN 70 WHEN discogs_total = 0 THEN 75 WHEN discogs_physical = 0 THEN CASE WHEN discogs_digital > 0 THEN 55 ELSE 65 END WHEN discogs_physical >= 5 THEN 0 WHEN discogs_physical >= 2 THEN 10 ELSE 25 END AS discogs,
  CASE WHEN shows = 0 THEN 80 WHEN shows <= 5 THEN 40 WHEN shows <= 20 THEN 15 ELSE 0 END AS live, CASE WHEN NOT musicbrainz_found THEN 70 ELSE 30 - 10 * mb_type::INT - 5 * mb_country::INT - 10 * mb_begin::INT END AS registry, CASE WHEN n_mb_labels = 0 THEN 30 WHEN n_mb_pfc > 0 THEN 90 ELSE 5 END AS label, CASE WHEN fans = 0 THEN 60 WHEN fans < 100 THEN 40 WHEN fans < 1000 THEN 20 ELSE 5 END AS fan_points FROM ({QUICK_SQL})"""
_STANDARD_SCORE = "CAST(greatest(0, least(100, round((0.4::DOUBLE * quick + 0.12::DOUBLE * genius + 0.12::DOUBLE * discogs + 0.12::DOUBLE * live + 0.08::DOUBLE * registry + 0.1::DOUBLE * label + 0.06::DOUBLE * fan_points) / 1.0::DOUBLE))) AS BIGINT)"


def _standard_score():
    return s.weighted(e.standard_columns(F.col("quick")), s.STANDARD_WEIGHTS)


@query(f"SELECT artist_id, genius, discogs, live, registry, label, fan_points FROM ({STANDARD_SQL})")
def standard_signals(spark, d):
    columns = e.standard_columns(F.lit(0))
    return dossiers(spark, d).select("artist_id", *[columns[k].alias(k) for k in ("genius", "discogs", "live", "registry", "label")], columns["fans"].alias("fan_points"))


@query(f"SELECT artist_id, {_STANDARD_SCORE} AS score FROM ({STANDARD_SQL})")
def standard_score(spark, d):
    return dossiers(spark, d).withColumn("quick", _quick_score()).select("artist_id", _standard_score().alias("score"))


@query(f"SELECT s.artist_id, CASE WHEN s.artist_id % 5 = 0 THEN NULL ELSE score END AS evaluated, CAST(CASE WHEN s.artist_id % 5 <> 0 THEN score WHEN s.artist_id % 10 = 0 THEN 100 - {_STANDARD_SCORE} ELSE 100 - quick END AS BIGINT) AS final FROM ({STANDARD_SQL}) s JOIN b_evaluated e ON s.artist_id = e.artist_id")
def finalize_report(spark, d):
    """The score of the evaluation, or where there is none (every fifth here) what the highest tier leaves."""
    rows = dossiers(spark, d).withColumn("quick", _quick_score())
    scores = e.evaluate(dossiers(spark, d)).select("artist_id", F.when(F.col("artist_id") % 5 != 0, F.col("score")).alias("evaluated"))
    rows = rows.select("artist_id", "quick", F.when(F.col("artist_id") % 10 == 0, _standard_score()).alias("standard")).join(scores, "artist_id")
    return rows.select("artist_id", "evaluated", e.final_score(F.col("evaluated"), F.lit(None).cast("long"), F.col("standard"), F.col("quick")).alias("final"))


@query("SELECT artist_id, name_ai OR db_status = 'confirmed_bad' AS stop, CASE WHEN name_ai OR db_status = 'confirmed_bad' THEN 'Likely Artificial' END AS pre_verdict FROM b_dossier")
def pre_check(spark, d):
    return e.pre_check(dossiers(spark, d)).select("artist_id", "stop", "pre_verdict")


_SEEDS_SQL = "SELECT artist_id, unnest(['cleared before', 'suspected before', 'listed label', 'listed songwriter']) AS finding, unnest(['green_flag', 'red_flag', 'red_flag', 'red_flag']) AS evidence_type, unnest(['moderate', 'moderate', 'strong', 'strong']) AS strength, unnest(['entity_cleared', 'entity_suspected', 'pfc_label', 'pfc_songwriter']) AS tag, unnest([db_status = 'cleared', db_status = 'suspected', n_pfc_labels > 0, n_pfc_writers > 0]) AS fires FROM b_dossier WHERE NOT (name_ai OR db_status = 'confirmed_bad')"


@query(f"SELECT artist_id, finding, evidence_type, strength, tag FROM ({_SEEDS_SQL}) WHERE fires")
def pre_check_seeds(spark, d):
    return e.seeds(dossiers(spark, d))


@query(f"WITH r AS (SELECT DISTINCT artist_id FROM ({_SEEDS_SQL}) WHERE fires AND evidence_type = 'red_flag') SELECT d.artist_id, r.artist_id IS NOT NULL AS ask_ai, r.artist_id IS NOT NULL AS ask_youtube, r.artist_id IS NOT NULL AS ask_pro FROM b_dossier d LEFT JOIN r ON d.artist_id = r.artist_id")
def conditional_enrichment(spark, d):
    return e.further_lookups(dossiers(spark, d))


@query("SELECT artist_id, followers >= 500000 AND has_wiki_url AND n_genres >= 3 AND albums >= 5 AND NOT name_ai AND n_pfc_labels = 0 AS legitimate, CASE WHEN followers >= 500000 AND has_wiki_url AND n_genres >= 3 AND albums >= 5 AND NOT name_ai AND n_pfc_labels = 0 THEN 'Verified Artist' END AS verdict FROM b_dossier")
def fast_mode(spark, d):
    fast = e.legitimate()
    return dossiers(spark, d).select("artist_id", fast.alias("legitimate"), F.when(fast, "Verified Artist").alias("verdict"))


@query()
def timeout_fallback(spark, d):
    """Verdicts where every lookup has timed out; a test holds them against evaluate() of such dossiers."""
    return e.evaluate(e.timed_out(dossiers(spark, d))).select("artist_id", "verdict", "confidence", "score")


@query()
def deep_reevaluation(spark, d):
    """Every tenth artist gets two strong green findings of the deep tier; a test holds it against a plain loop."""
    rows = dossiers(spark, d)
    said = F.explode(F.array(F.lit("consistent biography"), F.lit("photographs on stage")))
    deep = rows.where("artist_id % 10 = 0").select("artist_id", said.alias("finding")).select("artist_id", F.lit(0).alias("seq"), F.lit("green_flag").alias("evidence_type"), F.lit("strong").alias("strength"), "finding", F.lit("Deep tier").alias("source"), F.array(F.lit("authentic_bio")).alias("tags"))
    return e.reevaluate(rows, deep).select("artist_id", "verdict", "confidence", "score")


@query("SELECT artist_id, verdict, score, CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'Likely Artificial' THEN 0 WHEN 'Suspicious' THEN 1 WHEN 'Likely Authentic' THEN 3 WHEN 'Verified Artist' THEN 4 ELSE 2 END, -score, artist_id) AS BIGINT) AS place FROM b_evaluated")
def severity_sort(spark, d):
    """All artists of the report in its order, the most concerning first."""
    rows = e.evaluate(dossiers(spark, d)).select("artist_id", "verdict", "score")
    return numbered(rows, [lookup(e.SEVERITY, F.col("verdict")), -F.col("score"), F.col("artist_id")]).withColumn("place", F.col("place").cast("long"))
