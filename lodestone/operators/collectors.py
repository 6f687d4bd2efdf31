"""The evidence collectors: ordered rules over a dossier's measures, each giving one finding where its condition holds.

Conditions, strengths and findings are SQL expressions over the columns of sources.dossier.MEASURES, so that Catalyst sees
them; no row leaves the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rules import STRENGTH_RANK, lookup

R, G, N = "red_flag", "green_flag", "neutral"
STRONG, MODERATE, WEAK = "'strong'", "'moderate'", "'weak'"
#: Rules of one array; longer ones make generated code too large.
GROUP = 20


class Rule(NamedTuple):
    collector: str
    condition: str
    kind: str
    strength: str
    source: str
    finding: str
    tags: tuple[str, ...] = ()


def _missing(platform: str) -> str:
    """How much it says that a platform doesn't know the artist."""
    return f"CASE WHEN had_{platform} THEN 'strong' WHEN name_len BETWEEN 1 AND 3 THEN 'weak' ELSE 'moderate' END"


def _trusted(strength: str, platform: str) -> str:
    """A level less where the match is doubtful."""
    return f"CASE WHEN trusted_{platform} THEN {strength} ELSE {dict(zip((STRONG, MODERATE, WEAK), (MODERATE, WEAK, WEAK), strict=True))[strength]} END"


def _absent(collector: str, platform: str, name: str) -> tuple[Rule, ...]:
    return (
        Rule(collector, f"NOT {platform}_found AND err_{platform}", N, WEAK, name, f"'{name}: not reached, not scored'", ("api_error",)),
        Rule(collector, f"NOT {platform}_found AND NOT err_{platform}", R, _missing(platform), name, f"'not on {name}'", ("not_found",)),
    )


_TYPED = "n_dates >= 2 AND span_days > 0 AND albums + singles > 0"
_UNTYPED = "n_dates >= 2 AND span_days > 0 AND albums + singles = 0"
_GENRES = "CASE WHEN mb_genres > 0 THEN mb_genres ELSE n_genres END"
_RICH = "(CASE WHEN mb_type THEN 1 ELSE 0 END + CASE WHEN mb_country THEN 1 ELSE 0 END + CASE WHEN mb_begin THEN 1 ELSE 0 END + CASE WHEN n_mb_labels > 0 THEN 1 ELSE 0 END)"

# fixed values: thresholds, kinds, strengths, sources and tags
RULES: tuple[Rule, ...] = (
    Rule("platform", "platforms <= 1", R, WEAK, "Cross-platform", "'on one platform at most'", ("single_platform",)),
    Rule("platform", "platforms >= 2", G, "CASE WHEN platforms >= 3 THEN 'strong' ELSE 'moderate' END", "Cross-platform", "concat('on ', platforms, ' platforms')", ("multi_platform",)),
    Rule("followers", "fans >= 100000", G, STRONG, "Deezer", "concat(fans, ' fans')", ("genuine_fans",)),
    Rule("followers", "fans >= 10000 AND fans < 100000", G, MODERATE, "Deezer", "concat(fans, ' fans')", ("genuine_fans",)),
    Rule("followers", "fans >= 1000 AND fans < 10000", N, WEAK, "Deezer", "concat(fans, ' fans')"),
    Rule("followers", "fans > 0 AND fans < 1000", R, WEAK, "Deezer", "concat('only ', fans, ' fans')", ("low_fans",)),
    Rule("followers", "fans <= 0", N, WEAK, "Deezer", "'no fans known'"),
    Rule("catalog", "albums = 0 AND singles = 0", R, MODERATE, "Deezer", "'empty catalog'", ("empty_catalog",)),
    Rule("catalog", "albums >= 3", G, MODERATE, "Deezer", "concat(albums, ' albums')", ("catalog_albums",)),
    Rule("catalog", "albums >= 1 AND albums < 3", G, WEAK, "Deezer", "concat(albums, ' album(s)')", ("catalog_albums",)),
    Rule("catalog", "albums = 0 AND singles > 20", R, STRONG, "Deezer", "concat(singles, ' singles, no album')", ("content_farm",)),
    Rule("durations", "n_dur >= 3 AND avg_s >= 1 AND avg_s < 90", R, STRONG, "Deezer", "'very short tracks'", ("stream_farm",)),
    Rule("durations", "n_dur >= 3 AND avg_s >= 90 AND avg_s < 120", R, MODERATE, "Deezer", "'short tracks'", ("stream_farm",)),
    Rule("durations", "n_dur >= 5 AND avg_s >= 1 AND sd_s < 10 AND NOT genre_exempt", R, MODERATE, "Deezer", "'very uniform track lengths'", ("cookie_cutter",)),
    Rule("durations", "n_dur >= 3 AND avg_s >= 180 AND sd_s >= 30", G, WEAK, "Deezer", "'normal track lengths'"),
    Rule("releases", "n_dates >= 2 AND span_days = 0", R, STRONG, "Deezer", "concat(n_dates, ' releases on one day')", ("high_release_rate", "same_day_release", "content_farm")),
    Rule("releases", f"{_TYPED} AND albums / years > 24", R, STRONG, "Deezer", "concat(albums, ' albums, extreme pace')", ("high_release_rate",)),
    Rule("releases", f"{_TYPED} AND albums / years > 12 AND albums / years <= 24 AND albums >= 3", R, MODERATE, "Deezer", "concat(albums, ' albums, high pace')", ("high_release_rate",)),
    Rule("releases", f"{_TYPED} AND singles / years > 72", R, STRONG, "Deezer", "concat(singles, ' singles, extreme pace')", ("high_release_rate",)),
    Rule("releases", f"{_TYPED} AND singles / years > 36 AND singles / years <= 72 AND singles >= 5", R, MODERATE, "Deezer", "concat(singles, ' singles, high pace')", ("high_release_rate",)),
    Rule("releases", f"{_TYPED} AND albums >= 2 AND singles > 10 * albums", R, WEAK, "Deezer", "'many singles to an album'", ("high_release_rate",)),
    Rule("releases", f"{_TYPED} AND (albums + singles) / years <= 18 AND n_dates >= 5", G, WEAK, "Deezer", "'steady pace'"),
    Rule("releases", f"{_UNTYPED} AND n_dates / years > 96", R, STRONG, "Deezer", "concat(n_dates, ' releases, extreme pace')", ("high_release_rate",)),
    Rule("releases", f"{_UNTYPED} AND n_dates / years > 48 AND n_dates / years <= 96", R, MODERATE, "Deezer", "concat(n_dates, ' releases, high pace')", ("high_release_rate",)),
    Rule("releases", f"{_UNTYPED} AND n_dates / years <= 12 AND n_dates >= 5", G, WEAK, "Deezer", "'steady pace'"),
    Rule("labels", "n_pfc_labels > 0", R, STRONG, "Blocklist", "'label on the distributor blocklist'", ("pfc_label",)),
    Rule("labels", "n_ai_labels > 0", R, STRONG, "Blocklist", "'label on the AI blocklist'", ("known_ai_label",)),
    Rule("labels", "n_labels > 0 AND n_pfc_labels = 0 AND n_ai_labels = 0", N, WEAK, "Deezer", "concat(n_labels, ' labels')"),
    Rule("name", "name_ai", R, STRONG, "Blocklist", "'name on the AI blocklist'", ("known_ai_artist",)),
    Rule("name", "NOT name_ai AND name_generic", N, WEAK, "Name analysis", "'generic name of two words'", ("generic_name",)),
    Rule("collaboration", "n_flagged > 0", R, "CASE WHEN 2 * n_flagged >= n_assoc THEN 'moderate' ELSE 'weak' END", "collaboration_check", "concat('works with ', n_flagged, ' flagged')", ("pfc_network",)),
    Rule("collaboration", "n_flagged = 0 AND n_contrib >= 3", G, MODERATE, "Deezer", "concat(n_contrib, ' collaborators')", ("collaboration",)),
    Rule("collaboration", "n_flagged = 0 AND n_contrib >= 1 AND n_contrib < 3", G, WEAK, "Deezer", "concat(n_contrib, ' collaborator(s)')", ("collaboration",)),
    Rule("collaboration", "n_related_clean >= 5", G, WEAK, "Deezer", "concat(n_related_clean, ' clean related artists')"),
    Rule("collaboration", "n_related_clean >= 1 AND n_related_clean < 5", N, WEAK, "Deezer", "concat(n_related_clean, ' related artist(s)')"),
    Rule("credits", "has_watchlist AND n_pfc_writers > 0", R, STRONG, "Credit network", "concat(n_pfc_writers, ' listed songwriters')", ("pfc_songwriter",)),
    Rule("credits", "has_watchlist AND n_producers = 1 AND n_titles >= 5 AND NOT self_produced", R, WEAK, "Credit network", "'one producer for all tracks'"),
    Rule("genres", f"{_GENRES} = 0 AND musicbrainz_found", R, WEAK, "MusicBrainz", "'no genres'", ("no_genres",)),
    Rule("genres", "mb_genres >= 3", G, WEAK, "MusicBrainz", "concat(mb_genres, ' genres')"),
    Rule("genres", "mb_genres = 0 AND n_genres >= 3", G, WEAK, "Deezer", "concat(n_genres, ' genres')"),
    Rule("ranks", "n_ranks >= 4 AND rank_total > 0 AND top2_share >= 0.9", R, STRONG, "Deezer", "'two tracks hold nine tenths'", ("playlist_stuffing",)),
    Rule("ranks", "n_ranks >= 4 AND rank_total > 0 AND top2_share >= 0.8 AND top2_share < 0.9", R, MODERATE, "Deezer", "'two tracks hold eight tenths'", ("playlist_stuffing",)),
    Rule("ranks", "n_ranks >= 4 AND rank_total > 0 AND top2_share >= 0.7 AND top2_share < 0.8", R, WEAK, "Deezer", "'two tracks hold seven tenths'", ("playlist_stuffing",)),
    Rule("ranks", "n_ranks > 0 AND avg_rank >= 500000", G, MODERATE, "Deezer", "'high track ranks'"),
    Rule("ranks", "n_ranks > 0 AND avg_rank >= 100000 AND avg_rank < 500000", G, WEAK, "Deezer", "'moderate track ranks'"),
    *_absent("genius", "genius", "Genius"),
    Rule("genius", "genius_found AND genius_songs >= 20", G, _trusted(STRONG, "genius"), "Genius", "concat(genius_songs, ' songs')", ("genius_credits",)),
    Rule("genius", "genius_found AND genius_songs >= 5 AND genius_songs < 20", G, _trusted(MODERATE, "genius"), "Genius", "concat(genius_songs, ' songs')", ("genius_credits",)),
    Rule("genius", "genius_found AND genius_songs >= 1 AND genius_songs < 5", G, WEAK, "Genius", "concat(genius_songs, ' song(s)')", ("genius_credits",)),
    Rule("genius", "genius_found AND genius_songs < 1", R, MODERATE, "Genius", "'a page without songs'"),
    Rule("genius", "genius_found AND genius_bio", G, WEAK, "Genius", "'Genius biography'"),
    *_absent("discogs", "discogs", "Discogs"),
    Rule("discogs", "discogs_found AND discogs_total = 0", R, WEAK, "Discogs", "'a page without releases'"),
    Rule("discogs", "discogs_found AND discogs_total > 0 AND discogs_physical >= 3", G, _trusted(STRONG, "discogs"), "Discogs", "concat(discogs_physical, ' physical releases')", ("physical_release",)),
    Rule("discogs", "discogs_found AND discogs_total > 0 AND discogs_physical >= 1 AND discogs_physical < 3", G, _trusted(MODERATE, "discogs"), "Discogs", "concat(discogs_physical, ' physical release(s)')", ("physical_release",)),
    Rule("discogs", "discogs_found AND discogs_total > 0 AND discogs_physical = 0 AND discogs_digital > 0", N, WEAK, "Discogs", "'digital releases alone'"),
    Rule("discogs", "discogs_found AND discogs_total > 0 AND n_discogs_pfc > 0", R, STRONG, "Discogs", "'Discogs label on the blocklist'", ("pfc_label",)),
    Rule("discogs", "discogs_found AND discogs_total > 0 AND n_discogs_pfc = 0 AND n_discogs_labels >= 2", G, WEAK, "Discogs", "concat(n_discogs_labels, ' Discogs labels')"),
    Rule("live", "setlistfm_found AND shows >= 10", G, STRONG, "Setlist.fm", "concat(shows, ' concerts')", ("live_performance",)),
    Rule("live", "setlistfm_found AND shows >= 1 AND shows < 10", G, MODERATE, "Setlist.fm", "concat(shows, ' concert(s)')", ("live_performance",)),
    Rule("live", "setlistfm_found AND shows < 1", N, WEAK, "Setlist.fm", "'a page without concerts'"),
    *_absent("live", "setlistfm", "Setlist.fm"),
    Rule("live", "shows = 0 AND NOT setlistfm_found AND past_events = 0 AND NOT songkick_found AND NOT err_setlistfm AND NOT err_songkick", R, MODERATE, "Live shows", "'no concert anywhere'", ("concert_history",)),
    *_absent("musicbrainz", "musicbrainz", "MusicBrainz"),
    Rule("musicbrainz", f"musicbrainz_found AND {_RICH} >= 3", G, MODERATE, "MusicBrainz", "'rich entry'"),
    Rule("musicbrainz", f"musicbrainz_found AND {_RICH} IN (1, 2)", G, WEAK, "MusicBrainz", "'entry'"),
    Rule("musicbrainz", f"musicbrainz_found AND {_RICH} = 0", N, WEAK, "MusicBrainz", "'sparse entry'"),
    Rule("musicbrainz", "musicbrainz_found AND n_mb_pfc > 0", R, STRONG, "MusicBrainz", "'MusicBrainz label on the blocklist'", ("pfc_label",)),
    Rule("social", "n_social >= 4", G, STRONG, "Social media", "concat(n_social, ' presences')", ("social_media",)),
    Rule("social", "n_social >= 2 AND n_social < 4", G, MODERATE, "Social media", "concat(n_social, ' presences')", ("social_media",)),
    Rule("social", "n_social = 1", G, WEAK, "Social media", "'1 presence'", ("social_media",)),
    Rule("social", "n_social = 0 AND CASE WHEN genius_found THEN 1 ELSE 0 END + CASE WHEN discogs_found THEN 1 ELSE 0 END + CASE WHEN musicbrainz_found THEN 1 ELSE 0 END >= 2 AND NOT err_genius AND NOT err_discogs AND NOT err_musicbrainz", R, MODERATE, "Social media", "'no presence'", ("no_social_media",)),
    Rule("social", "genius_verified", G, MODERATE, "Genius", "'verified account'", ("genius_verified",)),
    Rule("social", "genius_followers >= 1000", G, MODERATE, "Genius", "concat(genius_followers, ' followers')"),
    Rule("social", "genius_followers >= 100 AND genius_followers < 1000", G, WEAK, "Genius", "concat(genius_followers, ' followers')"),
    Rule("social", "NOT wikipedia_found AND mb_wikipedia", G, STRONG, "MusicBrainz", "'Wikipedia article linked'", ("wikipedia",)),
    Rule("social", "NOT wikipedia_found AND mb_wikidata", G, WEAK, "MusicBrainz", "'Wikidata entry linked'"),
    Rule("identity", "bio_len >= 200 AND (bio_hits >= 3 OR bio_years >= 2)", G, STRONG, "Discogs", "concat('biography with a career, ', bio_len)", ("career_bio",)),
    Rule("identity", "bio_len >= 200 AND bio_hits < 3 AND bio_years < 2", G, MODERATE, "Discogs", "concat('biography, ', bio_len)", ("career_bio",)),
    Rule("identity", "bio_len >= 50 AND bio_len < 200 AND bio_hits > 0", G, MODERATE, "Discogs", "concat('short biography with a career, ', bio_len)", ("career_bio",)),
    Rule("identity", "bio_len >= 50 AND bio_len < 200 AND bio_hits = 0", G, WEAK, "Discogs", "concat('short biography, ', bio_len)", ("career_bio",)),
    Rule("identity", "realname", G, MODERATE, "Discogs", "'real name known'", ("verified_identity",)),
    Rule("identity", "n_members > 0", G, MODERATE, "Discogs", "concat(n_members, ' members')", ("verified_identity",)),
    Rule("identity", "n_groups > 0", G, WEAK, "Discogs", "concat('in ', n_groups, ' groups')"),
    Rule("identity", "quality_correct", G, WEAK, "Discogs", "'data rated correct'"),
    Rule("identity", "n_isnis > 0", G, STRONG, "MusicBrainz", "'ISNI'", ("industry_registered",)),
    Rule("identity", "n_ipis > 0", G, STRONG, "MusicBrainz", "'IPI'", ("industry_registered",)),
    Rule("identity", "has_gender", N, WEAK, "MusicBrainz", "'gender known'"),
    Rule("identity", "mb_genres > 0", G, WEAK, "MusicBrainz", "concat(mb_genres, ' MusicBrainz genres')"),
    Rule("identity", "n_aliases >= 3", G, MODERATE, "Multiple", "concat(n_aliases, ' aliases')"),
    Rule("identity", "n_aliases >= 1 AND n_aliases < 3", G, WEAK, "Multiple", "concat(n_aliases, ' alias(es)')"),
    *_absent("lastfm", "lastfm", "Last.fm"),
    Rule("lastfm", "lastfm_found AND lastfm_listeners >= 50 AND lastfm_ratio >= 4", G, "CASE WHEN lastfm_ratio >= 10 THEN 'strong' ELSE 'moderate' END", "Last.fm", "concat(lastfm_listeners, ' devoted listeners')", ("genuine_fans",)),
    Rule("lastfm", "lastfm_found AND lastfm_listeners >= 50 AND lastfm_ratio < 4", G, "CASE WHEN lastfm_listeners >= 100 THEN 'moderate' ELSE 'weak' END", "Last.fm", "concat(lastfm_listeners, ' listeners')"),
    Rule("lastfm", "lastfm_found AND lastfm_listeners >= 100 AND lastfm_ratio > 0 AND lastfm_ratio < 2", R, MODERATE, "Last.fm", "'few plays a listener'", ("low_scrobble_engagement",)),
    Rule("lastfm", "lastfm_found AND lastfm_listeners > 0 AND lastfm_listeners < 50", R, WEAK, "Last.fm", "concat(lastfm_listeners, ' listeners alone')"),
    Rule("lastfm", "lastfm_found AND lastfm_bio", G, WEAK, "Last.fm", "'Last.fm biography'"),
    Rule("wikipedia", "wikipedia_found AND (wiki_length >= 5000 OR wiki_views >= 1000)", G, STRONG, "Wikipedia", "concat('article of ', wiki_length)", ("wikipedia",)),
    Rule("wikipedia", "wikipedia_found AND wiki_length > 0 AND wiki_length < 5000 AND wiki_views < 1000", G, MODERATE, "Wikipedia", "concat('short article of ', wiki_length)", ("wikipedia",)),
    Rule("wikipedia", "wikipedia_found AND wiki_views >= 50000", G, STRONG, "Wikipedia", "concat(wiki_views, ' views a month')", ("genuine_fans", "wikipedia")),
    Rule("wikipedia", "wikipedia_found AND wiki_music", G, WEAK, "Wikipedia", "'described as a musician'", ("verified_identity",)),
    Rule("songkick", "songkick_found AND past_events >= 100", G, STRONG, "Songkick", "concat(past_events, ' events')", ("live_performance",)),
    Rule("songkick", "songkick_found AND past_events >= 20 AND past_events < 100", G, MODERATE, "Songkick", "concat(past_events, ' events')", ("live_performance",)),
    Rule("songkick", "songkick_found AND past_events >= 1 AND past_events < 20", G, WEAK, "Songkick", "concat(past_events, ' event(s)')", ("live_performance",)),
    Rule("songkick", "songkick_found AND on_tour", G, MODERATE, "Songkick", "'on tour'", ("live_performance",)),
    Rule("songkick", "songkick_found AND n_festivals >= 3", G, MODERATE, "Songkick", "concat(n_festivals, ' festivals')", ("live_performance",)),
    Rule("deezer_ai", "ai_checked AND n_ai_albums > 0", R, STRONG, "Deezer AI Detection", "concat(n_ai_albums, ' albums marked as AI')", ("ai_generated_music",)),
    Rule("deezer_ai", "ai_checked AND n_ai_albums = 0", G, WEAK, "Deezer AI Detection", "'no AI marks'", ("deezer_ai_clear",)),
    Rule("youtube", "youtube_checked AND youtube_found AND subscribers >= 100000", G, STRONG, "YouTube", "concat(subscribers, ' subscribers')", ("youtube_presence", "genuine_fans")),
    Rule("youtube", "youtube_checked AND youtube_found AND subscribers >= 10000 AND subscribers < 100000", G, MODERATE, "YouTube", "concat(subscribers, ' subscribers')", ("youtube_presence",)),
    Rule("youtube", "youtube_checked AND youtube_found AND subscribers >= 100 AND subscribers < 10000", G, WEAK, "YouTube", "concat(subscribers, ' subscribers')", ("youtube_presence",)),
    Rule("youtube", "youtube_checked AND youtube_found AND subscribers < 100", R, WEAK, "YouTube", "concat('only ', subscribers, ' subscribers')", ("youtube_presence",)),
    Rule("youtube", "youtube_checked AND youtube_found AND listeners >= 500000 AND youtube_views < 10000", R, STRONG, "YouTube", "'many listeners, few views'", ("youtube_disparity",)),
    Rule("youtube", "youtube_checked AND NOT youtube_found AND music_videos = 0", R, "CASE WHEN listeners >= 100000 THEN 'moderate' ELSE 'weak' END", "YouTube", "'not on YouTube'", ("no_youtube",)),
    Rule("pro", "pro_checked AND pro_registered", G, STRONG, "PRO Registry", "'registered works'", ("pro_registered",)),
    Rule("pro", "pro_checked AND pro_registered AND pro_pfc", R, STRONG, "PRO Registry", "'listed publisher'", ("pfc_publisher",)),
    Rule("pro", "pro_checked AND pro_registered AND pro_zero", R, MODERATE, "PRO Registry", "'no share for the songwriter'", ("no_songwriter_share",)),
    Rule("pro", "pro_checked AND pro_registered AND NOT pro_zero AND pro_share >= 30", G, WEAK, "PRO Registry", "'normal shares'", ("normal_pro_split",)),
    Rule("pro", "pro_checked AND NOT pro_registered AND n_ipis > 0", G, WEAK, "PRO Registry / MusicBrainz", "'registered abroad'", ("pro_registered",)),
    Rule("pro", "pro_checked AND NOT pro_registered AND n_ipis = 0", R, WEAK, "PRO Registry", "'not registered'", ("no_pro_registration",)),
    Rule("bandcamp", "bandcamp", G, STRONG, "MusicBrainz", "'Bandcamp page'", ("bandcamp_presence",)),
    Rule("bandcamp", "website", G, MODERATE, "MusicBrainz", "'official website'", ("social_media",)),
    Rule("isrc", "n_isrcs > 0 AND n_registrants = 1", N, WEAK, "ISRC Analysis", "'one registrant'"),
    Rule("isrc", "n_isrcs > 0 AND n_registrants >= 3", G, WEAK, "ISRC Analysis", "concat(n_registrants, ' registrants')"),
    Rule("press", "press_checked AND n_press >= 2", G, STRONG, "Press Coverage", "concat(n_press, ' publications')", ("press_coverage",)),
    Rule("press", "press_checked AND n_press = 1", G, MODERATE, "Press Coverage", "'1 publication'", ("press_coverage",)),
    Rule("press", "press_checked AND n_press = 0 AND press_hits > 0", G, WEAK, "Press Coverage", "concat(press_hits, ' mentions')", ("press_coverage",)),
    Rule("press", "press_checked AND n_press = 0 AND press_hits = 0 AND listeners >= 100000", R, WEAK, "Press Coverage", "'no coverage'", ("no_press_coverage",)),
    Rule("entity", "db_status = 'confirmed_bad'", R, STRONG, "Entity DB", "'confirmed as bad before'", ("entity_confirmed_bad",)),
    Rule("entity", "db_status = 'suspected'", R, MODERATE, "Entity DB", "'suspected before'", ("entity_suspected",)),
    Rule("entity", "db_status = 'cleared'", G, MODERATE, "Entity DB", "'cleared before'", ("entity_cleared",)),
    Rule("entity", "n_bad_labels > 0", R, STRONG, "Entity DB", "concat(n_bad_labels, ' bad labels')", ("entity_bad_label",)),
    Rule("entity", "n_suspected_labels > 0", R, MODERATE, "Entity DB", "concat(n_suspected_labels, ' suspected labels')", ("entity_bad_label",)),
    Rule("entity", "n_bad_writers > 0", R, STRONG, "Entity DB", "concat(n_bad_writers, ' bad songwriters')", ("entity_bad_songwriter",)),
    Rule("entity", "n_suspected_writers > 0", R, MODERATE, "Entity DB", "concat(n_suspected_writers, ' suspected songwriters')", ("entity_bad_songwriter",)),
    Rule("entity", "n_connections >= 1", R, "CASE WHEN n_connections >= 5 THEN 'strong' WHEN n_connections >= 3 THEN 'moderate' ELSE 'weak' END", "Entity DB", "concat(n_connections, ' flagged connections')", ("entity_bad_network",)),
    Rule("cowriters", "n_cowriters >= 1", R, "CASE WHEN n_cowriters >= 3 THEN 'strong' ELSE 'moderate' END", "Entity DB", "concat(n_cowriters, ' flagged artists share producers')", ("cowriter_network",)),
)
#: Pre-seeded evidence stands before the press rules.
SEEDS_AT = next(k for k, r in enumerate(RULES) if r.collector == "press")


def _item(seq: Column, collector: Column, kind: Column, strength: Column, finding: Column, source: Column, tags: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), collector.alias("collector"), kind.alias("evidence_type"), strength.alias("strength"), finding.alias("finding"), source.alias("source"), tags.alias("tags"))


def _fired(seq: int, rule: Rule) -> Column:
    tags = F.array(*map(F.lit, rule.tags)).cast("array<string>")
    return F.when(F.expr(rule.condition), _item(F.lit(seq), F.lit(rule.collector), F.lit(rule.kind), F.expr(rule.strength), F.expr(rule.finding), F.lit(rule.source), tags))


def _findings(dossiers: DataFrame, collector: str | None = None) -> Column:
    own = [k for k, r in enumerate(RULES) if collector in (None, r.collector)]
    parts = [F.array_compact(F.array(*[_fired(10 * k, RULES[k]) for k in own[at : at + GROUP]])) for at in range(0, len(own), GROUP)]
    if "seeds" in dossiers.columns and collector is None:
        parts.append(F.transform("seeds", lambda s, i: _item(10 * SEEDS_AT - 10 + F.least(i, F.lit(9)), F.lit("seed"), s["evidence_type"], s["strength"], s["finding"], s["source"], s["tags"])))
    return F.concat(*parts)


def collect(dossiers: DataFrame, collector: str | None = None) -> DataFrame:
    """artist_id, seq, collector, evidence_type, strength, finding, source, tags of every finding, or of one collector's, in the order of the rules.

    Seeds count as findings of their own, as they are.
    """
    return dossiers.select("artist_id", F.inline_outer(_findings(dossiers, collector))).where("seq IS NOT NULL")


def found(dossiers: DataFrame) -> DataFrame:
    """The same findings as artist_id and items, an array like that of gathered() before any is dropped; null where there are none."""
    rows = dossiers.select("artist_id", _findings(dossiers).alias("found"))
    items = F.transform("found", lambda x: F.struct((-lookup(STRENGTH_RANK, x["strength"])).alias("rank"), x["seq"].alias("first_seq"), x["evidence_type"].alias("kind"), x["strength"].alias("strength"), x["finding"].alias("finding"), x["source"].alias("source"), F.coalesce(x["tags"], F.array().cast("array<string>")).alias("tags")))
    return rows.select("artist_id", F.when(F.size("found") > 0, items).alias("items"))


def collected_sql(view: str, collector: str | None = None) -> str:
    """The same findings in the oracle's SQL."""
    rows = [f"SELECT artist_id, {10 * k} AS seq, '{r.collector}' AS collector, '{r.kind}' AS evidence_type, {r.strength} AS strength, CAST({r.finding} AS VARCHAR) AS finding, '{r.source}' AS source, CAST({list(r.tags)} AS VARCHAR[]) AS tags FROM {view} WHERE {r.condition}" for k, r in enumerate(RULES) if collector in (None, r.collector)]
    return " UNION ALL ".join(rows)
