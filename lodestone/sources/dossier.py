"""Dossiers: everything that the evidence rules ask of an artist, as one flat row.

measures() makes them from nested records (an artist and what the platforms hold on it); dossiers() binds them to the test
tables. MEASURES names the columns.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.dates import date_mid
from lodestone.sources import bindings as b

ARTIST = """artist_id string, name string, genres array<string>, followers bigint, monthly_listeners bigint, popularity int, image_url string, image_width int, external_urls map<string,string>,
  album_count int, single_count int, release_dates array<string>, track_durations array<bigint>, top_track_popularities array<int>, labels array<string>, track_titles array<string>, track_ranks array<bigint>,
  contributors array<string>, contributor_roles map<string,array<string>>, related_artist_names array<string>, deezer_fans bigint"""
EXTERNAL = """genius_found boolean, genius_song_count int, genius_description string, genius_facebook_name string, genius_instagram_name string, genius_twitter_name string, genius_is_verified boolean, genius_followers_count bigint, genius_alternate_names array<string>,
  discogs_found boolean, discogs_physical_releases int, discogs_digital_releases int, discogs_total_releases int, discogs_labels array<string>, discogs_profile string, discogs_realname string, discogs_social_urls array<string>, discogs_members array<string>, discogs_groups array<string>, discogs_data_quality string,
  setlistfm_found boolean, setlistfm_total_shows int, musicbrainz_found boolean, musicbrainz_type string, musicbrainz_country string, musicbrainz_begin_date string, musicbrainz_labels array<string>, musicbrainz_urls map<string,string>, musicbrainz_genres array<string>, musicbrainz_aliases array<string>,
  musicbrainz_isnis array<string>, musicbrainz_ipis array<string>, musicbrainz_gender string, musicbrainz_relationship_count int, musicbrainz_bandcamp_url string, musicbrainz_official_website string,
  lastfm_found boolean, lastfm_listeners bigint, lastfm_playcount bigint, lastfm_listener_play_ratio double, lastfm_bio_exists boolean, wikipedia_found boolean, wikipedia_length bigint, wikipedia_description string, wikipedia_monthly_views bigint,
  songkick_found boolean, songkick_on_tour boolean, songkick_total_past_events int, songkick_event_types array<string>, deezer_ai_checked boolean, deezer_ai_tagged_albums array<string>,
  youtube_checked boolean, youtube_channel_found boolean, youtube_subscriber_count bigint, youtube_view_count bigint, youtube_music_videos_found int,
  pro_checked boolean, pro_songwriter_registered boolean, pro_works_count int, pro_pfc_publisher_match boolean, pro_zero_songwriter_share boolean, pro_songwriter_share_pct double,
  isrcs array<string>, isrc_registrants array<string>, press_checked boolean, press_publications_found array<string>, press_total_hits int,
  pre_seeded_evidence array<struct<finding:string,source:string,evidence_type:string,strength:string,tags:array<string>>>,
  match_confidences map<string,double>, match_methods map<string,string>, had_platform_ids map<string,boolean>, api_errors map<string,string>"""
RECORD = f"{ARTIST}, {EXTERNAL}"

# fixed values
UNIFORM_GENRES = ("ambient", "classical", "meditation", "electronic", "lo-fi", "lofi", "new age", "drone", "minimal")
PRODUCING = ("producer", "composer", "author", "writer")
MUSIC_TERMS = ("musician", "singer", "band", "rapper", "composer", "songwriter", "dj", "group", "artist", "producer")
#: Platforms that may fail, by the name that errors go by and the key of their matches.
PLATFORMS = {"genius": "genius", "discogs": "discogs", "setlist.fm": "setlistfm", "musicbrainz": "musicbrainz", "last.fm": "lastfm", "wikipedia": "wikipedia", "songkick": "songkick"}
SOCIAL_SITES = {"facebook": "Facebook", "instagram": "Instagram", "twitter": "Twitter/X", "x.com": "Twitter/X", "youtube": "YouTube", "bandcamp": "Bandcamp", "soundcloud": "SoundCloud"}

#: The flat columns with their types; intel (entity database) columns come last.
MEASURES = """name string, on_deezer boolean, platforms int, fans bigint, listeners bigint, followers bigint, popularity int, image_width int, n_urls int, has_wiki_url boolean, albums bigint, singles bigint, n_dur int, avg_s double, sd_s double, genre_exempt boolean,
  n_dates int, span_days int, years double, n_labels int, n_pfc_labels int, n_ai_labels int, name_ai boolean, name_generic boolean, name_len int, n_contrib int, n_assoc int, n_flagged int, n_related_clean int, has_watchlist boolean, n_pfc_writers int, n_producers int, n_titles int, self_produced boolean,
  n_genres int, mb_genres int, n_ranks int, rank_total double, top1_share double, top2_share double, avg_rank double, n_pops int, max_pop int, avg_pop double,
  genius_found boolean, genius_songs int, genius_bio boolean, genius_verified boolean, genius_followers bigint, discogs_found boolean, discogs_physical int, discogs_digital int, discogs_total int, n_discogs_labels int, n_discogs_pfc int, bio_len int, bio_hits int, bio_years int, realname boolean, n_members int, n_groups int, quality_correct boolean,
  setlistfm_found boolean, shows int, musicbrainz_found boolean, mb_type boolean, mb_country boolean, mb_begin boolean, n_mb_labels int, n_mb_pfc int, mb_relations int, n_isnis int, n_ipis int, has_gender boolean, n_aliases int, n_social int, n_social_urls int, mb_wikipedia boolean, mb_wikidata boolean, mb_bandcamp boolean, bandcamp boolean, website boolean,
  lastfm_found boolean, lastfm_listeners bigint, lastfm_ratio double, lastfm_bio boolean, wikipedia_found boolean, wiki_length bigint, wiki_views bigint, wiki_music boolean, songkick_found boolean, past_events int, on_tour boolean, n_festivals int, ai_checked boolean, n_ai_albums int,
  youtube_checked boolean, youtube_found boolean, subscribers bigint, youtube_views bigint, music_videos int, pro_checked boolean, pro_registered boolean, pro_pfc boolean, pro_zero boolean, pro_share double, n_isrcs int, n_registrants int, press_checked boolean, n_press int, press_hits int,
  err_genius boolean, err_discogs boolean, err_setlistfm boolean, err_musicbrainz boolean, err_lastfm boolean, err_wikipedia boolean, err_songkick boolean, trusted_genius boolean, trusted_discogs boolean, had_genius boolean, had_discogs boolean, had_setlistfm boolean, had_musicbrainz boolean, had_lastfm boolean, n_errors int,
  db_status string, n_bad_labels int, n_suspected_labels int, n_bad_writers int, n_suspected_writers int, n_connections int, n_cowriters int"""
COLUMNS = [m.split() for m in MEASURES.replace("\n", " ").split(",")]
INTEL = [c for c, _ in COLUMNS[-7:]]


def _size(x: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.size(x), F.lit(0)))


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _mean(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.when(_size(x) > 0, total / F.size(x)).otherwise(0.0)


def _deviation(x: Column) -> Column:
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - _mean(x)) * (v - _mean(x)))
    return F.when(_size(x) > 1, F.sqrt(squares / (F.size(x) - 1))).otherwise(0.0)


def _site(url: Column) -> Column:
    out = F
    for part, name in SOCIAL_SITES.items():
        out = out.when(F.lower(url).contains(part), name)
    return out


def _relation(rel: Column, url: Column) -> Column:
    r, u = F.lower(rel), F.lower(url)
    out = F.when(r.contains("official homepage") | r.contains("official site"), "Official Website").when(r.contains("wikipedia") | u.contains("wikipedia"), "Wikipedia").when(r.contains("wikidata") | u.contains("wikidata"), "Wikidata")
    for part in ("youtube", "bandcamp", "soundcloud", "facebook", "instagram", "twitter", "x.com"):
        out = out.when(u.contains(part), SOCIAL_SITES[part])
    return out


def lists_of(spark: SparkSession, ai_names: list[str] = (), pfc_labels: list[str] = (), pfc_writers: list[str] = ()) -> DataFrame:
    """The blocklists as one row of lower-case arrays."""
    rows = [tuple([x.lower() for x in names] for names in (ai_names, pfc_labels, pfc_writers))]
    return spark.createDataFrame(rows, "ai_names array<string>, pfc_labels array<string>, pfc_writers array<string>")


def measures(records: DataFrame, lists: DataFrame, intel: DataFrame | None = None, this_year: int = 2026) -> DataFrame:
    """artist_id, MEASURES and seeds (pre-seeded evidence) of each record.

    lists has one row, see lists_of(); intel has artist_id and the columns INTEL, and counts as nothing where it is missing.
    """
    c = F.col
    rows = records.join(F.broadcast(lists))
    low = lambda x: F.transform(F.coalesce(c(x), F.array().cast("array<string>")), lambda v: F.lower(v))
    both = lambda x, names: _size(F.array_intersect(low(x), c(names)))
    trim = lambda x: F.transform(low(x), lambda v: F.trim(v))
    known = F.array_union(c("ai_names"), c("pfc_writers"))
    associated = F.filter(F.array_distinct(F.concat(trim("contributors"), trim("related_artist_names"))), lambda v: v != "")
    flagged = F.array_intersect(associated, known)
    roles = F.coalesce(c("contributor_roles"), F.create_map().cast("map<string,array<string>>"))
    producers = F.map_keys(F.map_filter(roles, lambda k, v: F.exists(v, lambda r: F.lower(r).isin(*PRODUCING))))
    days = F.filter(F.transform(F.coalesce(c("release_dates"), F.array().cast("array<string>")), lambda v: date_mid(F.substring(v, 1, 10))), lambda v: v.isNotNull())
    ranks = F.sort_array(c("track_ranks"), asc=False)
    share = lambda k: F.when(F.col("rank_total") > 0, F.aggregate(F.slice(ranks, 1, k), F.lit(0.0), lambda s, v: s + v) / F.col("rank_total")).otherwise(0.0)
    urls = F.coalesce(c("musicbrainz_urls"), F.create_map().cast("map<string,string>"))
    entries = F.map_entries(urls)
    names = F.array(*[F.when(_filled(c(f"genius_{k}_name")), v) for k, v in (("facebook", "Facebook"), ("instagram", "Instagram"), ("twitter", "Twitter/X"))])
    discogs_urls = F.coalesce(c("discogs_social_urls"), F.array().cast("array<string>"))
    social = F.array_distinct(F.array_compact(F.concat(names, F.transform(discogs_urls, _site), F.transform(entries, lambda e: _relation(e["key"], e["value"])))))
    footprint = _size(F.array_compact(names)) + _size(discogs_urls) + _size(F.filter(entries, lambda e: F.lower(e["value"]).rlike("facebook|instagram|twitter|youtube|bandcamp")))
    named = lambda word: F.exists(entries, lambda e: F.lower(e["key"]).contains(word) | F.lower(e["value"]).contains(word))
    failed = F.transform(F.map_keys(F.coalesce(c("api_errors"), F.create_map().cast("map<string,string>"))), lambda k: F.lower(k))
    bio = F.coalesce(c("discogs_profile"), F.lit(""))
    at = lambda m, k: F.element_at(F.coalesce(c(m), F.create_map().cast(dict(records.dtypes)[m])), k)
    trusted = lambda k: F.coalesce(at("match_methods", k).isin("platform_id", "exact"), F.lit(False)) | (F.coalesce(at("match_confidences", k), F.lit(1.0)) >= 0.85)
    on = {k: F.coalesce(c(f"{k}_found"), F.lit(False)) for k in PLATFORMS.values()}
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    num = lambda x: F.coalesce(c(x), F.lit(0))
    pops = F.coalesce(c("top_track_popularities"), F.array().cast("array<int>"))
    mb_labels, sites = both("musicbrainz_labels", "pfc_labels"), F.coalesce(c("external_urls"), F.create_map().cast("map<string,string>"))
    on_deezer = c("artist_id").startswith("deezer:") | (num("deezer_fans") > 0) | F.array_contains(F.map_keys(sites), "deezer")
    rows = rows.withColumns({"rank_total": F.aggregate(F.coalesce(c("track_ranks"), F.array().cast("array<bigint>")), F.lit(0.0), lambda s, v: s + v), "days": days})
    span = F.coalesce(F.datediff(F.array_max("days"), F.array_min("days")), F.lit(0))
    made = {
        "name": c("name"), "on_deezer": on_deezer, "platforms": sum((x.cast("int") for x in on.values()), on_deezer.cast("int")), "fans": num("deezer_fans"), "listeners": num("monthly_listeners"), "followers": num("followers"), "popularity": num("popularity"),
        "image_width": F.when(_filled(c("image_url")), F.greatest(num("image_width"), F.lit(1))).otherwise(0), "n_urls": _size(F.filter(F.map_keys(sites), lambda k: k != "spotify")), "has_wiki_url": F.exists(F.map_values(sites), lambda v: F.lower(v).contains("wikipedia")),
        "albums": num("album_count"), "singles": num("single_count"), "n_dur": _size(c("track_durations")), "avg_s": _mean(c("track_durations")) / 1000, "sd_s": _deviation(c("track_durations")) / 1000, "genre_exempt": F.arrays_overlap(low("genres"), F.array(*map(F.lit, UNIFORM_GENRES))),
        "n_dates": _size(c("days")), "span_days": span, "years": F.greatest(span / 30.0, F.lit(1.0)) / 12.0, "n_labels": _size(c("labels")), "n_pfc_labels": both("labels", "pfc_labels"), "n_ai_labels": both("labels", "ai_names"), "name_ai": F.array_contains("ai_names", F.lower("name")),
        "name_generic": c("name").rlike(r"^(The\s+)?[A-Z][a-z]+\s+[A-Z][a-z]+s?$"), "name_len": F.length(F.trim("name")), "n_contrib": _size(c("contributors")), "n_assoc": _size(associated), "n_flagged": _size(flagged), "n_related_clean": _size(F.filter(trim("related_artist_names"), lambda v: ~F.array_contains(flagged, v))),
        "has_watchlist": F.size("pfc_writers") > 0, "n_pfc_writers": _size(F.array_intersect(F.array_union(low("contributors"), F.transform(F.map_keys(roles), lambda v: F.lower(v))), c("pfc_writers"))), "n_producers": _size(producers), "n_titles": _size(c("track_titles")),
        "self_produced": F.coalesce(F.lower(F.trim(F.get(producers, F.lit(0)))) == F.lower(F.trim("name")), F.lit(False)), "n_genres": _size(c("genres")), "mb_genres": _size(c("musicbrainz_genres")), "n_ranks": _size(c("track_ranks")), "rank_total": c("rank_total"), "top1_share": share(1), "top2_share": share(2), "avg_rank": _mean(c("track_ranks")),
        "n_pops": F.size(pops), "max_pop": F.coalesce(F.array_max(pops), F.lit(0)), "avg_pop": _mean(pops), "genius_found": on["genius"], "genius_songs": num("genius_song_count"), "genius_bio": _filled(c("genius_description")), "genius_verified": yes("genius_is_verified"), "genius_followers": num("genius_followers_count"),
        "discogs_found": on["discogs"], "discogs_physical": num("discogs_physical_releases"), "discogs_digital": num("discogs_digital_releases"), "discogs_total": num("discogs_total_releases"), "n_discogs_labels": _size(c("discogs_labels")), "n_discogs_pfc": both("discogs_labels", "pfc_labels"), "bio_len": F.length(bio), "bio_hits": text.career_words(bio), "bio_years": _size(text.years(bio, this_year + 2)),
        "realname": _filled(c("discogs_realname")), "n_members": _size(c("discogs_members")), "n_groups": _size(c("discogs_groups")), "quality_correct": F.coalesce(c("discogs_data_quality") == "Correct", F.lit(False)), "setlistfm_found": on["setlistfm"], "shows": num("setlistfm_total_shows"),
        "musicbrainz_found": on["musicbrainz"], "mb_type": _filled(c("musicbrainz_type")), "mb_country": _filled(c("musicbrainz_country")), "mb_begin": _filled(c("musicbrainz_begin_date")), "n_mb_labels": _size(c("musicbrainz_labels")), "n_mb_pfc": mb_labels, "mb_relations": num("musicbrainz_relationship_count"), "n_isnis": _size(c("musicbrainz_isnis")), "n_ipis": _size(c("musicbrainz_ipis")), "has_gender": _filled(c("musicbrainz_gender")),
        "n_aliases": _size(F.array_distinct(F.concat(F.coalesce("genius_alternate_names", F.array().cast("array<string>")), F.coalesce("musicbrainz_aliases", F.array().cast("array<string>"))))), "n_social": _size(social), "n_social_urls": F.least(footprint, F.lit(6)), "mb_wikipedia": named("wikipedia"), "mb_wikidata": named("wikidata"),
        "mb_bandcamp": F.exists(F.map_values(urls), lambda v: F.lower(v).contains("bandcamp")), "bandcamp": _filled(c("musicbrainz_bandcamp_url")), "website": _filled(c("musicbrainz_official_website")), "lastfm_found": on["lastfm"], "lastfm_listeners": num("lastfm_listeners"), "lastfm_ratio": F.coalesce("lastfm_listener_play_ratio", F.lit(0.0)), "lastfm_bio": yes("lastfm_bio_exists"),
        "wikipedia_found": on["wikipedia"], "wiki_length": num("wikipedia_length"), "wiki_views": num("wikipedia_monthly_views"), "wiki_music": F.coalesce(F.lower("wikipedia_description").rlike("|".join(MUSIC_TERMS)), F.lit(False)), "songkick_found": on["songkick"], "past_events": num("songkick_total_past_events"), "on_tour": yes("songkick_on_tour"), "n_festivals": _size(F.filter("songkick_event_types", lambda t: t == "Festival")),
        "ai_checked": yes("deezer_ai_checked"), "n_ai_albums": _size(c("deezer_ai_tagged_albums")), "youtube_checked": yes("youtube_checked"), "youtube_found": yes("youtube_channel_found"), "subscribers": num("youtube_subscriber_count"), "youtube_views": num("youtube_view_count"), "music_videos": num("youtube_music_videos_found"),
        "pro_checked": yes("pro_checked"), "pro_registered": yes("pro_songwriter_registered"), "pro_pfc": yes("pro_pfc_publisher_match"), "pro_zero": yes("pro_zero_songwriter_share"), "pro_share": F.coalesce("pro_songwriter_share_pct", F.lit(-1.0)), "n_isrcs": _size(c("isrcs")), "n_registrants": _size(c("isrc_registrants")), "press_checked": yes("press_checked"), "n_press": _size(c("press_publications_found")), "press_hits": num("press_total_hits"),
        **{f"err_{key}": F.array_contains(failed, said) for said, key in PLATFORMS.items()}, "trusted_genius": trusted("genius"), "trusted_discogs": trusted("discogs"), **{f"had_{k}": F.coalesce(at("had_platform_ids", k), F.lit(False)) for k in ("genius", "discogs", "setlistfm", "musicbrainz", "lastfm")}, "n_errors": F.size(failed),
    }
    plain = rows.select("artist_id", *[made[name].cast(kind).alias(name) for name, kind in COLUMNS if name in made], F.coalesce("pre_seeded_evidence", F.array().cast(dict(records.dtypes)["pre_seeded_evidence"])).alias("seeds"))
    if intel is None:
        rows = plain.withColumns({name: F.lit("unknown" if kind == "string" else 0).cast(kind) for name, kind in COLUMNS[-7:]})
    else:
        rows = plain.join(intel.select("artist_id", *INTEL), "artist_id", "left").fillna({name: "unknown" if kind == "string" else 0 for name, kind in COLUMNS[-7:]})
    return rows.select("artist_id", *[name for name, _ in COLUMNS], "seeds")


#: A dossier column by column over b_stats, in SQL that Spark and the oracle both read. Numbers of the tables stand for
#: measures; where the tables have nothing alike, a remainder of the artist's number does.
BOUND = {
    "name": "name", "on_deezer": "artist_id % 4 <> 0", "fans": "CAST(floor(balance * CASE artist_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 50 END) AS BIGINT)", "listeners": "CAST(floor(balance) AS BIGINT) * (artist_id % 7) * 20", "followers": "CAST(floor(balance) AS BIGINT) * (artist_id % 9) * 15", "popularity": "artist_id % 60",
    "image_width": "(artist_id % 4) * 200", "n_urls": "artist_id % 3", "has_wiki_url": "artist_id % 2 = 0", "albums": "CASE WHEN artist_id % 6 = 0 THEN 0 ELSE n_albums END", "singles": "CASE WHEN artist_id % 5 = 0 THEN 6 ELSE 1 END * n_singles", "n_dur": "n", "avg_s": "mean_len", "sd_s": "CASE WHEN artist_id % 3 = 0 THEN sd_len / 20 ELSE sd_len END", "genre_exempt": "artist_id % 13 = 0",
    "n_dates": "n", "span_days": "CASE WHEN artist_id % 11 = 0 THEN 0 ELSE days END", "years": "greatest(CASE WHEN artist_id % 11 = 0 THEN 0 ELSE days END / CAST(30 AS DOUBLE), CAST(1 AS DOUBLE)) / 12", "n_labels": "labels", "n_pfc_labels": "CASE WHEN artist_id % 8 = 0 THEN bad_labels ELSE 0 END", "n_ai_labels": "CASE WHEN artist_id % 29 = 0 THEN 1 ELSE 0 END", "name_ai": "artist_id % 41 = 0", "name_generic": "artist_id % 5 = 2", "name_len": "CASE WHEN artist_id % 19 = 0 THEN 3 ELSE length(name) END",
    "n_contrib": "least(writers, artist_id % 8)", "n_assoc": "least(writers, artist_id % 8) + artist_id % 9", "n_flagged": "CASE WHEN artist_id % 7 = 0 THEN least(bad_writers, 2) ELSE 0 END", "n_related_clean": "artist_id % 9", "has_watchlist": "artist_id > 0", "n_pfc_writers": "CASE WHEN artist_id % 10 = 0 THEN bad_writers ELSE 0 END", "n_producers": "artist_id % 4", "n_titles": "n", "self_produced": "artist_id % 8 = 1",
    "n_genres": "artist_id % 5", "mb_genres": "CASE WHEN artist_id % 2 = 0 THEN artist_id % 5 ELSE 0 END", "n_ranks": "n", "rank_total": "total", "top1_share": "least(CAST(1 AS DOUBLE), CASE WHEN artist_id % 4 = 1 THEN 2 ELSE 1 END * top1)", "top2_share": "least(CAST(1 AS DOUBLE), CASE WHEN artist_id % 4 = 1 THEN 2 ELSE 1 END * top2)", "avg_rank": "CASE WHEN artist_id % 3 = 0 THEN 4000 ELSE 1000 END * mean_len", "n_pops": "artist_id % 3", "max_pop": "artist_id % 90", "avg_pop": "CAST(artist_id % 50 AS DOUBLE)",
    "genius_found": "artist_id % 3 <> 0", "genius_songs": "artist_id % 31", "genius_bio": "artist_id % 9 = 1", "genius_verified": "artist_id % 14 = 1", "genius_followers": "CAST(floor(balance) AS BIGINT) % 1500", "discogs_found": "artist_id % 5 <> 0", "discogs_physical": "artist_id % 13", "discogs_digital": "artist_id % 3", "discogs_total": "artist_id % 13 + artist_id % 3", "n_discogs_labels": "artist_id % 4", "n_discogs_pfc": "CASE WHEN artist_id % 28 = 3 THEN 1 ELSE 0 END",
    "bio_len": "(artist_id % 11) * 30", "bio_hits": "artist_id % 5", "bio_years": "artist_id % 4", "realname": "artist_id % 6 = 1", "n_members": "CASE WHEN artist_id % 12 = 5 THEN 4 ELSE 0 END", "n_groups": "artist_id % 2", "quality_correct": "artist_id % 7 = 2", "setlistfm_found": "artist_id % 4 = 2", "shows": "CASE WHEN artist_id % 4 = 2 THEN artist_id % 70 ELSE 0 END",
    "musicbrainz_found": "artist_id % 7 <> 3", "mb_type": "artist_id % 2 = 1", "mb_country": "artist_id % 3 = 1", "mb_begin": "artist_id % 5 = 1", "n_mb_labels": "artist_id % 3", "n_mb_pfc": "CASE WHEN artist_id % 26 = 7 THEN 1 ELSE 0 END", "mb_relations": "artist_id % 15", "n_isnis": "CASE WHEN artist_id % 9 = 4 THEN 1 ELSE 0 END", "n_ipis": "CASE WHEN artist_id % 10 = 7 THEN 1 ELSE 0 END", "has_gender": "artist_id % 3 = 2", "n_aliases": "artist_id % 4",
    "n_social": "artist_id % 6", "n_social_urls": "artist_id % 7", "mb_wikipedia": "artist_id % 16 = 9", "mb_wikidata": "artist_id % 16 = 10", "mb_bandcamp": "artist_id % 15 = 8", "bandcamp": "artist_id % 15 = 8", "website": "artist_id % 8 = 5", "lastfm_found": "artist_id % 8 <> 6", "lastfm_listeners": "CAST(floor(balance) AS BIGINT) * (artist_id % 4)", "lastfm_ratio": "CAST(artist_id % 33 AS DOUBLE)", "lastfm_bio": "artist_id % 3 = 0",
    "wikipedia_found": "artist_id % 12 = 0", "wiki_length": "CAST(floor(balance) AS BIGINT) * 5", "wiki_views": "CAST(floor(balance) AS BIGINT) * (artist_id % 8)", "wiki_music": "artist_id % 24 = 0", "songkick_found": "artist_id % 9 = 2", "past_events": "CASE WHEN artist_id % 9 = 2 THEN artist_id % 130 ELSE 0 END", "on_tour": "artist_id % 18 = 2", "n_festivals": "CASE WHEN artist_id % 2 = 0 THEN 1 ELSE 0 END", "ai_checked": "artist_id % 2 = 1", "n_ai_albums": "CASE WHEN artist_id % 43 = 1 THEN 2 ELSE 0 END",
    "youtube_checked": "artist_id % 3 <> 1", "youtube_found": "artist_id % 6 < 3", "subscribers": "CAST(floor(balance) AS BIGINT) * (artist_id % 20)", "youtube_views": "CAST(floor(balance) AS BIGINT) * (artist_id % 5)", "music_videos": "artist_id % 2", "pro_checked": "artist_id % 5 <> 2", "pro_registered": "artist_id % 5 = 3", "pro_pfc": "artist_id % 35 = 8", "pro_zero": "artist_id % 20 = 13", "pro_share": "CAST(artist_id % 90 AS DOUBLE)", "n_isrcs": "n", "n_registrants": "artist_id % 5",
    "press_checked": "artist_id % 4 = 1", "n_press": "artist_id % 3", "press_hits": "artist_id % 2", "err_genius": "artist_id % 12 = 3", "err_discogs": "artist_id % 20 = 5", "err_setlistfm": "artist_id % 17 = 0", "err_musicbrainz": "artist_id % 21 = 3", "err_lastfm": "artist_id % 24 = 6", "err_wikipedia": "artist_id % 17 = 1", "err_songkick": "artist_id % 17 = 0", "trusted_genius": "artist_id % 4 <> 3", "trusted_discogs": "artist_id % 6 <> 4",
    "had_genius": "artist_id % 9 = 0", "had_discogs": "artist_id % 10 = 0", "had_setlistfm": "artist_id % 11 = 3", "had_musicbrainz": "artist_id % 14 = 3", "had_lastfm": "artist_id % 16 = 6", "n_errors": "CASE WHEN artist_id % 17 = 0 THEN 2 ELSE 0 END",
    "db_status": "threat_status", "n_bad_labels": "CASE WHEN artist_id % 8 = 1 THEN bad_labels ELSE 0 END", "n_suspected_labels": "CASE WHEN artist_id % 8 = 2 THEN bad_labels ELSE 0 END", "n_bad_writers": "CASE WHEN artist_id % 16 = 1 THEN bad_writers ELSE 0 END", "n_suspected_writers": "CASE WHEN artist_id % 16 = 2 THEN bad_writers ELSE 0 END", "n_connections": "CASE WHEN artist_id % 6 = 5 THEN artist_id % 8 ELSE 0 END", "n_cowriters": "CASE WHEN artist_id % 6 = 4 THEN artist_id % 5 ELSE 0 END",
}
PRESENT = ("on_deezer", "genius_found", "discogs_found", "setlistfm_found", "musicbrainz_found", "lastfm_found", "wikipedia_found", "songkick_found")
BOUND["platforms"] = " + ".join(f"CASE WHEN {BOUND[p]} THEN 1 ELSE 0 END" for p in PRESENT)
_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}

b.SQL["b_stats"] = """SELECT a.artist_id, a.name, abs(a.fans) AS balance, a.threat_status, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(n_albums, 0) AS n_albums, coalesce(n_singles, 0) AS n_singles, CAST(coalesce(days, 0) AS INTEGER) AS days, round(coalesce(mean_len, 0), 6) AS mean_len, round(coalesce(sd_len, 0), 6) AS sd_len,
    round(coalesce(total, 0), 2) AS total, round(coalesce(top1, 0), 6) AS top1, round(coalesce(top2, 0), 6) AS top2, CAST(coalesce(writers, 0) AS INTEGER) AS writers, CAST(coalesce(bad_writers, 0) AS INTEGER) AS bad_writers, CAST(coalesce(labels, 0) AS INTEGER) AS labels, CAST(coalesce(bad_labels, 0) AS INTEGER) AS bad_labels
  FROM b_artist a LEFT JOIN (SELECT artist_id, count(*) AS n, count(*) FILTER (rtype = 'album') AS n_albums, count(*) FILTER (rtype <> 'album') AS n_singles, date_diff('day', min(release_date), max(release_date)) AS days, avg(track_rank) / 1000 AS mean_len, stddev_samp(track_rank) / 1000 AS sd_len,
      sum(track_rank) AS total, max(track_rank) / sum(track_rank) AS top1, list_sum(list_slice(list_reverse_sort(list(track_rank)), 1, 2)) / sum(track_rank) AS top2 FROM b_release GROUP BY 1) r USING (artist_id)
    LEFT JOIN (SELECT o_custkey AS artist_id, count(DISTINCT l_suppkey) AS writers, count(DISTINCT CASE WHEN s_acctbal < 0 THEN l_suppkey END) AS bad_writers, count(DISTINCT p_brand) AS labels, count(DISTINCT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand END) AS bad_labels
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1) l USING (artist_id)"""
b.SQL["b_dossier"] = "SELECT artist_id, " + ", ".join(f"CAST({BOUND[name]} AS {_SQL_TYPES[kind]}) AS {name}" for name, kind in COLUMNS) + " FROM b_stats"


def stats(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    """What the tables hold on each artist: its releases' counts, spans and ranks; with links, its writers and labels."""
    rank = F.col("track_rank")
    top = lambda k: F.aggregate(F.slice(F.sort_array(F.collect_list(rank), asc=False), 1, k), F.lit(0.0), lambda s, v: s + v) / F.sum(rank)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    album = F.col("rtype") == "album"
    own = b.releases(spark, sf_dir).groupBy("artist_id").agg(F.count("*").cast("int").alias("n"), count(album).alias("n_albums"), count(~album).alias("n_singles"), F.datediff(F.max("release_date"), F.min("release_date")).alias("days"), F.round(F.avg(rank) / 1000, 6).alias("mean_len"), F.round(F.stddev_samp(rank) / 1000, 6).alias("sd_len"), F.round(F.sum(rank), 2).alias("total"), F.round(top(1), 6).alias("top1"), F.round(top(2), 6).alias("top2"))
    artists = b.artists(spark, sf_dir).select("artist_id", "name", F.abs("fans").alias("balance"), "threat_status")
    if not links:
        return artists.join(own, "artist_id", "left").fillna(0)
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist_id")), "l_orderkey")
    bad = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("bad"))
    brand = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label"))
    # a row for each artist and writer or label, so that no artist's lines are counted in one group
    writers = lines.select("artist_id", "l_suppkey").distinct().join(bad, "l_suppkey").groupBy("artist_id").agg(F.count("*").cast("int").alias("writers"), count(F.col("bad")).cast("int").alias("bad_writers"))
    labels = lines.join(brand, "l_partkey").select("artist_id", "label").distinct().groupBy("artist_id").agg(F.count("*").cast("int").alias("labels"), count(F.col("label").isin("Brand#1", "Brand#2")).cast("int").alias("bad_labels"))
    return artists.join(own, "artist_id", "left").join(writers, "artist_id", "left").join(labels, "artist_id", "left").fillna(0)


def dossiers(spark: SparkSession, sf_dir: str, only: Collection[str] | None = None) -> DataFrame:
    """artist_id and MEASURES of every artist of the tables, without seeds; only: just these measures, without joins that none of them needs."""
    bound = [(name, kind) for name, kind in COLUMNS if only is None or name in only]
    links = any(re.search(r"\b(bad_)?(writers|labels)\b", BOUND[name]) for name, _ in bound)
    rows = stats(spark, sf_dir, links).selectExpr("artist_id", *[f"CAST({BOUND[name]} AS {kind}) AS {name}" for name, kind in bound])
    if only is not None:
        return rows
    return rows.withColumn("seeds", F.array().cast("array<struct<finding:string,source:string,evidence_type:string,strength:string,tags:array<string>>>"))
