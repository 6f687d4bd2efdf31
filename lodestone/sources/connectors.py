"""The parse stage of the connectors: raw JSON responses, as landed, to typed columns. No request is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.dates import date_strict
from lodestone.sources.dossier import RECORD

PLAYLIST = "name string, tracks array<struct<name:string,duration_ms:string,artists:array<struct<id:string,name:string,uri:string,link:string>>>>"
DEEZER = "albums array<struct<title:string,record_type:string,release_date:string,label:string>>, tracks array<struct<title:string,duration:bigint,rank:bigint,isrc:string,contributors:array<struct<name:string,role:string>>>>, related array<struct<name:string>>"
MUSICBRAINZ = "type string, country string, `life-span` struct<begin:string>, aliases array<struct<name:string>>, tags array<struct<name:string,count:bigint>>, isnis array<string>, ipis array<string>, relations array<struct<type:string,url:struct<resource:string>>>, releases array<struct<title:string,`label-info`:array<struct<label:struct<name:string>>>>>, isrcs array<string>"
DISCOGS = "profile string, realname string, releases array<struct<title:string,format:string,type:string>>, members array<struct<name:string>>"
SETLIST = "setlist array<struct<eventDate:string,venue:struct<name:string,city:struct<name:string,country:struct<name:string>>>>>"
LASTFM = "artist struct<stats:struct<listeners:string,playcount:string>,bio:struct<summary:string>,tags:struct<tag:array<struct<name:string>>>>"
VIEWS = "items array<struct<views:bigint>>"
EVENTS = "events array<struct<type:string,start:string,location:string>>"
WORKS = "works array<struct<title:string,writers:array<struct<name:string,share:double>>,publishers:array<struct<name:string>>>>"


def _texts(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def artist_id(a: Column) -> Column:
    """The id given, else that of the URI, else that of the link."""
    return F.coalesce(F.nullif(a["id"], F.lit("")), F.nullif(F.regexp_extract(a["uri"], r"artist:([a-zA-Z0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(a["link"], r"artist/([a-zA-Z0-9]+)", 1), F.lit("")), F.lit(""))


def playlist(raw: Column) -> Column:
    """tracks, artist_ids (without repeats), durations (ms) of a playlist's response."""
    tracks = F.coalesce(F.from_json(raw, PLAYLIST)["tracks"], F.array().cast("array<struct<name:string,duration_ms:string,artists:array<struct<id:string,name:string,uri:string,link:string>>>>"))
    ids = F.array_distinct(F.flatten(F.transform(tracks, lambda t: F.transform(t["artists"], artist_id))))
    return F.struct(F.size(tracks).alias("tracks"), F.filter(ids, lambda i: i != "").alias("artist_ids"), F.transform(tracks, lambda t: text.safe_int(t["duration_ms"])).alias("durations"))


def deezer(raw: Column) -> Column:
    """Labels, counts by type, dates, durations, ranks, contributors with their roles, registrants, related artists."""
    r = F.from_json(raw, DEEZER)
    albums, tracks = r["albums"], r["tracks"]
    kinds = F.transform(albums, lambda a: F.lower(a["record_type"]))
    people = F.flatten(F.transform(tracks, lambda t: F.coalesce(t["contributors"], F.array().cast("array<struct<name:string,role:string>>"))))
    names = F.array_distinct(F.transform(people, lambda p: p["name"]))
    roles = F.map_from_arrays(names, F.transform(names, lambda n: F.array_sort(F.array_distinct(F.transform(F.filter(people, lambda p: p["name"] == n), lambda p: p["role"])))))
    count = lambda *kind: F.size(F.filter(kinds, lambda k: k.isin(*kind)))
    registrants = F.array_sort(F.array_distinct(F.transform(F.filter(tracks, lambda t: t["isrc"].isNotNull()), lambda t: text.isrc_registrant(t["isrc"]))))
    return F.struct(F.array_sort(F.array_distinct(F.filter(F.transform(albums, lambda a: a["label"]), lambda x: x.isNotNull()))).alias("labels"), count("album").alias("albums"), count("single", "ep").alias("singles"), F.array_sort(F.filter(F.transform(albums, lambda a: a["release_date"]), lambda x: date_strict(x).isNotNull())).alias("dates"), F.transform(tracks, lambda t: t["duration"] * 1000).alias("durations"), F.transform(tracks, lambda t: t["rank"]).alias("ranks"), names.alias("contributors"), roles.alias("contributor_roles"), registrants.alias("registrants"), F.transform(r["related"], lambda x: x["name"]).alias("related"))


def musicbrainz(raw: Column) -> Column:
    """Type, country, begin, aliases, genres by count, identifiers, urls by relation, labels, registrants."""
    r = F.from_json(raw, MUSICBRAINZ)
    genres = F.transform(F.array_sort(F.transform(r["tags"], lambda t: F.struct((-t["count"]).alias("n"), t["name"].alias("name")))), lambda t: t["name"])
    labels = F.array_distinct(F.flatten(F.transform(r["releases"], lambda x: F.transform(F.coalesce(x["label-info"], F.array().cast("array<struct<label:struct<name:string>>>")), lambda i: i["label"]["name"]))))
    entries = F.transform(r["relations"], lambda x: F.struct(x["type"].alias("key"), x["url"]["resource"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.struct(r["type"].alias("type"), r["country"].alias("country"), r["life-span"]["begin"].alias("begin"), _texts(F.transform(r["aliases"], lambda a: a["name"])).alias("aliases"), _texts(genres).alias("genres"), _texts(r["isnis"]).alias("isnis"), _texts(r["ipis"]).alias("ipis"), F.map_from_entries(last).alias("urls"), _texts(F.filter(labels, lambda x: x.isNotNull())).alias("labels"), F.array_sort(F.array_distinct(F.transform(_texts(r["isrcs"]), text.isrc_registrant))).alias("registrants"))


def discogs(raw: Column) -> Column:
    r = F.from_json(raw, DISCOGS)
    physical = F.filter(r["releases"], lambda x: text.is_physical(F.split(F.coalesce(x["format"], F.lit("")), ", ")))
    return F.struct(F.coalesce(r["profile"], F.lit("")).alias("profile"), F.coalesce(r["realname"], F.lit("")).alias("realname"), F.size(r["releases"]).alias("total"), F.size(physical).alias("physical"), (F.size(r["releases"]) - F.size(physical)).alias("digital"), F.transform(r["members"], lambda m: m["name"]).alias("members"))


def setlistfm(raw: Column) -> Column:
    """Shows, first and last date (given as dd-MM-yyyy), venues and countries in their order without repeats."""
    s = F.from_json(raw, SETLIST)["setlist"]
    days = F.transform(s, lambda x: F.to_date(F.try_to_timestamp(x["eventDate"], F.lit("dd-MM-yyyy"))))
    distinct = lambda f, n: F.slice(F.array_distinct(F.filter(F.transform(s, f), lambda v: v.isNotNull())), 1, n)
    return F.struct(F.size(s).alias("shows"), F.array_min(days).alias("first"), F.array_max(days).alias("last"), distinct(lambda x: x["venue"]["name"], 30).alias("venues"), distinct(lambda x: x["venue"]["city"]["country"]["name"], 20).alias("countries"))


def lastfm(raw: Column) -> Column:
    a = F.from_json(raw, LASTFM)["artist"]
    listeners, plays = text.safe_int(a["stats"]["listeners"]), text.safe_int(a["stats"]["playcount"])
    return F.struct(listeners.alias("listeners"), plays.alias("playcount"), F.when(listeners > 0, F.round(plays / listeners, 2)).otherwise(0.0).alias("ratio"), (F.length(F.trim(F.coalesce(a["bio"]["summary"], F.lit("")))) > 0).alias("bio"), _texts(F.transform(a["tags"]["tag"], lambda t: t["name"])).alias("tags"))


def monthly_views(raw: Column) -> Column:
    """The mean views of a month, without its fraction."""
    items = F.from_json(raw, VIEWS)["items"]
    return F.when(F.size(items) > 0, F.floor(F.aggregate(items, F.lit(0).cast("long"), lambda n, i: n + i["views"]) / F.size(items))).otherwise(0)


def songkick(raw: Column) -> Column:
    """Past events, first and last day, countries; event types without repeats."""
    e = F.from_json(raw, EVENTS)["events"]
    return F.struct(F.size(e).alias("events"), F.array_min(F.transform(e, lambda x: x["start"])).alias("first"), F.array_max(F.transform(e, lambda x: x["start"])).alias("last"), F.array_distinct(F.transform(e, lambda x: text.city_country(x["location"])[1])).alias("countries"), F.array_distinct(F.transform(e, lambda x: x["type"])).alias("types"))


def registry(raw: Column, name: Column) -> Column:
    """Works, the artist's mean share (-1: unknown) and whether all of its shares are 0."""
    works = F.from_json(raw, WORKS)["works"]
    own = F.flatten(F.transform(works, lambda w: F.filter(w["writers"], lambda x: F.lower(x["name"]) == F.lower(name))))
    shares = F.filter(F.transform(own, lambda x: x["share"]), lambda s: s.isNotNull())
    total = F.aggregate(shares, F.lit(0.0), lambda n, s: n + s)
    return F.struct(F.size(works).alias("works"), (F.size(own) > 0).alias("registered"), F.when(F.size(shares) > 0, total / F.size(shares)).otherwise(-1.0).alias("share"), ((F.size(shares) > 0) & (total == 0)).alias("zero_share"), F.array_distinct(F.flatten(F.transform(works, lambda w: F.transform(w["publishers"], lambda p: p["name"])))).alias("publishers"))


def records(profiles: DataFrame) -> DataFrame:
    """Enriched profiles (sources.files.PROFILE) as records for measures(); what a profile doesn't hold is null. Durations are taken as seconds."""
    c = F.col
    albums = c("deezer.albums")
    of_type = lambda *kinds: F.size(F.filter(F.coalesce(albums, F.array().cast("array<struct<title:string,label:string,release_date:string,nb_tracks:string,type:string>>")), lambda a: F.lower(a["type"]).isin(*kinds)))
    made = {
        "artist_id": c("artist_id"), "name": c("artist_name"), "genres": c("musicbrainz.genres"), "album_count": of_type("album"), "single_count": of_type("single", "ep"), "release_dates": F.transform(albums, lambda a: a["release_date"]), "track_durations": F.transform("deezer.track_durations", lambda s: s * 1000), "labels": c("deezer.labels"),
        "track_titles": c("deezer.track_titles"), "track_ranks": c("deezer.track_ranks"), "contributors": c("deezer.contributors"), "contributor_roles": c("deezer.contributor_roles"), "related_artist_names": c("deezer.related_artists"), "deezer_fans": c("deezer.nb_fan"),
        "genius_found": c("genius.found"), "genius_song_count": c("genius.song_count"), "genius_description": c("genius.description_snippet"), "genius_facebook_name": c("genius.facebook_name"), "genius_instagram_name": c("genius.instagram_name"), "genius_twitter_name": c("genius.twitter_name"), "genius_is_verified": c("genius.is_verified"), "genius_followers_count": c("genius.followers_count"), "genius_alternate_names": c("genius.alternate_names"),
        "discogs_found": c("discogs.found"), "discogs_physical_releases": c("discogs.physical_releases"), "discogs_digital_releases": c("discogs.digital_only_releases"), "discogs_total_releases": c("discogs.total_releases"), "discogs_labels": c("discogs.labels"), "discogs_profile": c("discogs.profile"), "discogs_realname": c("discogs.realname"), "discogs_social_urls": c("discogs.social_urls"), "discogs_members": c("discogs.members"), "discogs_groups": c("discogs.groups"), "discogs_data_quality": c("discogs.data_quality"),
        "setlistfm_found": c("setlistfm.found"), "setlistfm_total_shows": c("setlistfm.total_setlists"), "musicbrainz_found": c("musicbrainz.found"), "musicbrainz_type": c("musicbrainz.type"), "musicbrainz_country": c("musicbrainz.country"), "musicbrainz_begin_date": c("musicbrainz.begin_date"), "musicbrainz_labels": c("musicbrainz.labels"), "musicbrainz_urls": c("musicbrainz.urls"), "musicbrainz_genres": c("musicbrainz.genres"), "musicbrainz_aliases": c("musicbrainz.aliases"), "musicbrainz_isnis": c("musicbrainz.isnis"), "musicbrainz_ipis": c("musicbrainz.ipis"), "musicbrainz_gender": c("musicbrainz.gender"),
        "lastfm_found": c("lastfm.found"), "lastfm_listeners": c("lastfm.listeners"), "lastfm_playcount": c("lastfm.playcount"), "lastfm_listener_play_ratio": c("lastfm.listener_play_ratio"), "lastfm_bio_exists": c("lastfm.bio_exists"),
    }
    schema = profiles.sparkSession.createDataFrame([], RECORD).schema
    return profiles.select(*[(made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
