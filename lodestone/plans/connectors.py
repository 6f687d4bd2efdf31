"""The parse stage over responses that are written from the tables: the oracle reads the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources import connectors as c
from lodestone.sources.dossier import lists_of, measures
from lodestone.sources.files import PROFILE


@query("SELECT playlist_id, CAST(count(*) AS BIGINT) AS tracks, CAST(count(DISTINCT artist_id) AS BIGINT) AS artists, CAST(sum(artist_id % 300) * 1000 AS BIGINT) AS total_ms FROM b_playlist_track GROUP BY 1")
def parse_playlist(spark, d):
    a = F.col("artist_id").cast("string")
    person = F.struct(F.when(F.col("artist_id") % 3 == 0, a).alias("id"), a.alias("name"), F.when(F.col("artist_id") % 3 == 1, F.concat(F.lit("spotify:artist:"), a)).alias("uri"), F.concat(F.lit("https://open.example/artist/"), a).alias("link"))
    track = F.struct(a.alias("name"), ((F.col("artist_id") % 300) * 1000).cast("string").alias("duration_ms"), F.array(person).alias("artists"))
    raw = b.playlist_tracks(spark, d).groupBy("playlist_id").agg(F.to_json(F.struct(F.collect_list(track).alias("tracks"))).alias("raw"))
    rows = raw.select("playlist_id", c.playlist(F.col("raw")).alias("p"))
    return rows.select("playlist_id", F.col("p.tracks").cast("long").alias("tracks"), F.size("p.artist_ids").cast("long").alias("artists"), F.aggregate("p.durations", F.lit(0).cast("long"), lambda s, x: s + x).alias("total_ms"))


@query("""SELECT r.artist_id, CAST(count(*) FILTER (rtype = 'album') AS BIGINT) AS albums, CAST(count(*) FILTER (rtype <> 'album') AS BIGINT) AS singles, CAST(min(release_date) AS VARCHAR) AS first, CAST(sum(CAST(floor(track_rank) AS BIGINT)) AS BIGINT) AS ranks, string_agg(DISTINCT 'A' || (release_id % 4) || 'X', ',' ORDER BY 'A' || (release_id % 4) || 'X') AS registrants,
    string_agg(DISTINCT 'L' || (release_id % 5), ',' ORDER BY 'L' || (release_id % 5)) AS labels, CAST(count(DISTINCT release_id % 3) AS BIGINT) AS contributors, CASE WHEN bool_or(release_id % 3 = 0 AND rtype = 'album') AND bool_or(release_id % 3 = 0 AND rtype <> 'album') THEN 'Main,Writer' WHEN bool_or(release_id % 3 = 0 AND rtype = 'album') THEN 'Main' WHEN bool_or(release_id % 3 = 0) THEN 'Writer' END AS roles FROM b_release r GROUP BY 1""")
def parse_deezer(spark, d):
    k, album = F.col("release_id"), F.col("rtype") == "album"
    record = F.struct(F.col("rtype").alias("record_type"), F.col("release_date").cast("string").alias("release_date"), F.concat(F.lit("L"), k % 5).alias("label"))
    person = F.struct(F.concat(F.lit("N"), k % 3).alias("name"), F.when(album, "Main").otherwise("Writer").alias("role"))
    track = F.struct((k % 200).alias("duration"), F.floor("track_rank").alias("rank"), F.concat(F.lit("US-A"), k % 4, F.lit("X-24-00001")).alias("isrc"), F.array(person).alias("contributors"))
    raw = b.releases(spark, d).groupBy("artist_id").agg(F.to_json(F.struct(F.collect_list(record).alias("albums"), F.collect_list(track).alias("tracks"))).alias("raw"))
    rows = raw.select("artist_id", c.deezer(F.col("raw")).alias("p")).select("artist_id", "p.*")
    return rows.select("artist_id", F.col("albums").cast("long").alias("albums"), F.col("singles").cast("long").alias("singles"), F.get("dates", F.lit(0)).alias("first"), F.aggregate("ranks", F.lit(0).cast("long"), lambda s, x: s + x).alias("ranks"), F.array_join("registrants", ",").alias("registrants"), F.array_join("labels", ",").alias("labels"), F.size("contributors").cast("long").alias("contributors"), F.array_join(F.element_at("contributor_roles", F.lit("N0")), ",").alias("roles"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Group' ELSE 'Person' END AS type, CAST(1900 + s_nationkey AS VARCHAR) AS begin, 'rock,folk' AS genres, 'https://b/' || s_suppkey AS homepage, CAST(2 AS BIGINT) AS labels, CASE WHEN s_suppkey % 3 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS isnis, 'Q1Z' AS registrants FROM supplier")
def parse_musicbrainz(spark, d):
    k = F.col("s_suppkey")
    rel = lambda kind, url: F.struct(F.lit(kind).alias("type"), F.struct(url.alias("resource")).alias("url"))
    label = lambda n: F.struct(F.struct(F.lit(n).alias("name")).alias("label"))
    body = F.struct(
        F.when(k % 2 == 0, "Group").otherwise("Person").alias("type"), F.struct((F.col("s_nationkey") + 1900).cast("string").alias("begin")).alias("life-span"), F.array(F.struct(F.lit("folk").alias("name"), F.lit(2).alias("count")), F.struct(F.lit("rock").alias("name"), F.lit(9).alias("count"))).alias("tags"), F.when(k % 3 == 0, F.array(F.lit("0001"))).alias("isnis"),
        F.array(rel("official homepage", F.concat(F.lit("https://a/"), k)), rel("official homepage", F.concat(F.lit("https://b/"), k))).alias("relations"), F.array(F.struct(F.array(label("x"), label("y")).alias("label-info")), F.struct(F.array(label("x")).alias("label-info"))).alias("releases"), F.array(F.lit("GB-Q1Z-20-1"), F.lit("GBQ1Z2000002")).alias("isrcs"),
    )
    rows = b.table(spark, d, "supplier").select(k.alias("id"), c.musicbrainz(F.to_json(body)).alias("p"))
    return rows.select("id", "p.type", "p.begin", F.array_join("p.genres", ",").alias("genres"), F.element_at("p.urls", F.lit("official homepage")).alias("homepage"), F.size("p.labels").cast("long").alias("labels"), F.size("p.isnis").cast("long").alias("isnis"), F.array_join("p.registrants", ",").alias("registrants"))


@query("""SELECT o_custkey AS artist_id, CAST(count(*) AS BIGINT) AS releases, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS physical, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_show, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_show, CAST(count(DISTINCT 'V' || (o_orderkey % 4)) AS BIGINT) AS venues,
    round(sum(o_orderkey % 900) / count(*), 2) AS ratio, CAST(floor(sum(o_orderkey % 500) / count(*)) AS BIGINT) AS views, CAST(count(DISTINCT 'C' || (o_orderkey % 2)) AS BIGINT) AS countries, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN round(avg(o_orderkey % 100) FILTER (o_orderkey % 2 = 0), 4) ELSE -1 END AS share FROM orders GROUP BY 1""")
def parse_sources(spark, d):
    """The other sources' responses, one of each for every artist."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    place = F.struct(F.concat(F.lit("V"), k % 4).alias("name"), F.struct(F.lit("c").alias("name"), F.struct(F.lit("land").alias("name")).alias("country")).alias("city"))
    event = F.struct(F.lit("Concert").alias("type"), F.date_format(day, "yyyy-MM-dd").alias("start"), F.concat(F.lit("Town, C"), k % 2).alias("location"))
    work = F.struct(F.array(F.struct(F.when(k % 2 == 0, "ME").otherwise("other").alias("name"), (k % 100).cast("double").alias("share"))).alias("writers"), F.array(F.struct(F.lit("p").alias("name"))).alias("publishers"))
    raw = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("artist_id")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.when(k % 3 == 0, "File, Vinyl").otherwise("MP3").alias("format"))).alias("releases"))).alias("discogs"), F.to_json(F.struct(F.collect_list(F.struct(F.date_format(day, "dd-MM-yyyy").alias("eventDate"), place.alias("venue"))).alias("setlist"))).alias("setlistfm"),
        F.to_json(F.struct(F.struct(F.struct(F.count("*").cast("string").alias("listeners"), F.sum(k % 900).cast("string").alias("playcount")).alias("stats")).alias("artist"))).alias("lastfm"), F.to_json(F.struct(F.collect_list(F.struct((k % 500).alias("views"))).alias("items"))).alias("views"), F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("songkick"), F.to_json(F.struct(F.collect_list(work).alias("works"))).alias("pro"),
    )
    rows = raw.select("artist_id", c.discogs(F.col("discogs")).alias("d"), c.setlistfm(F.col("setlistfm")).alias("s"), c.lastfm(F.col("lastfm")).alias("l"), c.monthly_views(F.col("views")).alias("views"), c.songkick(F.col("songkick")).alias("k"), c.registry(F.col("pro"), F.lit("me")).alias("p"))
    return rows.select("artist_id", F.col("d.total").cast("long").alias("releases"), F.col("d.physical").cast("long").alias("physical"), F.col("s.first").cast("string").alias("first_show"), F.col("s.last").cast("string").alias("last_show"), F.size("s.venues").cast("long").alias("venues"), "l.ratio", F.col("views").cast("long").alias("views"), F.size("k.countries").cast("long").alias("countries"), F.round("p.share", 4).alias("share"))


@query("""SELECT CAST(a.artist_id AS VARCHAR) AS artist_id, CAST(CASE WHEN a.artist_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN a.artist_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN floor(abs(fans)) > 0 THEN 1 ELSE 0 END AS BIGINT) AS platforms, CAST(floor(abs(fans)) AS BIGINT) AS fans, CAST(coalesce(n, 0) AS BIGINT) AS albums, CAST(coalesce(n, 0) AS BIGINT) AS n_dates, CAST(coalesce(days, 0) AS BIGINT) AS span_days,
    a.artist_id % 2 = 0 AS musicbrainz_found, CAST(CASE WHEN a.artist_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_social FROM b_artist a LEFT JOIN (SELECT artist_id, count(*) AS n, date_diff('day', min(release_date), max(release_date)) AS days FROM b_release GROUP BY 1) r USING (artist_id)""")
def profile_records(spark, d):
    """Enriched profiles as JSON, read with their schema, mapped to records and measured."""
    k = F.col("artist_id")
    albums = b.releases(spark, d).groupBy("artist_id").agg(F.collect_list(F.struct(F.lit("album").alias("type"), F.col("release_date").cast("string").alias("release_date"))).alias("albums"))
    rows = b.artists(spark, d).select("artist_id", "name", F.floor(F.abs("fans")).alias("fans")).join(albums, "artist_id", "left")
    urls = F.when(k % 2 == 0, F.create_map(F.lit("official homepage"), F.lit("https://home")))
    body = F.struct(F.col("name").alias("artist_name"), k.cast("string").alias("artist_id"), F.struct((k % 2 == 0).alias("found"), urls.alias("urls")).alias("musicbrainz"), F.struct(F.lit(True).alias("found"), F.col("fans").alias("nb_fan"), "albums").alias("deezer"), F.struct((k % 3 == 0).alias("found")).alias("lastfm"))
    profiles = rows.select(F.from_json(F.to_json(body), PROFILE).alias("p")).select("p.*")
    found = measures(c.records(profiles), lists_of(spark))
    return found.select("artist_id", *[F.col(x).cast("long").alias(x) for x in ("platforms", "fans", "albums", "n_dates", "span_days")], "musicbrainz_found", F.col("n_social").cast("long").alias("n_social"))
