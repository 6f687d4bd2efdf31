"""Files: profiles, blocklists, the feature matrix, raw responses, reports; as Spark reads and writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = """artist_name string, artist_id string, seed_source struct<origin:string,note:string>, enrichment_timestamp string,
  musicbrainz struct<found:boolean,mbid:string,type:string,country:string,area:string,begin_date:string,end_date:string,gender:string,genres:array<string>,aliases:array<string>,isnis:array<string>,ipis:array<string>,urls:map<string,string>,labels:array<string>,disambiguation_confidence:string,match_confidence:double,match_method:string>,
  deezer struct<found:boolean,deezer_id:bigint,name:string,nb_fan:bigint,nb_album:bigint,link:string,picture_url:string,labels:array<string>,contributors:array<string>,contributor_roles:map<string,array<string>>,track_titles:array<string>,track_durations:array<bigint>,track_ranks:array<bigint>,has_explicit:boolean,album_types:map<string,bigint>,albums:array<struct<title:string,label:string,release_date:string,nb_tracks:string,type:string>>,related_artists:array<string>,match_confidence:double,match_method:string>,
  genius struct<found:boolean,status:string,genius_id:bigint,name:string,song_count:bigint,description_snippet:string,facebook_name:string,instagram_name:string,twitter_name:string,is_verified:boolean,followers_count:bigint,alternate_names:array<string>,match_confidence:double,match_method:string>,
  discogs struct<found:boolean,discogs_id:bigint,name:string,profile:string,realname:string,social_urls:array<string>,members:array<string>,groups:array<string>,data_quality:string,physical_releases:bigint,digital_only_releases:bigint,total_releases:bigint,formats:array<string>,labels:array<string>,match_confidence:double,match_method:string>,
  setlistfm struct<found:boolean,status:string,total_setlists:bigint,first_show_date:string,last_show_date:string,top_venues:array<string>,venue_cities:array<string>,venue_countries:array<string>,tour_names:array<string>,match_confidence:double,match_method:string>,
  lastfm struct<found:boolean,name:string,mbid:string,listeners:bigint,playcount:bigint,listener_play_ratio:double,bio_exists:boolean,bio_summary:string,tags:array<string>,similar_artists:array<string>,url:string,match_confidence:double,match_method:string>,
  platforms_found array<string>, platforms_missing array<string>, platform_count bigint"""
PLATFORMS = ("musicbrainz", "deezer", "genius", "discogs", "setlistfm", "lastfm")
SCANS = "scan_id long, artists array<struct<artist_id:long,verdict:string,score:long>>"


def read_profiles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The profiles of a folder (a JSON object a file; names that begin with _ are skipped), and the texts of files that can't be read."""
    rows = spark.read.schema(f"{PROFILE}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.where("_bad IS NULL").drop("_bad"), rows.where("_bad IS NOT NULL AND artist_name IS NULL").select("artist_name", "_bad")  # Spark reads no file for _bad alone


def complete(profiles: DataFrame) -> DataFrame:
    """artist_name of profiles that have been asked of all six platforms."""
    every = F.lit(True)
    for p in PLATFORMS:
        every = every & F.col(f"{p}.found").isNotNull()
    return profiles.where(every).select("artist_name")


def to_enrich(seeds: DataFrame, profiles: DataFrame) -> DataFrame:
    """Seeds (artist_name) without a complete profile."""
    return seeds.join(complete(profiles), "artist_name", "left_anti")


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """name (lower case), entity, source, notes of a blocklist: an array of strings, or an object with entities and their aliases.

    A missing file is an empty list. Of equal names the last definition counts.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "name string, entity string, source string, notes string")
    whole = spark.read.text(path, wholetext=True)
    flat = F.transform(F.from_json("value", "array<string>"), lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("notes")))
    nested = F.from_json("value", "entities array<struct<name:string,aliases:array<string>,source:string,notes:string>>")["entities"]
    entries = whole.select(F.posexplode(F.coalesce(F.when(F.ltrim("value").startswith("["), flat), nested)).alias("at", "e")).where("e.name IS NOT NULL")
    names = entries.select("at", "e.*", F.explode(F.array_union(F.array("e.name"), F.coalesce("e.aliases", F.array().cast("array<string>")))).alias("known"))
    last = names.groupBy(F.lower(F.trim("known")).alias("key")).agg(F.max_by(F.struct(F.col("name").alias("entity"), "source", "notes"), "at").alias("e"))
    return last.select(F.col("key").alias("name"), "e.*")


def write_blocklist(artists: DataFrame, path: str) -> None:
    """The names of confirmed bad entities (name, threat_status), without repeats and in order, a JSON string each."""
    names = artists.where("threat_status = 'confirmed_bad'").select("name").distinct()
    names.repartitionByRange("name").sortWithinPartitions("name").select(F.to_json(F.struct("name")).alias("value")).write.text(path)


def write_features(features: DataFrame, path: str) -> None:
    """The matrix as CSV: artist_name, the features by name, is_corpus."""
    names = sorted(c for c in features.columns if c not in ("artist_name", "is_corpus"))
    features.select("artist_name", *names, "is_corpus").write.option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The matrix read back; what is no number is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("artist_name", *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in rows.columns if c != "artist_name"])


def write_raw(responses: DataFrame, path: str) -> None:
    """Raw responses (artist_id, source, body), a folder for each artist and source."""
    responses.write.partitionBy("artist_id", "source").mode("append").json(path)


def nested_scans(results: DataFrame) -> DataFrame:
    """scan_id and artists, an array in order of score: one object a scan."""
    items = F.array_sort(F.collect_list(F.struct("score", "artist_id", "verdict")))
    rows = results.groupBy("scan_id").agg(items.alias("items"))
    return rows.select("scan_id", F.transform("items", lambda a: F.struct(a["artist_id"].alias("artist_id"), a["verdict"].alias("verdict"), a["score"].alias("score"))).alias("artists"))


def imported(texts: DataFrame) -> DataFrame:
    """(value: a scan as JSON) -> scan_id, artist_id, verdict, score, tier; what can't be read gives nothing."""
    rows = texts.select(F.from_json("value", SCANS).alias("s")).select("s.scan_id", F.inline("s.artists"))
    return rows.withColumn("tier", F.lit("imported"))


def report(playlists: DataFrame, artists: DataFrame, evidence: DataFrame) -> DataFrame:
    """playlist and body: a JSON object of the playlist with its artists, most concerning first, and their findings.

    playlists: playlist, artist_id; artists: artist_id, name, verdict, score; evidence: artist_id, seq and what a finding has.
    """
    from lodestone.functions.rules import lookup
    from lodestone.operators.evaluation import SEVERITY

    found = evidence.groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct("seq", "evidence_type", "strength", "finding", "source"))).alias("evidence"))
    rows = playlists.join(artists, "artist_id").join(found, "artist_id", "left")
    item = F.struct(lookup(SEVERITY, F.col("verdict")).alias("severity"), (-F.col("score")).alias("order"), "artist_id", "name", "verdict", "score", "evidence")
    whole = rows.groupBy("playlist").agg(F.count("*").alias("n_artists"), F.floor(F.avg("score")).alias("mean_score"), F.array_sort(F.collect_list(item)).alias("items"))
    shown = F.transform("items", lambda i: F.struct(i["artist_id"].alias("artist_id"), i["name"].alias("name"), i["verdict"].alias("verdict"), i["score"].alias("score"), i["evidence"].alias("evidence")))
    return whole.select("playlist", F.to_json(F.struct("playlist", F.struct("n_artists", "mean_score").alias("summary"), shown.alias("artists"))).alias("body"))
