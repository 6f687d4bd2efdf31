"""Profiles, blocklists, the feature matrix, raw responses, reports and streams, over files that the tests write."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.sources import connectors, files
from lodestone.sources.dossier import lists_of, measures
from lodestone.streaming.health import drop_expired_duplicates, write_crossings


def test_profiles(spark, tmp_path):
    none = {"found": False, "raw": None}
    whole = {"artist_name": "A", "artist_id": "1", **{p: none for p in files.PLATFORMS}, "deezer": {"found": True, "nb_fan": 7, "track_durations": [], "albums": [{"type": "Album", "release_date": "2020-01-02", "nb_tracks": 3}, {"type": "ep"}], "contributor_roles": {"Loud Luxury": ["Main"]}}}
    for name, body in (("a.json", json.dumps(whole, indent=1)), ("b.json", json.dumps({"artist_name": "B", "artist_id": "2", "lastfm": {"found": True, "listeners": 60}})), ("_progress.json", "{}"), ("c.json", "{broken")):
        (tmp_path / name).write_text(body)
    rows, bad = files.read_profiles(spark, str(tmp_path))
    assert sorted(r["artist_name"] for r in rows.collect()) == ["A", "B"] and bad.count() == 1
    seeds = spark.createDataFrame([("A",), ("B",), ("C",)], "artist_name string")
    assert sorted(r[0] for r in files.to_enrich(seeds, rows).collect()) == ["B", "C"]
    got = {r["name"]: r for r in measures(connectors.records(rows), lists_of(spark)).collect()}
    assert (got["A"]["fans"], got["A"]["albums"], got["A"]["singles"], got["A"]["n_dates"], got["A"]["platforms"]) == (7, 1, 1, 1, 1)
    assert (got["B"]["lastfm_listeners"], got["B"]["platforms"], got["B"]["albums"]) == (60, 1, 0)


def test_blocklists(spark, tmp_path):
    (tmp_path / "flat.json").write_text('["Firefly", " Epidemic "]')
    (tmp_path / "nested.json").write_text(json.dumps({"entities": [{"name": "One", "aliases": ["Uno", "ONE "], "source": "x"}, {"name": "Two", "aliases": ["uno"]}]}))
    names = lambda f: {r["name"]: r["entity"] for r in files.read_blocklist(spark, str(tmp_path / f)).collect()}
    assert names("flat.json") == {"firefly": "Firefly", "epidemic": " Epidemic "}
    assert names("nested.json") == {"one": "One", "uno": "Two", "two": "Two"} and names("gone.json") == {}
    artists = spark.createDataFrame([("b", "confirmed_bad"), ("a", "confirmed_bad"), ("b", "confirmed_bad"), ("c", "cleared")], "name string, threat_status string")
    files.write_blocklist(artists.coalesce(1), str(tmp_path / "out"))
    assert sorted(json.loads(r[0])["name"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_features_and_raw_responses(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.5, 2, 1), ("y, z", None, 3, 0)], "artist_name string, b double, a int, is_corpus int")
    files.write_features(rows, str(tmp_path / "f"))
    back = files.read_features(spark, str(tmp_path / "f"))
    assert back.columns == ["artist_name", "a", "b", "is_corpus"] and sorted(map(tuple, back.collect())) == [("x", 2.0, 1.5, 1.0), ("y, z", 3.0, None, 0.0)]
    files.write_raw(spark.createDataFrame([(1, "genius", "{}"), (1, "discogs", "{}")], "artist_id int, source string, body string"), str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw" / "artist_id=1").iterdir()) == ["source=discogs", "source=genius"]


def test_report_and_round_trip(spark):
    playlists = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "playlist string, artist_id long")
    artists = spark.createDataFrame([(1, "A", "Verified Artist", 90), (2, "B", "Suspicious", 30)], "artist_id long, name string, verdict string, score long")
    evidence = spark.createDataFrame([(2, 1, "red_flag", "weak", "f", "s")], "artist_id long, seq int, evidence_type string, strength string, finding string, source string")
    got = {r["playlist"]: json.loads(r["body"]) for r in files.report(playlists, artists, evidence).collect()}
    assert [a["name"] for a in got["p"]["artists"]] == ["B", "A"] and got["p"]["summary"] == {"n_artists": 2, "mean_score": 60}
    assert got["p"]["artists"][0]["evidence"][0]["finding"] == "f"
    results = spark.createDataFrame([(1, 7, "Suspicious", 30), (1, 8, "Verified Artist", 9), (2, 7, "x", 1)], "scan_id long, artist_id long, verdict string, score long")
    texts = files.nested_scans(results).select(F.to_json(F.struct("*")).alias("value"))
    back = files.imported(texts.union(spark.createDataFrame([("no json",)], "value string")))
    assert sorted(map(tuple, back.select(*results.columns).collect())) == sorted(map(tuple, results.collect()))


def test_expiring_duplicates_of_a_table(spark):
    """A key counts again once its last row is older than the time to live."""
    rows = spark.createDataFrame([("a", 0), ("a", 50), ("a", 200), ("b", 10), ("a", 250)], "k string, s long").select("k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "s")
    assert sorted((r["k"], r["s"]) for r in drop_expired_duplicates(rows, "k", "100 seconds").collect()) == [("a", 0), ("a", 200), ("b", 10)]


def test_crossings_are_written_once(spark, tmp_path):
    """A key that stays over the threshold is written with the batch in which it crossed, and a repeated batch writes it once."""
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('a', id % 2) AS api_name", "id")
    rows(0, 10).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("api_name string, id long").parquet(str(tmp_path / "in")).groupBy("api_name").agg(F.count("*").alias("n"))
    for lo in (10, 20):
        q = write_crossings(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), 5)
        q.processAllAvailable()
        q.stop()
        rows(lo, lo + 10).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["api_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a0", "a1"]
