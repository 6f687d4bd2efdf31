from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.evidence import MOST_PER_TAG, deduplicate
from lodestone.operators.merge import first_wins, last_wins, upsert
from lodestone.operators.statistics import mann_whitney
from lodestone.streaming.health import drop_expired_duplicates, stale_sessions, windowed_health, write_crossings

EVIDENCE = "artist_id long, seq int, evidence_type string, strength string, finding string, source string, tags array<string>"


def fold(rows):
    """The two passes as plain loops."""
    rank = {"strong": 3, "moderate": 2, "weak": 1}
    seen = {}
    for r in rows:
        key = (r[5], r[4])
        if key not in seen or rank[r[3]] > rank[seen[key][3]]:
            seen[key] = r
    kept, counts = [], Counter()
    for r in sorted(seen.values(), key=lambda r: -rank[r[3]]):
        tags = r[6] or []
        if r[2] != "neutral" and tags:
            if any(counts[t] >= MOST_PER_TAG for t in tags):
                continue
            counts.update(set(tags))
        kept.append((r[4], r[3]))
    return kept


def test_deduplicate_is_the_plain_fold(spark):
    import random

    random.seed(3)
    rows = []
    for artist in range(30):
        for seq in range(random.randint(1, 14)):
            rows.append((artist, seq, random.choice(["red_flag", "green_flag", "neutral"]), random.choice(["strong", "moderate", "weak"]), f"f{random.randint(0, 9)}", f"s{random.randint(0, 1)}", random.sample(["a", "b", "c"], random.randint(0, 2)) or None))
    got = {r["artist_id"]: [(i["finding"], i["strength"]) for i in r["items"]] for r in deduplicate(spark.createDataFrame(rows, EVIDENCE)).collect()}
    for artist in {r[0] for r in rows}:
        assert got[artist] == fold([r for r in rows if r[0] == artist])


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", 5, 1), (2, "b", 6, 1)], "k long, name string, fans long, scans long")
    delta = spark.createDataFrame([(1, 1, "x", None), (1, 2, "", 9), (3, 1, "c", 7)], "k long, seq long, name string, fans long")
    rows = upsert(old, delta, "k", "seq", {"name": "filled", "fans": "kept"}, "scans").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 5, 3), (2, "b", 6, 1), (3, "c", 7, 1)]
    rows = upsert(old, delta, "k", "seq", {"name": "given", "fans": "filled"}).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "", 9), (2, "b", 6), (3, "c", 7)]


def test_first_and_last_wins(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k long, seq long, v string")
    assert sorted(r["v"] for r in first_wins(rows, ["k"], "seq").collect()) == ["a", "b"]
    assert sorted(r["v"] for r in last_wins(rows, ["k"], "seq").collect()) == ["b", "c"]
    ties = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "c")], "k long, seq long, v string")
    assert first_wins(ties, ["k"], "seq").first()["v"] == "a" and last_wins(ties, ["k"], "seq").first()["v"] == "c"


def test_mann_whitney_by_pairs(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    rows = spark.createDataFrame([("f", v, 1) for v in x] + [("f", v, 0) for v in y], "feature string, value double, label int")
    wins = sum((a > b) + (a == b) / 2 for a in x for b in y)
    assert mann_whitney(rows).first()["u"] == min(wins, 12 - wins)


@pytest.mark.parametrize(("credit", "artist"), [("Drake (feat. Future)", "Drake"), ("A, B", "A"), ("Simon and Garfunkel", "Simon and Garfunkel"), ("Florence and the Machine", "Florence and the Machine"), ("Song prod. X", "Song"), ("A x B", "A"), (None, None), (" ", " ")])
def test_primary_artist(spark, credit, artist):
    rows = spark.createDataFrame([(credit,)], "c string")
    assert rows.select(text.primary_artist(F.col("c"), ("simon and garfunkel",))).first()[0] == artist


def test_similarity():
    assert text.similarity("Ke$ha", "Kesha") == 1.0
    assert text.similarity("Beyoncé", "beyonce") == 1.0
    assert text.similarity("abc", "xyz") < 0.2
    assert text.similarity("The Beatles", "Beatles, The") > text.similarity("The Beatles", "The Eagles")


def test_normalize_entity(spark):
    rows = spark.createDataFrame([("  Sony Music Entertainment ",), ("Ünï Records",), (None,)], "n string")
    assert [r[0] for r in rows.select(text.normalize_entity(F.col("n"))).collect()] == ["sony", "n", None]


def test_streams(spark, tmp_path):
    calls = "event_id long, api_name string, ts timestamp, status_code int"
    rows = spark.range(200).selectExpr("id AS event_id", "concat('a', id % 3) AS api_name", "timestamp_seconds(1700000000 + id * 60) AS ts", "CASE WHEN id % 5 = 0 THEN 500 ELSE 200 END AS status_code")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls).parquet(str(tmp_path / "in"))
    q = windowed_health(stream, "1 hour").writeStream.format("memory").queryName("health").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["api_name"], r["start"])
    assert sorted(spark.table("health").collect(), key=key) == sorted(windowed_health(rows, "1 hour").collect(), key=key)
    q = drop_expired_duplicates(stream.withColumn("k", F.col("event_id") % 7), "k", "5 hours").writeStream.format("memory").queryName("fresh").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 7
    assert stale_sessions(rows, "api_name", "4 minutes").count() == 3
    counts = stream.groupBy("api_name").agg(F.count("*").alias("n"))
    q = write_crossings(counts, str(tmp_path / "out"), str(tmp_path / "cp"), 67)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["api_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a0", "a1"]
