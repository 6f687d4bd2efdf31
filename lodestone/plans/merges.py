"""Merges, counters and review states."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.rules import is_flagged
from lodestone.operators.merge import first_wins, last_wins, upsert
from lodestone.plans.base import query
from lodestone.sources import bindings as b

#: The delta of the upserts: every order of 1997 and after reports its customer, some with an empty genre. The old state has no artists with negative balances, which are new.
DELTA_SQL = "SELECT artist_id, release_id AS seq, CASE WHEN release_id % 3 = 0 THEN '' ELSE rtype END AS genre, CASE WHEN release_id % 5 = 0 THEN NULL ELSE track_rank END AS fans FROM b_release WHERE release_date >= DATE '1997-01-01'"


def delta(spark, d):
    rows = b.releases(spark, d).where("release_date >= DATE '1997-01-01'")
    return rows.select("artist_id", F.col("release_id").alias("seq"), F.when(F.col("release_id") % 3 == 0, "").otherwise(F.col("rtype")).alias("genre"), F.when(F.col("release_id") % 5 != 0, F.col("track_rank")).alias("fans"))


@query(f"""WITH n AS (SELECT artist_id, arg_max(genre, seq) FILTER (genre <> '') AS genre, arg_max(fans, seq) FILTER (fans IS NOT NULL) AS fans, count(*) AS k FROM ({DELTA_SQL}) GROUP BY 1)
    SELECT artist_id, coalesce(n.genre, a.genre) AS genre, coalesce(n.fans, a.fans) AS fans, CAST(coalesce(k, 0) AS BIGINT) AS scans FROM (SELECT * FROM b_artist WHERE fans >= 0) a FULL JOIN n USING (artist_id)""")
def upsert_artists(spark, d):
    old = b.artists(spark, d).where("fans >= 0").withColumn("scans", F.lit(0).cast("long"))
    return upsert(old, delta(spark, d), "artist_id", "seq", {"genre": "filled", "fans": "filled"}, "scans")


@query(f"""WITH n AS (SELECT artist_id, arg_max(genre, seq) AS genre, arg_max(fans, seq) FILTER (fans IS NOT NULL) AS fans, count(*) AS k FROM ({DELTA_SQL}) GROUP BY 1)
    SELECT artist_id, CASE WHEN k IS NOT NULL THEN n.genre ELSE a.genre END AS genre, coalesce(a.fans, n.fans) AS fans, CAST(coalesce(k, 0) + CASE WHEN a.artist_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS scans
    FROM (SELECT artist_id, genre, fans FROM b_artist WHERE fans >= 0) a FULL JOIN n USING (artist_id)""")
def save_artist_merge(spark, d):
    """Some columns are overwritten, be it by empty values, others kept from the first scan; the scans are counted on."""
    old = b.artists(spark, d).where("fans >= 0").withColumn("scans", F.lit(1).cast("long"))
    return upsert(old, delta(spark, d), "artist_id", "seq", {"genre": "given", "fans": "kept"}, "scans")


@query("""SELECT artist_id, songwriter_id, role, seq, source FROM (SELECT o_custkey AS artist_id, l_suppkey AS songwriter_id, l_returnflag AS role, l_orderkey AS seq, l_partkey AS source, row_number() OVER (PARTITION BY o_custkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""")
def link_dedupe(spark, d):
    """The first line of each link; order and line number aren't unique, so the part decides last."""
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("songwriter_id"), F.col("l_returnflag").alias("role"))
    rows = rows.join(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist_id")), "l_orderkey")
    return first_wins(rows, ["artist_id", "songwriter_id", "role"], ["l_orderkey", "l_linenumber", "source"]).select("artist_id", "songwriter_id", "role", F.col("l_orderkey").alias("seq"), "source")


@query("SELECT scan_id, artist_id, score, verdict FROM b_scan_result")
def scan_result_latest(spark, d):
    rows = b.table(spark, d, "orders").select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("scan_id"), F.col("o_custkey").alias("artist_id"), F.col("o_orderkey").alias("seq"), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000))).cast("long").alias("score"))
    from lodestone.functions.rules import score_label

    return last_wins(rows, ["scan_id", "artist_id"], "seq").select("scan_id", "artist_id", "score", score_label(F.col("score")).alias("verdict"))


@query("SELECT songwriter_id, CAST(count(DISTINCT artist_id) AS BIGINT) AS artist_count FROM b_songwriter LEFT JOIN b_credit USING (songwriter_id) GROUP BY 1")
def refresh_counts(spark, d):
    counts = b.credits(spark, d).groupBy("songwriter_id").agg(F.countDistinct("artist_id").alias("artist_count"))
    return b.songwriters(spark, d).select("songwriter_id").join(counts, "songwriter_id", "left").fillna(0, ["artist_count"])


SCANS_SQL = "SELECT artist_id, count(*) AS scans, arg_max(verdict, scan_id) AS verdict, CASE WHEN max(score) - min(score) < 60 THEN 'high' ELSE 'low' END AS confidence FROM b_scan_result GROUP BY 1"


@query(f"""SELECT artist_id, CASE WHEN threat_status IN ('confirmed_bad', 'cleared') THEN threat_status WHEN verdict = 'Likely Artificial' AND confidence = 'high' AND scans >= 2 THEN 'confirmed_bad'
    WHEN verdict = 'Verified Artist' AND confidence = 'high' AND scans >= 2 THEN 'cleared' WHEN verdict IN ('Suspicious', 'Likely Artificial') AND threat_status = 'unknown' THEN 'suspected' ELSE threat_status END AS status FROM b_artist JOIN ({SCANS_SQL}) USING (artist_id)""")
def auto_promote(spark, d):
    scans = b.scan_results(spark, d).groupBy("artist_id").agg(F.count("*").alias("scans"), F.max_by("verdict", "scan_id").alias("verdict"), F.when(F.max("score") - F.min("score") < 60, "high").otherwise("low").alias("confidence"))
    status, verdict, sure = F.col("threat_status"), F.col("verdict"), (F.col("confidence") == "high") & (F.col("scans") >= 2)
    new = F.when(status.isin("confirmed_bad", "cleared"), status).when((verdict == "Likely Artificial") & sure, "confirmed_bad").when((verdict == "Verified Artist") & sure, "cleared").when(is_flagged(verdict) & (status == "unknown"), "suspected").otherwise(status)
    return b.artists(spark, d).join(scans, "artist_id").select("artist_id", new.alias("status"))


FLAGS_SQL = "SELECT songwriter_id, count(DISTINCT CASE WHEN fans < 1000 THEN artist_id END) AS flagged, songwriter_id % 4 AS state FROM b_credit JOIN b_artist USING (artist_id) GROUP BY 1"


@query(f"""SELECT songwriter_id, CAST(flagged AS BIGINT) AS flagged, CASE WHEN state = 0 THEN 'confirmed_bad' WHEN state = 1 AND flagged <= 4 THEN 'dismissed' WHEN flagged >= 3 THEN 'pending_review' WHEN state = 2 THEN 'pending_review' ELSE 'unknown' END AS status FROM ({FLAGS_SQL})""")
def threshold_queue(spark, d):
    """Listed ones are left alone, dismissed ones come back above their requeue mark (4), pending ones stay."""
    rows = b.credits(spark, d).join(b.artists(spark, d).select("artist_id", "fans"), "artist_id").groupBy("songwriter_id").agg(F.countDistinct(F.when(F.col("fans") < 1000, F.col("artist_id"))).alias("flagged"))
    state, flagged = F.col("songwriter_id") % 4, F.col("flagged")
    status = F.when(state == 0, "confirmed_bad").when((state == 1) & (flagged <= 4), "dismissed").when(flagged >= 3, "pending_review").when(state == 2, "pending_review").otherwise("unknown")
    return rows.select("songwriter_id", "flagged", status.alias("status"))


@query(f"""SELECT songwriter_id, CASE state WHEN 0 THEN 'confirmed_bad' WHEN 1 THEN 'dismissed' ELSE 'pending_review' END AS status, CASE WHEN state = 1 THEN CAST(floor(flagged * 1.5) + 1 AS BIGINT) END AS requeue_at FROM ({FLAGS_SQL}) WHERE flagged >= 3""")
def review_decision(spark, d):
    rows = b.credits(spark, d).join(b.artists(spark, d).select("artist_id", "fans"), "artist_id").groupBy("songwriter_id").agg(F.countDistinct(F.when(F.col("fans") < 1000, F.col("artist_id"))).alias("flagged")).where("flagged >= 3")
    state = F.col("songwriter_id") % 4
    return rows.select("songwriter_id", F.when(state == 0, "confirmed_bad").when(state == 1, "dismissed").otherwise("pending_review").alias("status"), F.when(state == 1, F.floor(F.col("flagged") * 1.5) + 1).alias("requeue_at"))


@query("""WITH skipped AS (SELECT scan_id, artist_id FROM b_scan_result WHERE artist_id % 10 = 0), again AS (SELECT * FROM skipped WHERE artist_id % 20 = 0)
    SELECT scan_id, CAST(count(*) FILTER (artist_id % 10 <> 0 OR artist_id % 20 = 0) AS BIGINT) AS analysed, CAST(count(*) FILTER (artist_id % 10 = 0 AND artist_id % 20 <> 0) AS BIGINT) AS skipped FROM b_scan_result GROUP BY 1""")
def retry_merge(spark, d):
    """The first report without skipped artists, with those that a second run recovered; the others stay skipped."""
    every = b.scan_results(spark, d).select("scan_id", "artist_id")
    skipped = every.where("artist_id % 10 = 0")
    recovered = skipped.where("artist_id % 20 = 0")
    report = every.join(skipped, ["scan_id", "artist_id"], "left_anti").unionByName(recovered)
    still = skipped.join(recovered, ["scan_id", "artist_id"], "left_anti")
    counts = report.groupBy("scan_id").agg(F.count("*").alias("analysed")).join(still.groupBy("scan_id").agg(F.count("*").alias("skipped")), "scan_id", "full")
    return counts.fillna(0)
