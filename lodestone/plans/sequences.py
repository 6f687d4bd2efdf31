"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators.collectors import collect
from lodestone.operators.evidence import strongest
from lodestone.operators.network import limit_per
from lodestone.operators.statistics import running
from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources.dossier import dossiers


@query("""WITH g AS (SELECT artist_id, date_diff('day', lag(release_date) OVER (PARTITION BY artist_id ORDER BY release_date), release_date) AS gap FROM b_release)
    SELECT artist_id, CAST(count(gap) AS BIGINT) AS n, round(avg(gap), 4) AS mean_days, round(coalesce(stddev_samp(gap), 0) / avg(gap), 4) AS cv FROM g WHERE gap > 0 GROUP BY 1""")
def release_intervals(spark, d):
    """Days between releases without those of the same day; the variation is 0 for fewer than two."""
    before = F.lag("release_date").over(Window.partitionBy("artist_id").orderBy("release_date"))
    gaps = b.releases(spark, d).select("artist_id", F.datediff("release_date", before).alias("gap")).where("gap > 0")
    mean = F.avg("gap")
    return gaps.groupBy("artist_id").agg(F.count("gap").alias("n"), F.round(mean, 4).alias("mean_days"), F.round(F.coalesce(F.stddev_samp("gap"), F.lit(0.0)) / mean, 4).alias("cv"))


@query("SELECT artist_id, CAST(date_diff('day', min(release_date), max(release_date)) AS BIGINT) AS days FROM b_release GROUP BY 1")
def career_lifespan(spark, d):
    return b.releases(spark, d).groupBy("artist_id").agg(F.datediff(F.max("release_date"), F.min("release_date")).cast("long").alias("days"))


#: Releases in a month that are a burst (fixed value).
BURST = 10


def months_with(rows, least=BURST):
    """artist_id, month, n: months in which so many of rows (artist_id, release_date) came out."""
    return rows.groupBy("artist_id", F.date_format("release_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


@query("SELECT artist_id, strftime(release_date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM b_track GROUP BY 1, 2 HAVING count(*) >= 10")
def burst_months(spark, d):
    return months_with(b.tracks(spark, d))


@query("""WITH r AS (SELECT artist_id, track_rank, row_number() OVER (PARTITION BY artist_id ORDER BY track_rank DESC, release_id) AS rn, count(*) OVER (PARTITION BY artist_id) AS n FROM b_release)
    SELECT artist_id, round(sum(track_rank) FILTER (rn <= 1) / sum(track_rank), 4) AS top1, round(sum(track_rank) FILTER (rn <= 2) / sum(track_rank), 4) AS top2, round(sum(track_rank) FILTER (rn <= 3) / sum(track_rank), 4) AS top3 FROM r WHERE n >= 4 GROUP BY 1""")
def top_track_share(spark, d):
    own = Window.partitionBy("artist_id")
    rows = b.releases(spark, d).withColumns({"rn": F.row_number().over(own.orderBy(F.desc("track_rank"), "release_id")), "n": F.count("*").over(own)}).where("n >= 4")
    share = lambda k: F.round(F.sum(F.when(F.col("rn") <= k, F.col("track_rank"))) / F.sum("track_rank"), 4).alias(f"top{k}")
    return rows.groupBy("artist_id").agg(*[share(k) for k in (1, 2, 3)])


@query("SELECT nation_id, artist_id, fans FROM b_artist QUALIFY row_number() OVER (PARTITION BY nation_id ORDER BY fans DESC, artist_id) <= 10")
def top_per_nation(spark, d):
    return limit_per(b.artists(spark, d).select("nation_id", "artist_id", "fans"), "nation_id", [F.desc("fans"), F.col("artist_id")], 10)


@query("""SELECT artist_id, min(release_date) AS first_date, max(release_date) AS last_date, arg_min(rtype, release_date::VARCHAR || lpad(release_id::VARCHAR, 12, '0')) AS first_type, arg_max(rtype, release_date::VARCHAR || lpad(release_id::VARCHAR, 12, '0')) AS last_type FROM b_release GROUP BY 1""")
def first_last_release(spark, d):
    at = F.struct("release_date", "release_id")
    return b.releases(spark, d).groupBy("artist_id").agg(F.min("release_date").alias("first_date"), F.max("release_date").alias("last_date"), F.min_by("rtype", at).alias("first_type"), F.max_by("rtype", at).alias("last_type"))


RAW_EVIDENCE_SQL = "SELECT * FROM b_found UNION ALL SELECT artist_id, seq + 5, collector, evidence_type, CASE strength WHEN 'weak' THEN 'strong' ELSE 'weak' END, finding, source, tags FROM b_found WHERE artist_id % 3 = 0"


def raw_evidence(spark, d):
    """Findings with a second, differently strong copy for every third artist."""
    rows = collect(dossiers(spark, d))
    again = rows.where("artist_id % 3 = 0").withColumn("seq", F.col("seq") + 5).withColumn("strength", F.when(F.col("strength") == "weak", "strong").otherwise("weak"))
    return rows.unionByName(again)


@query(f"""WITH r AS ({RAW_EVIDENCE_SQL}) SELECT artist_id, source, finding, strength, seq, min(seq) OVER (PARTITION BY artist_id, source, finding) AS first_seq FROM r
    QUALIFY row_number() OVER (PARTITION BY artist_id, source, finding ORDER BY CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END DESC, seq) = 1""")
def dedup_pass1(spark, d):
    return strongest(raw_evidence(spark, d)).select("artist_id", "source", "finding", "strength", "seq", "first_seq")


#: Failed calls in a row that open the breaker (fixed value).
BREAKER = 15


@query(f"""WITH o AS (SELECT api_name, event_id, status_code >= 400 AS bad, row_number() OVER (PARTITION BY api_name ORDER BY ts, event_id) AS n FROM b_api_call),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY api_name, bad ORDER BY n) AS run FROM o) SELECT api_name, CAST(min(n) AS BIGINT) AS first_call, CAST(count(*) AS BIGINT) AS length, count(*) >= {BREAKER} AS opens FROM r WHERE bad GROUP BY api_name, run""")
def circuit_breaker(spark, d):
    """All runs of failed calls, by API, and whether a run opens the breaker: it has at least BREAKER (gaps and islands)."""
    rows = b.api_calls(spark, d).select("api_name", "event_id", "ts", F.to_date("ts").alias("day"), (F.col("status_code") >= 400).cast("long").alias("bad"))
    rows = running(rows, ["api_name"], "day", ["ts", "event_id"], {"n": F.lit(1), "n_bad": F.col("bad")}).where("bad = 1").withColumn("run", F.col("n") - F.col("n_bad"))
    return rows.groupBy("api_name", "run").agg(F.min("n").cast("long").alias("first_call"), F.count("*").alias("length")).select("api_name", "first_call", "length", (F.col("length") >= BREAKER).alias("opens"))


@query("SELECT api_name, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (status_code >= 400) AS BIGINT) AS bad FROM b_api_call GROUP BY 1, 2")
def api_health_daily(spark, d):
    """The batch form of streaming.health.windowed_health()."""
    from lodestone.streaming.health import windowed_health

    rows = windowed_health(b.api_calls(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return rows.select("api_name", F.date_format("start", "yyyy-MM-dd").alias("day"), "calls", "bad")
