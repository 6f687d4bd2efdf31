"""Grouped aggregates over the bound relations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from lodestone.functions.rules import VERDICT_HEALTH, is_flagged, lookup
from lodestone.operators.evaluation import evaluate
from lodestone.operators.network import sharing
from lodestone.operators.quantiles import exact_quantiles
from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources.dossier import dossiers


def long_sum(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


@query("SELECT songwriter_id, CAST(count(DISTINCT artist_id) AS BIGINT) AS n_artists FROM b_credit GROUP BY 1 HAVING count(DISTINCT artist_id) >= 3")
def shared_producers(spark, d):
    return sharing(b.credits(spark, d), "artist_id", "songwriter_id", 3)


@query("SELECT label, CAST(count(DISTINCT artist_id) AS BIGINT) AS n_artists FROM b_artist_label GROUP BY 1 HAVING count(DISTINCT artist_id) >= 3")
def shared_labels(spark, d):
    return sharing(b.artist_labels(spark, d), "artist_id", "label", 3)


@query("""SELECT songwriter_id, CAST(count(DISTINCT artist_id) AS BIGINT) AS connected, CAST(count(DISTINCT CASE WHEN threat_status IN ('confirmed_bad', 'suspected') OR latest_verdict IN ('Suspicious', 'Likely Artificial') THEN artist_id END) AS BIGINT) AS flagged
    FROM b_credit JOIN b_artist USING (artist_id) GROUP BY 1""")
def flagged_counts(spark, d):
    flag = F.col("threat_status").isin("confirmed_bad", "suspected") | is_flagged(F.col("latest_verdict"))
    rows = b.credits(spark, d).join(b.artists(spark, d).select("artist_id", flag.alias("flag")), "artist_id")
    return rows.groupBy("songwriter_id").agg(F.countDistinct("artist_id").alias("connected"), F.countDistinct(F.when(F.col("flag"), F.col("artist_id"))).alias("flagged"))


@query("SELECT coalesce(nullif(threat_status, 'unknown'), 'Unknown') AS status, CAST(count(*) AS BIGINT) AS n FROM b_artist GROUP BY 1")
def threat_breakdown(spark, d):
    return b.artists(spark, d).groupBy(F.coalesce(F.nullif(F.col("threat_status"), F.lit("unknown")), F.lit("Unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(genre, 'all') AS genre, coalesce(threat_status, 'all') AS status, CAST(count(*) AS BIGINT) AS n FROM b_artist GROUP BY ROLLUP (genre, threat_status)""")
def queue_stats(spark, d):
    return b.artists(spark, d).rollup("genre", "threat_status").agg(F.count("*").alias("n")).select(F.coalesce("genre", F.lit("all")).alias("genre"), F.coalesce("threat_status", F.lit("all")).alias("status"), "n")


@query("""WITH t AS (SELECT max(ts) AS as_of FROM b_api_call), g AS (SELECT api_name, count(*) AS total, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok, count(*) FILTER (status_code >= 400) AS bad,
      count(*) FILTER (error_message <> '') AS errors, round(avg(ms), 0) AS mean_ms, max(ts) AS last_ts FROM b_api_call, t WHERE ts >= as_of - INTERVAL 7 DAY GROUP BY 1)
    SELECT api_name, CAST(total AS BIGINT) AS total, CAST(ok AS BIGINT) AS ok, CAST(bad AS BIGINT) AS bad, CAST(errors AS BIGINT) AS errors, mean_ms, round(100.0 * (bad + errors) / total, 1) AS error_rate,
      CASE WHEN 100.0 * (bad + errors) / total > 20 THEN 'red' WHEN 100.0 * (bad + errors) / total > 5 THEN 'yellow' ELSE 'green' END AS health FROM g""")
def api_health(spark, d):
    """Of the last seven days before the latest call; an HTTP error with a message counts in both rates."""
    rows = b.api_calls(spark, d)
    as_of = rows.agg(F.max("ts")).first()[0]  # a literal bound reaches the scan
    rows = rows.where(F.col("ts") >= F.lit(as_of - timedelta(days=7))) if as_of else rows
    rows = rows.groupBy("api_name").agg(F.count("*").alias("total"), long_sum(F.col("status_code").between(200, 299)).alias("ok"), long_sum(F.col("status_code") >= 400).alias("bad"), long_sum(F.col("error_message") != "").alias("errors"), F.round(F.avg("ms"), 0).alias("mean_ms"))
    rate = F.lit(100.0) * (F.col("bad") + F.col("errors")) / F.col("total")
    return rows.select("*", F.round(rate, 1).alias("error_rate"), F.when(rate > 20, "red").when(rate > 5, "yellow").otherwise("green").alias("health"))


@query("""SELECT songwriter_id, CAST(c AS BIGINT) AS connected, CAST(f AS BIGINT) AS flagged, round(100.0 * f / c, 1) AS pct FROM (SELECT songwriter_id, count(DISTINCT artist_id) AS c,
    count(DISTINCT CASE WHEN latest_verdict IN ('Suspicious', 'Likely Artificial') THEN artist_id END) AS f FROM b_credit JOIN b_artist USING (artist_id) GROUP BY 1) WHERE c >= 5 AND f >= 2""")
def suspicious_entities(spark, d):
    rows = b.credits(spark, d).join(b.artists(spark, d).select("artist_id", "latest_verdict"), "artist_id").groupBy("songwriter_id").agg(F.countDistinct("artist_id").alias("connected"), F.countDistinct(F.when(is_flagged(F.col("latest_verdict")), F.col("artist_id"))).alias("flagged"))
    return rows.where("connected >= 5 AND flagged >= 2").withColumn("pct", F.round(F.lit(100.0) * F.col("flagged") / F.col("connected"), 1))


@query("""SELECT artist_id, CAST(count(DISTINCT playlist_id) AS BIGINT) AS n_playlists, string_agg(DISTINCT playlist, ',' ORDER BY playlist) AS playlists
    FROM b_playlist_track WHERE editorial GROUP BY 1 HAVING count(DISTINCT playlist_id) >= 2""")
def cross_scan_overlap(spark, d):
    rows = b.playlist_tracks(spark, d).where("editorial").groupBy("artist_id").agg(F.countDistinct("playlist_id").alias("n_playlists"), F.array_join(F.array_sort(F.collect_set("playlist")), ",").alias("playlists"))
    return rows.where("n_playlists >= 2")


@query("""SELECT scan_id, verdict, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY scan_id) AS BIGINT) AS n_scan FROM b_scan_result GROUP BY 1, 2""")
def scan_detail(spark, d):
    rows = b.scan_results(spark, d).groupBy("scan_id", "verdict").agg(F.count("*").alias("n"))
    return rows.join(rows.groupBy("scan_id").agg(F.sum("n").alias("n_scan")), "scan_id")


@query("""SELECT songwriter_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (threat_status = 'confirmed_bad') AS BIGINT) AS flagged FROM b_credit JOIN b_artist USING (artist_id) GROUP BY 1""")
def entity_detail(spark, d):
    rows = b.credits(spark, d).join(b.artists(spark, d), "artist_id")
    return rows.groupBy("songwriter_id").agg(F.count("*").alias("total"), long_sum(F.col("threat_status") == "confirmed_bad").alias("flagged"))


@query("""SELECT playlist, CAST(count(*) AS BIGINT) AS n_artists, CAST(floor(sum(CASE verdict WHEN 'Verified Artist' THEN 100 WHEN 'Likely Authentic' THEN 85 WHEN 'Suspicious' THEN 25 WHEN 'Likely Artificial' THEN 0 ELSE 50 END) / count(*)) AS BIGINT) AS health, round(avg(score), 4) AS mean_score,
    CAST(count(*) FILTER (verdict IN ('Suspicious', 'Likely Artificial')) AS BIGINT) AS flagged FROM b_playlist_track p LEFT JOIN b_evaluated e ON p.artist_id = e.artist_id GROUP BY 1""")
def playlist_health(spark, d):
    """The whole chain: findings, deduplication, decision, score, and the mean health of each playlist's artists."""
    members = b.playlist_tracks(spark, d).join(evaluate(dossiers(spark, d)).select("artist_id", "verdict", "score"), "artist_id", "left")
    health = F.coalesce(lookup(VERDICT_HEALTH, F.col("verdict")), F.lit(50))
    rows = members.groupBy("playlist").agg(F.count("*").alias("n_artists"), F.sum(health).alias("total"), F.round(F.avg("score"), 4).alias("mean_score"), long_sum(is_flagged(F.col("verdict"))).alias("flagged"))
    return rows.select("playlist", "n_artists", F.floor(F.col("total") / F.col("n_artists")).alias("health"), "mean_score", "flagged")


@query("""SELECT scan_id, CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(CASE verdict WHEN 'Verified Artist' THEN 100 WHEN 'Likely Authentic' THEN 85 WHEN 'Inconclusive' THEN 50 WHEN 'Suspicious' THEN 25 ELSE 0 END)) AS BIGINT) AS health FROM b_scan_result GROUP BY 1""")
def scan_health(spark, d):
    return b.scan_results(spark, d).groupBy("scan_id").agg(F.count("*").alias("n"), F.floor(F.avg(lookup(VERDICT_HEALTH, F.col("verdict")))).alias("health"))


@query("""SELECT scan_id, CAST(count(*) FILTER (verdict = 'Verified Artist') AS BIGINT) AS verified, CAST(count(*) FILTER (verdict = 'Likely Authentic') AS BIGINT) AS authentic, CAST(count(*) FILTER (verdict = 'Inconclusive') AS BIGINT) AS inconclusive,
    CAST(count(*) FILTER (verdict = 'Suspicious') AS BIGINT) AS suspicious, CAST(count(*) FILTER (verdict = 'Likely Artificial') AS BIGINT) AS artificial, CAST(count(*) FILTER (score >= 82) AS BIGINT) AS legit, CAST(count(*) FILTER (score >= 58 AND score < 82) AS BIGINT) AS fine, CAST(count(*) FILTER (score < 58) AS BIGINT) AS review
    FROM b_scan_result GROUP BY 1""")
def verdict_breakdown(spark, d):
    v, s = F.col("verdict"), F.col("score")
    named = {"verified": v == "Verified Artist", "authentic": v == "Likely Authentic", "inconclusive": v == "Inconclusive", "suspicious": v == "Suspicious", "artificial": v == "Likely Artificial", "legit": s >= 82, "fine": (s >= 58) & (s < 82), "review": s < 58}
    return b.scan_results(spark, d).groupBy("scan_id").agg(*[long_sum(cond).alias(name) for name, cond in named.items()])


@query("""WITH c AS (SELECT songwriter_id, genre, count(DISTINCT artist_id) AS n FROM b_credit JOIN b_artist USING (artist_id) GROUP BY 1, 2)
    SELECT songwriter_id, genre, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY songwriter_id ORDER BY n DESC, genre) AS BIGINT) AS place FROM c QUALIFY row_number() OVER (PARTITION BY songwriter_id ORDER BY n DESC, genre) <= 3""")
def genre_clusters(spark, d):
    from pyspark.sql import Window

    rows = b.credits(spark, d).join(b.artists(spark, d).select("artist_id", "genre"), "artist_id").groupBy("songwriter_id", "genre").agg(F.countDistinct("artist_id").alias("n"))
    place = F.row_number().over(Window.partitionBy("songwriter_id").orderBy(F.desc("n"), "genre")).cast("long")
    return rows.withColumn("place", place).where("place <= 3")


@query("""WITH l AS (SELECT DISTINCT artist_id, songwriter_id FROM b_credit), n AS (SELECT count(DISTINCT artist_id) AS n FROM l)
    SELECT songwriter_id, CAST(count(*) AS BIGINT) AS degree, round(count(*) / max(n.n), 4) AS corpus_pct, md5(string_agg(CAST(artist_id AS VARCHAR), ',' ORDER BY artist_id)) AS artists FROM l, n GROUP BY 1""")
def entity_graph(spark, d):
    links = b.credits(spark, d).select("artist_id", "songwriter_id").distinct()
    size = links.agg(F.countDistinct("artist_id").alias("n_all"))
    rows = links.groupBy("songwriter_id").agg(F.count("*").alias("degree"), F.array_sort(F.collect_list("artist_id")).alias("ids"))
    rows = rows.join(F.broadcast(size))
    return rows.select("songwriter_id", "degree", F.round(F.col("degree") / F.col("n_all"), 4).alias("corpus_pct"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("artists"))


@query("""WITH w AS (SELECT p_name, length(p_name) AS chars, len(string_split(p_name, ' ')) AS words FROM part)
    SELECT words AS n_words, CAST(count(*) AS BIGINT) AS n, round(avg(chars), 4) AS mean_chars, median(chars) AS median_chars, CAST(min(chars) AS BIGINT) AS least, CAST(max(chars) AS BIGINT) AS most, round(coalesce(stddev_samp(chars), 0), 4) AS sd FROM w GROUP BY 1""")
def naming_stats(spark, d):
    rows = b.table(spark, d, "part").select(F.length("p_name").alias("chars"), F.size(F.split("p_name", " ")).cast("long").alias("n_words"))
    c = F.col("chars")
    counts = rows.groupBy("n_words").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean_chars"), F.min(c).cast("long").alias("least"), F.max(c).cast("long").alias("most"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias("sd"))
    return counts.join(exact_quantiles(rows, ["n_words"], "chars", {"median_chars": 0.5}), "n_words")


BINS = (0, 2, 4, 6, 8, 10, 15, 1000)


@query("""SELECT lo, CAST(count(value) AS BIGINT) AS n FROM (SELECT unnest([0, 2, 4, 6, 8, 10, 15, 1000]) AS lo, unnest([2, 4, 6, 8, 10, 15, 1000, NULL]) AS hi) b LEFT JOIN events ON value >= lo AND (hi IS NULL OR value < hi) GROUP BY 1""")
def duration_histogram(spark, d):
    """Half-open bins, the last without an end; empty bins stay, with 0."""
    ends = [*BINS[1:], None]
    counts = F.array(*[F.struct(F.lit(lo).alias("lo"), F.coalesce(long_sum((F.col("value") >= lo) & ((F.col("value") < hi) if hi is not None else F.lit(True))), F.lit(0)).alias("n")) for lo, hi in zip(BINS, ends, strict=True)])
    return b.table(spark, d, "events").agg(counts.alias("bins")).select(F.inline("bins"))


@query("""WITH r AS (SELECT artist_id, count(*) FILTER (rtype <> 'album') / count(*) AS ratio FROM b_release GROUP BY 1)
    SELECT round(avg(ratio), 4) AS mean_ratio, round(median(ratio), 4) AS median_ratio, CAST(count(*) FILTER (ratio > 0.8) AS BIGINT) AS over_80, CAST(count(*) AS BIGINT) AS n FROM r""")
def singles_ratio(spark, d):
    rows = b.releases(spark, d).groupBy("artist_id").agg((long_sum(F.col("rtype") != "album") / F.count("*")).alias("ratio"))
    middle = exact_quantiles(rows, [], "ratio", {"median_ratio": 0.5}).select(F.round("median_ratio", 4).alias("median_ratio"))
    return rows.agg(F.round(F.avg("ratio"), 4).alias("mean_ratio"), long_sum(F.col("ratio") > 0.8).alias("over_80"), F.count("*").alias("n")).join(F.broadcast(middle))  # a row each


@query("SELECT dayname(release_date) AS day, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM b_release GROUP BY 1")
def release_weekday(spark, d):
    rows = b.releases(spark, d).groupBy(F.date_format("release_date", "EEEE").alias("day")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).select("day", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("pct"))


PRESENCE_SQL = """SELECT artist_id, bool_or(rtype = 'album') AS album, bool_or(rtype = 'single') AS single, bool_or(rtype = 'ep') AS ep FROM b_release GROUP BY 1"""


def presence(spark, d):
    return b.releases(spark, d).groupBy("artist_id").agg(*[F.bool_or(F.col("rtype") == k).alias(k) for k in ("album", "single", "ep")])


@query(f"""SELECT coalesce(nullif(concat_ws('+', CASE WHEN album THEN 'album' END, CASE WHEN ep THEN 'ep' END, CASE WHEN single THEN 'single' END), ''), 'NONE') AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM ({PRESENCE_SQL}) GROUP BY 1""")
def presence_matrix(spark, d):
    marks = F.concat_ws("+", *[F.when(F.col(k), k) for k in ("album", "ep", "single")])
    return presence(spark, d).groupBy(F.coalesce(F.nullif(marks, F.lit("")), F.lit("NONE")).alias("fingerprint")).agg(F.count("*").alias("n"))


@query(f"""SELECT * FROM (SELECT 'album+ep' AS pair, CAST(count(*) FILTER (album AND ep) AS BIGINT) AS n FROM ({PRESENCE_SQL}) UNION ALL SELECT 'album+single', CAST(count(*) FILTER (album AND single) AS BIGINT) FROM ({PRESENCE_SQL}) UNION ALL SELECT 'ep+single', CAST(count(*) FILTER (ep AND single) AS BIGINT) FROM ({PRESENCE_SQL}))""")
def platform_cooccurrence(spark, d):
    pairs = (("album", "ep"), ("album", "single"), ("ep", "single"))
    both = F.array(*[F.struct(F.lit(f"{x}+{y}").alias("pair"), long_sum(F.col(x) & F.col(y)).alias("n")) for x, y in pairs])
    return presence(spark, d).agg(both.alias("rows")).select(F.inline("rows"))


@query("""WITH s AS (SELECT label, count(DISTINCT artist_id) AS n FROM b_artist_label GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS place FROM s), t AS (SELECT count(DISTINCT artist_id) AS n_all FROM b_artist_label)
    SELECT label, CAST(n AS BIGINT) AS n, round(100.0 * (SELECT sum(n) FROM r WHERE place <= 10) / n_all, 4) AS top10_pct FROM r, t WHERE place <= 30""")
def label_concentration(spark, d):
    """top10_pct adds up the ten largest labels' sizes, so that it may exceed 100."""
    links = b.artist_labels(spark, d)
    top = links.groupBy("label").agg(F.countDistinct("artist_id").alias("n")).orderBy(F.desc("n"), "label").limit(30)
    ten = top.orderBy(F.desc("n"), "label").limit(10).agg(F.sum("n").alias("ten"))
    total = links.agg(F.countDistinct("artist_id").alias("n_all"))
    return top.join(F.broadcast(ten)).join(F.broadcast(total)).select("label", "n", F.round(F.lit(100.0) * F.col("ten") / F.col("n_all"), 4).alias("top10_pct"))


@query("""WITH p AS (SELECT playlist_id, playlist, artist_id FROM b_playlist_track), n AS (SELECT artist_id, count(DISTINCT playlist_id) AS k FROM p GROUP BY 1)
    SELECT playlist, CAST(count(*) AS BIGINT) AS n_artists, CAST(count(*) FILTER (k = 1) AS BIGINT) AS on_one, CAST(count(*) FILTER (k >= 3) AS BIGINT) AS on_three, CAST(count(*) FILTER (threat_status = 'confirmed_bad') AS BIGINT) AS listed
    FROM p JOIN n USING (artist_id) JOIN b_artist USING (artist_id) GROUP BY 1""")
def playlist_corpus(spark, d):
    rows = b.playlist_tracks(spark, d)
    spread = rows.groupBy("artist_id").agg(F.countDistinct("playlist_id").alias("k"))
    rows = rows.join(spread, "artist_id").join(b.artists(spark, d).select("artist_id", "threat_status"), "artist_id")
    return rows.groupBy("playlist").agg(F.count("*").alias("n_artists"), long_sum(F.col("k") == 1).alias("on_one"), long_sum(F.col("k") >= 3).alias("on_three"), long_sum(F.col("threat_status") == "confirmed_bad").alias("listed"))


@query("""SELECT artist_id, CAST(year(release_date) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / max(count(*)) OVER (PARTITION BY artist_id), 4) AS bar FROM b_release GROUP BY 1, 2""")
def release_timeline(spark, d):
    from pyspark.sql import Window

    rows = b.releases(spark, d).groupBy("artist_id", F.year("release_date").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return rows.withColumn("bar", F.round(F.lit(100.0) * F.col("n") / F.max("n").over(Window.partitionBy("artist_id")), 4))
