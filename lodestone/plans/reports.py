"""Report aggregates, the feature matrix and what the statistics make of it."""

from __future__ import annotations

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators.clues import FLAGGED_PERCENT
from lodestone.operators.collectors import collect
from lodestone.operators.evaluation import evaluate
from lodestone.operators.network import set_overlaps
from lodestone.operators.statistics import gini_splits, mann_whitney, running, two_by_two, unpivot
from lodestone.operators.quantiles import exact_quantiles
from lodestone.operators.written import write_once
from lodestone.plans.base import query
from lodestone.plans.lookups import ENTITY_PCT_SQL, corpus_features_of
from lodestone.sources import bindings as b
from lodestone.sources.dossier import COLUMNS, dossiers


def _count(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


@query("""SELECT 'artists' AS what, CAST(count(*) AS BIGINT) AS n FROM b_artist UNION ALL SELECT 'labels', CAST(count(DISTINCT p_brand) AS BIGINT) FROM part UNION ALL SELECT 'songwriters', CAST(count(*) AS BIGINT) FROM b_songwriter UNION ALL SELECT 'scans', CAST(count(DISTINCT scan_id) AS BIGINT) FROM b_scan_result
    UNION ALL SELECT 'api_calls', CAST(count(*) AS BIGINT) FROM b_api_call UNION ALL SELECT 'threat ' || coalesce(threat_status, 'Unknown'), CAST(count(*) AS BIGINT) FROM b_artist GROUP BY threat_status""")
def table_counts(spark, d):
    """Rows of each relation, and artists by threat status."""
    one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    artists = b.artists(spark, d)
    parts = [one("artists", artists), one("labels", b.table(spark, d, "part").select("p_brand").distinct()), one("songwriters", b.songwriters(spark, d)), one("scans", b.scan_results(spark, d).select("scan_id").distinct()), one("api_calls", b.api_calls(spark, d))]
    out = artists.groupBy(F.concat(F.lit("threat "), F.coalesce("threat_status", F.lit("Unknown"))).alias("what")).agg(F.count("*").alias("n"))
    for p in parts:
        out = out.unionByName(p)
    return out


_REVIEW_SQL = "SELECT event_type AS kind, CASE event_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'defer' ELSE 'pending' END AS action, ts FROM events"


@query(f"""WITH r AS ({_REVIEW_SQL}), t AS (SELECT max(ts) AS now FROM r) SELECT coalesce(kind, 'all') AS kind, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (action = 'pending') AS BIGINT) AS pending, CAST(count(*) FILTER (action = 'confirm') AS BIGINT) AS confirmed, CAST(count(*) FILTER (action = 'dismiss') AS BIGINT) AS dismissed,
    CAST(count(*) FILTER (action <> 'pending' AND ts >= now - INTERVAL 7 DAY) AS BIGINT) AS last_week, CAST(count(*) FILTER (action <> 'pending' AND ts >= now - INTERVAL 30 DAY) AS BIGINT) AS last_month FROM r, t GROUP BY ROLLUP (kind)""")
def review_stats(spark, d):
    """Reviews by kind and action, with those of the last week and month; the total is the rollup's."""
    events = b.table(spark, d, "events")
    k = F.col("event_id") % 4
    rows = events.select(F.col("event_type").alias("kind"), F.when(k == 0, "confirm").when(k == 1, "dismiss").when(k == 2, "defer").otherwise("pending").alias("action"), "ts").join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    done = F.col("action") != "pending"
    since = lambda days: _count(done & (F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS")))
    found = rows.rollup("kind").agg(F.count("*").alias("total"), _count(~done).alias("pending"), _count(F.col("action") == "confirm").alias("confirmed"), _count(F.col("action") == "dismiss").alias("dismissed"), since(7).alias("last_week"), since(30).alias("last_month"))
    return found.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("""SELECT label, round(avg(platforms), 4) AS mean_platforms, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (db_status IN ('confirmed_bad', 'suspected')) AS BIGINT) AS flagged, avg(platforms) < 2.5 AS absent, count(*) >= 3 AND 100.0 * count(*) FILTER (db_status IN ('confirmed_bad', 'suspected')) / count(*) >= 50 AS critical FROM b_artist_label JOIN b_dossier USING (artist_id) GROUP BY 1""")
def context_clues(spark, d):
    """Labels whose artists are on few platforms, or of whom half are flagged."""
    rows = b.artist_labels(spark, d).join(dossiers(spark, d).select("artist_id", "platforms", "db_status"), "artist_id").groupBy("label").agg(F.avg("platforms").alias("mean"), F.count("*").alias("n"), _count(F.col("db_status").isin("confirmed_bad", "suspected")).alias("flagged"))
    return rows.select("label", F.round("mean", 4).alias("mean_platforms"), "n", "flagged", (F.col("mean") < 2.5).alias("absent"), ((F.col("n") >= 3) & (F.lit(100.0) * F.col("flagged") / F.col("n") >= FLAGGED_PERCENT)).alias("critical"))


@query("SELECT x.label AS a, y.label AS b, CAST(count(*) AS BIGINT) AS shared FROM b_artist_label x JOIN b_artist_label y ON x.artist_id = y.artist_id AND x.label < y.label SEMI JOIN (SELECT artist_id FROM b_artist WHERE threat_status IN ('confirmed_bad', 'suspected')) f ON x.artist_id = f.artist_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY shared DESC, a, b LIMIT 50")
def flagged_label_cooccurrence(spark, d):
    bad = b.artists(spark, d).where(F.col("threat_status").isin("confirmed_bad", "suspected")).select("artist_id")
    return set_overlaps(b.artist_labels(spark, d).join(bad, "artist_id", "left_semi"), "label", "artist_id", 2, 50)


@query("""SELECT CAST(count(*) AS BIGINT) AS artists, CAST(count(*) FILTER (n_contrib > 0) AS BIGINT) AS with_contributors, CAST(count(*) FILTER (n_labels > 0) AS BIGINT) AS with_labels, CAST(count(*) FILTER (n_related_clean > 0) AS BIGINT) AS with_related, CAST(count(*) FILTER (n_pfc_labels > 0 OR n_pfc_writers > 0) AS BIGINT) AS linked, CAST(sum(n_contrib) AS BIGINT) AS links FROM b_dossier""")
def expansion_summary(spark, d):
    c = F.col
    return dossiers(spark, d).agg(F.count("*").alias("artists"), _count(c("n_contrib") > 0).alias("with_contributors"), _count(c("n_labels") > 0).alias("with_labels"), _count(c("n_related_clean") > 0).alias("with_related"), _count((c("n_pfc_labels") > 0) | (c("n_pfc_writers") > 0)).alias("linked"), F.sum(c("n_contrib").cast("long")).alias("links"))


_NAMED_SQL = "SELECT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN 'the ' || lower(p_name) ELSE 'DJ ' || p_brand END AS name FROM part"


@query(f"""WITH n AS ({_NAMED_SQL}) SELECT CASE WHEN name = upper(name) AND name <> lower(name) THEN 'upper' WHEN name = lower(name) THEN 'lower' ELSE 'mixed' END AS caps, CASE WHEN lower(name) LIKE 'the %' THEN 'the' WHEN lower(name) LIKE 'dj %' THEN 'dj' ELSE 'none' END AS prefix, CAST(len(string_split(name, ' ')) AS BIGINT) AS words,
    CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT lower(name)) AS BIGINT) AS distinct_names FROM n GROUP BY 1, 2, 3""")
def naming_shapes(spark, d):
    """Names by capitals, prefix and words, with how many differ."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    rows = b.table(spark, d, "part").select(F.when(k == 0, F.upper(name)).when(k == 1, name).when(k == 2, F.concat(F.lit("the "), F.lower(name))).otherwise(F.concat(F.lit("DJ "), "p_brand")).alias("name"))
    low, up = F.lower("name"), F.upper("name")
    caps = F.when((F.col("name") == up) & (F.col("name") != low), "upper").when(F.col("name") == low, "lower").otherwise("mixed")
    prefix = F.when(low.startswith("the "), "the").when(low.startswith("dj "), "dj").otherwise("none")
    return rows.groupBy(caps.alias("caps"), prefix.alias("prefix"), F.size(F.split("name", " ")).cast("long").alias("words")).agg(F.count("*").alias("n"), F.countDistinct(low).alias("distinct_names"))


@query("""SELECT p_brand AS label, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS mean, median(l_quantity) AS median, CAST(count(*) FILTER (l_quantity < 10) AS BIGINT) AS short, CAST(count(*) FILTER (l_quantity >= 10 AND l_quantity < 30) AS BIGINT) AS middle, CAST(count(*) FILTER (l_quantity >= 30) AS BIGINT) AS long FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def track_durations(spark, d):
    """Mean, median and histogram of each label's track lengths (quantities here)."""
    q = F.col("l_quantity")
    rows = b.table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label")), "l_partkey")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(q), 4).alias("mean"), _count(q < 10).alias("short"), _count((q >= 10) & (q < 30)).alias("middle"), _count(q >= 30).alias("long"))
    return counts.join(exact_quantiles(rows, ["label"], "l_quantity", {"median": 0.5}), "label")


@query("SELECT CAST(threat AS VARCHAR) AS threat, CAST(count(*) AS BIGINT) AS n FROM b_evaluated WHERE threat IS NOT NULL GROUP BY 1")
def threat_histogram(spark, d):
    return evaluate(dossiers(spark, d)).where("threat IS NOT NULL").groupBy(F.col("threat").cast("string").alias("threat")).agg(F.count("*").alias("n"))


_POINTS = "CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END"


@query(f"SELECT artist_id, source, CAST(greatest(0, least(100, floor((sum(CASE evidence_type WHEN 'green_flag' THEN {_POINTS} WHEN 'red_flag' THEN -{_POINTS} ELSE 0 END) / sum({_POINTS}) + 1) / 2 * 100 + 0.5))) AS BIGINT) AS score FROM b_found GROUP BY 1, 2")
def section_score(spark, d):
    """The balance of each section's findings, 0 to 100."""
    points = F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "moderate", 2).otherwise(1)
    signed = F.when(F.col("evidence_type") == "green_flag", points).when(F.col("evidence_type") == "red_flag", -points).otherwise(0)
    share = (F.sum(signed) / F.sum(points) + 1) / 2 * 100
    return collect(dossiers(spark, d)).groupBy("artist_id", "source").agg(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(share + 0.5))).cast("long").alias("score"))


_REACHED = ("genius", "discogs", "setlistfm", "musicbrainz", "lastfm")


@query(" UNION ALL ".join(f"SELECT '{p}' AS source, CAST(count(*) FILTER ({p}_found) AS BIGINT) AS reached, CAST(count(*) FILTER (NOT {p}_found AND err_{p}) AS BIGINT) AS failed, CAST(count(*) FILTER (NOT {p}_found AND NOT err_{p}) AS BIGINT) AS missing FROM b_dossier" for p in _REACHED))
def source_reach(spark, d):
    """How many artists each source knows, failed on, and doesn't know."""
    found, err = (lambda p: F.col(f"{p}_found")), (lambda p: F.col(f"err_{p}"))
    rows = F.array(*[F.struct(F.lit(p).alias("source"), _count(found(p)).alias("reached"), _count(~found(p) & err(p)).alias("failed"), _count(~found(p) & ~err(p)).alias("missing")) for p in _REACHED])
    return dossiers(spark, d).agg(rows.alias("rows")).select(F.inline("rows"))


@query("""SELECT scan_id, CAST(count(*) FILTER (artist_id % 10 <> 0) AS BIGINT) AS analysed, CAST(count(*) FILTER (artist_id % 10 = 0) AS BIGINT) AS skipped, CAST(count(*) AS BIGINT) AS total, coalesce(round(100.0 * count(*) FILTER (artist_id % 10 <> 0 AND verdict = 'Suspicious') / nullif(count(*) FILTER (artist_id % 10 <> 0), 0)), 0) AS suspicious_pct FROM b_scan_result GROUP BY 1""")
def coverage_summary(spark, d):
    """Analysed and skipped artists of each scan; the legend's share is one of the analysed."""
    kept = F.col("artist_id") % 10 != 0
    rows = b.scan_results(spark, d).groupBy("scan_id").agg(_count(kept).alias("analysed"), _count(~kept).alias("skipped"), F.count("*").alias("total"), _count(kept & (F.col("verdict") == "Suspicious")).alias("bad"))
    return rows.select("scan_id", "analysed", "skipped", "total", F.coalesce(F.round(F.lit(100.0) * F.col("bad") / F.nullif("analysed", F.lit(0))), F.lit(0.0)).alias("suspicious_pct"))


@query("SELECT CAST(count(*) AS BIGINT) AS playlists, CAST(sum(n) AS BIGINT) AS tracks, CAST((SELECT count(DISTINCT artist_id) FROM b_playlist_track) AS BIGINT) AS artists FROM (SELECT playlist_id, count(*) AS n FROM b_playlist_track GROUP BY 1)")
def fetch_totals(spark, d):
    """Totals over playlists with their tracks nested in arrays."""
    nested = b.playlist_tracks(spark, d).groupBy("playlist_id").agg(F.collect_list("artist_id").alias("tracks"))
    tracks = nested.select(F.explode("tracks").alias("artist_id"))
    return nested.agg(F.count("*").alias("playlists"), F.sum(F.size("tracks").cast("long")).alias("tracks")).join(F.broadcast(tracks.agg(F.countDistinct("artist_id").alias("artists"))))


@query("""WITH o AS (SELECT api_name, ts, event_id, status_code >= 400 AS bad, row_number() OVER (PARTITION BY api_name ORDER BY ts, event_id) AS n FROM b_api_call), r AS (SELECT *, n - row_number() OVER (PARTITION BY api_name, bad ORDER BY n) AS run FROM o), k AS (SELECT api_name, row_number() OVER (PARTITION BY api_name, run ORDER BY n) AS streak FROM r WHERE bad)
    SELECT api_name, CAST(count(*) AS BIGINT) AS errors, CAST(max(streak) AS BIGINT) AS longest, CAST(sum(least(pow(2, streak - 1), 8)) AS BIGINT) AS backoff, max(streak) >= 15 AS open FROM k GROUP BY 1""")
def limiter_stats(spark, d):
    """Errors in a row of each API, the seconds that doubling waits (8 at most) come to, and whether the breaker (15) has opened."""
    rows = b.api_calls(spark, d).select("api_name", "event_id", "ts", F.to_date("ts").alias("day"), (F.col("status_code") >= 400).cast("long").alias("bad"))
    rows = running(rows, ["api_name"], "day", ["ts", "event_id"], {"n": F.lit(1), "n_bad": F.col("bad")}).where("bad = 1").withColumn("run", F.col("n") - F.col("n_bad"))
    runs = rows.groupBy("api_name", "run").agg(F.count("*").alias("length"))
    # waits of 1, 2, 4 and then 8 seconds
    waits = F.when(F.col("length") <= 3, F.pow(F.lit(2), F.col("length")) - 1).otherwise(7 + 8 * (F.col("length") - 3))
    return runs.groupBy("api_name").agg(F.sum("length").alias("errors"), F.max("length").alias("longest"), F.sum(waits).cast("long").alias("backoff"), (F.max("length") >= 15).alias("open"))


#: The feature matrix: binary and continuous features of every artist, and whether it belongs to the corpus.
BINARY = ("has_musicbrainz", "has_deezer", "has_genius", "has_discogs", "has_setlistfm", "has_lastfm", "has_physical", "bio_exists", "has_setlists", "has_burst", "has_isni", "has_ipi", "bad_producer", "bad_label")
CONTINUOUS = ("platform_count", "fans_log", "album_count", "singles_ratio", "mean_duration", "cadence_cv", "lifespan_days", "listeners_log", "play_ratio", "song_count", "genius_followers", "setlist_count", "producer_pct", "label_pct", "name_words", "name_chars", "physical_count")
_MATRIX = {
    "has_musicbrainz": "CASE WHEN musicbrainz_found THEN 1 ELSE 0 END", "has_deezer": "CASE WHEN on_deezer THEN 1 ELSE 0 END", "has_genius": "CASE WHEN genius_found THEN 1 ELSE 0 END", "has_discogs": "CASE WHEN discogs_found THEN 1 ELSE 0 END", "has_setlistfm": "CASE WHEN setlistfm_found THEN 1 ELSE 0 END", "has_lastfm": "CASE WHEN lastfm_found THEN 1 ELSE 0 END",
    "has_physical": "CASE WHEN discogs_physical > 0 THEN 1 ELSE 0 END", "bio_exists": "CASE WHEN lastfm_bio THEN 1 ELSE 0 END", "has_setlists": "CASE WHEN shows > 0 THEN 1 ELSE 0 END", "has_burst": "CASE WHEN coalesce(most_in_month, 0) >= 10 THEN 1 ELSE 0 END", "has_isni": "CASE WHEN n_isnis > 0 THEN 1 ELSE 0 END", "has_ipi": "CASE WHEN n_ipis > 0 THEN 1 ELSE 0 END", "bad_producer": "CASE WHEN coalesce(c_bad_producer, false) THEN 1 ELSE 0 END", "bad_label": "CASE WHEN coalesce(c_bad_label, false) THEN 1 ELSE 0 END",
    "fans_log": "round(log10(greatest(fans, 1)), 3)", "album_count": "albums", "singles_ratio": "CASE WHEN albums + singles > 0 THEN round(singles / CAST(albums + singles AS DOUBLE), 3) ELSE 0 END", "mean_duration": "round(avg_s, 1)", "cadence_cv": "coalesce(gap_cv, 0)", "lifespan_days": "span_days", "listeners_log": "round(log10(greatest(lastfm_listeners, 1)), 3)", "play_ratio": "lastfm_ratio", "song_count": "genius_songs", "genius_followers": "genius_followers", "setlist_count": "shows",
    "producer_pct": "coalesce(c_producer_pct, 0)", "label_pct": "coalesce(c_label_pct, 0)", "name_words": "length(name) - length(replace(name, ' ', '')) + 1", "name_chars": "length(name)", "physical_count": "discogs_physical",
}
_MATRIX["platform_count"] = " + ".join(_MATRIX[c] for c in BINARY[:6])
_CORPUS = "CASE WHEN artist_id % 5 < 3 THEN 1 ELSE 0 END"
b.SQL["b_features"] = "SELECT artist_id, " + ", ".join(f"CAST({_MATRIX[c]} AS DOUBLE) AS {c}" for c in (*BINARY, *CONTINUOUS)) + f""", {_CORPUS} AS is_corpus FROM (SELECT d.*, most_in_month, gap_cv, c_producer_pct, c_bad_producer, c_label_pct, c_bad_label FROM b_dossier d
  LEFT JOIN (SELECT artist_id, max(n) AS most_in_month FROM (SELECT artist_id, strftime(release_date, '%Y-%m') AS m, count(*) AS n FROM b_track GROUP BY 1, 2) GROUP BY 1) m USING (artist_id)
  LEFT JOIN (SELECT artist_id, round(coalesce(stddev_samp(gap), 0) / avg(gap), 3) AS gap_cv FROM (SELECT artist_id, date_diff('day', lag(release_date) OVER (PARTITION BY artist_id ORDER BY release_date), release_date) AS gap FROM b_release) WHERE gap > 0 GROUP BY 1) g USING (artist_id)
  LEFT JOIN (SELECT artist_id, producer_pct AS c_producer_pct, bad_producer AS c_bad_producer, label_pct AS c_label_pct, bad_label AS c_bad_label FROM ({ENTITY_PCT_SQL} SELECT * FROM w JOIN x USING (artist_id))) e USING (artist_id))"""


def features(spark, d):
    """artist_id, BINARY, CONTINUOUS, is_corpus."""
    releases = b.releases(spark, d)
    months = b.tracks(spark, d).groupBy("artist_id", F.date_format("release_date", "yyyy-MM").alias("m")).agg(F.count("*").alias("n")).groupBy("artist_id").agg(F.max("n").alias("most_in_month"))
    before = F.lag("release_date").over(Window.partitionBy("artist_id").orderBy("release_date"))
    gaps = releases.select("artist_id", F.datediff("release_date", before).alias("gap")).where("gap > 0").groupBy("artist_id").agg(F.round(F.coalesce(F.stddev_samp("gap"), F.lit(0.0)) / F.avg("gap"), 3).alias("gap_cv"))
    corpus = corpus_features_of(spark, d)
    corpus = corpus.select("artist_id", *[F.col(c).alias(f"c_{c}") for c in corpus.columns if c != "artist_id"])
    asked = {name for name, _ in COLUMNS if any(re.search(rf"\b{name}\b", x) for x in _MATRIX.values())}
    rows = dossiers(spark, d, asked).join(months, "artist_id", "left").join(gaps, "artist_id", "left").join(corpus, "artist_id", "left")
    return rows.selectExpr("artist_id", *[f"CAST({_MATRIX[c]} AS DOUBLE) AS {c}" for c in (*BINARY, *CONTINUOUS)], f"{_CORPUS} AS is_corpus")


@query("SELECT * FROM b_features")
def extract_features(spark, d):
    return features(spark, d)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM b_features WHERE is_corpus = 1" for c in (*BINARY, *CONTINUOUS)))
def corpus_stats(spark, d):
    """Rates, means and medians of the corpus."""
    rows = unpivot(write_once(features(spark, d), "features").where("is_corpus = 1"), [*BINARY, *CONTINUOUS], "is_corpus")
    middle = exact_quantiles(rows, ["feature"], "value", {"median": 0.5}).select("feature", F.round("median", 6).alias("median"))
    return rows.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean")).join(middle, "feature")


_CHI2_AT, _Z_AT = 3.841458820694124, 1.959963984540054
_LONG = "SELECT unnest([{0}]) AS feature, unnest([{1}]) AS value, is_corpus AS label FROM b_features"
_LONG_B = _LONG.format(", ".join(f"'{c}'" for c in BINARY), ", ".join(BINARY))
_LONG_C = _LONG.format(", ".join(f"'{c}'" for c in CONTINUOUS), ", ".join(CONTINUOUS))
_VALIDATE = f"""WITH t AS (SELECT feature, count(*) FILTER (value = 1 AND label = 1) AS a, count(*) FILTER (value = 0 AND label = 1) AS b, count(*) FILTER (value = 1 AND label = 0) AS c, count(*) FILTER (value = 0 AND label = 0) AS d FROM ({_LONG_B}) GROUP BY 1),
    e AS (SELECT *, (a + b) * (a + c) / (a + b + c + d) AS ea, (a + b) * (b + d) / (a + b + c + d) AS eb, (c + d) * (a + c) / (a + b + c + d) AS ec, (c + d) * (b + d) / (a + b + c + d) AS ed FROM t),
    f AS (SELECT feature, 'fisher' AS test, CASE WHEN ea > 0 THEN pow(abs(a - ea) - 0.5, 2) / ea ELSE 0 END + CASE WHEN eb > 0 THEN pow(abs(b - eb) - 0.5, 2) / eb ELSE 0 END + CASE WHEN ec > 0 THEN pow(abs(c - ec) - 0.5, 2) / ec ELSE 0 END + CASE WHEN ed > 0 THEN pow(abs(d - ed) - 0.5, 2) / ed ELSE 0 END AS stat,
      CASE WHEN b * c = 0 THEN CASE WHEN a * d > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE round(a * d / (b * c), 2) END AS effect, a / (a + b) > c / (c + d) AS higher FROM e),
    v AS ({_LONG_C}), n AS (SELECT feature, value, count(*) AS n, sum(label) AS n1 FROM v GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2 AS rank FROM n),
    s AS (SELECT feature, sum(rank * n1) AS r1, sum(n1) AS n1, sum(n - n1) AS n2 FROM r GROUP BY 1), u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u, sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS sigma FROM s), h AS (SELECT feature, median(value) FILTER (label = 1) > median(value) FILTER (label = 0) AS higher FROM v GROUP BY 1),
    m AS (SELECT feature, 'rank' AS test, abs(u - n1 * n2 / 2) / sigma AS stat, 1 - 2 * u / (n1 * n2) AS effect, higher FROM u JOIN h USING (feature)),
    j AS (SELECT *, CASE test WHEN 'fisher' THEN stat > {_CHI2_AT} ELSE stat > {_Z_AT} END AS significant FROM (SELECT * FROM f UNION ALL SELECT * FROM m))"""


def validated(spark, d):
    """feature, test, stat, effect, higher, significant: both kinds of test on every feature, corpus against control."""
    rows = write_once(features(spark, d), "features")
    rates = unpivot(rows, list(BINARY), "is_corpus")
    binary = two_by_two(rates).select("feature", F.lit("fisher").alias("test"), F.col("chi2").alias("stat"), F.col("odds").alias("effect"), (F.col("a") / (F.col("a") + F.col("b")) > F.col("c") / (F.col("c") + F.col("d"))).alias("higher"))
    values = unpivot(rows, list(CONTINUOUS), "is_corpus")
    middle = exact_quantiles(values, ["feature", "label"], "value", {"median": 0.5})
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("median")))  # noqa: E731  one row each
    higher = middle.groupBy("feature").agg((of(1) > of(0)).alias("higher"))
    ranked = mann_whitney(values).join(higher, "feature").select("feature", F.lit("rank").alias("test"), F.coalesce("z", F.lit(0.0)).alias("stat"), "effect", "higher")
    both = binary.unionByName(ranked)
    return both.withColumn("significant", F.when(F.col("test") == "fisher", F.col("stat") > _CHI2_AT).otherwise(F.col("stat") > _Z_AT))


@query(_VALIDATE + " SELECT feature, test, round(stat, 4) AS stat, round(effect, 4) AS effect, CASE WHEN higher THEN 'higher' ELSE 'lower' END AS direction, significant FROM j")
def validate_signals(spark, d):
    """Significant at 5 %: the statistic beyond the distribution's bound."""
    rows = validated(spark, d)
    return rows.select("feature", "test", F.round("stat", 4).alias("stat"), F.round("effect", 4).alias("effect"), F.when(F.col("higher"), "higher").otherwise("lower").alias("direction"), "significant")


@query(_VALIDATE + " SELECT feature, round(CASE WHEN test = 'rank' THEN CASE WHEN higher THEN abs(effect) ELSE -abs(effect) END WHEN isinf(effect) THEN 10 WHEN effect = 0 THEN -10 ELSE ln(effect) END, 3) AS weight FROM j WHERE significant")
def revised_weights(spark, d):
    e = F.col("effect")
    odds = F.when(e == math.inf, 10.0).when(e == 0, -10.0).otherwise(F.log(e))
    return validated(spark, d).where("significant").select("feature", F.round(F.when(F.col("test") == "rank", F.when(F.col("higher"), F.abs(e)).otherwise(-F.abs(e))).otherwise(odds), 3).alias("weight"))


_TRUTH = """CASE WHEN is_corpus = 0 THEN 'CONTROL' WHEN (bad_producer = 1 OR bad_label = 1) AND platform_count <= 2 THEN 'CONFIRMED_PFC' WHEN platform_count >= 5 AND (has_physical = 1 OR has_setlists = 1) AND bad_producer = 0 AND bad_label = 0 THEN 'LIKELY_LEGIT'
  WHEN platform_count <= 2 AND (producer_pct > 0.01 OR label_pct > 0.05) THEN 'LIKELY_PFC' WHEN platform_count <= 1 THEN 'LIKELY_PFC' ELSE 'UNCERTAIN' END"""


@query(f"SELECT {_TRUTH} AS label, CAST(count(*) AS BIGINT) AS n FROM b_features GROUP BY 1")
def ground_truth(spark, d):
    """Five ordered rules over the feature matrix."""
    c = F.col
    bad, missing = (c("bad_producer") == 1) | (c("bad_label") == 1), 6 - c("platform_count")
    label = F.when(c("is_corpus") == 0, "CONTROL").when(bad & (missing >= 4), "CONFIRMED_PFC").when((c("platform_count") >= 5) & ((c("has_physical") == 1) | (c("has_setlists") == 1)) & ~bad, "LIKELY_LEGIT")
    label = label.when((missing >= 4) & ((c("producer_pct") > 0.01) | (c("label_pct") > 0.05)), "LIKELY_PFC").when(missing >= 5, "LIKELY_PFC").otherwise("UNCERTAIN")
    return features(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


FOLDS, THRESHOLDS = 5, 20
_CV = ("platform_count", "fans_log", "mean_duration", "cadence_cv", "listeners_log", "play_ratio", "has_physical", "has_genius")


def cross_validation(rows, names, folds=FOLDS, thresholds=THRESHOLDS):
    """(id, the features, label) -> id, label, guess: each contiguous fold (by id) is judged by the best threshold of one feature on the others.

    The first thresholds of each feature are tried, and each in both directions; the class means give the direction.
    """
    size = rows.count() // folds
    numbered = running(rows.withColumn("stretch", F.floor(F.col("id") / 100_000)), [], "stretch", ["id"], {"at": F.lit(1)}).drop("stretch") if size else rows.withColumn("at", F.lit(1))
    numbered = numbered.withColumn("fold", F.least(F.floor((F.col("at") - 1) / max(1, size)), F.lit(folds - 1)))
    order = {name: k for k, name in enumerate(names)}
    pairs = F.array(*[F.struct(F.lit(order[n]).alias("feature"), F.col(n).alias("value")) for n in names])
    every = numbered.select("id", "fold", "label", F.inline(pairs))
    trained = every.withColumn("test", F.explode(F.array(*map(F.lit, range(folds))))).where("test <> fold")
    counts = trained.groupBy("test", "feature", "value").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    own = Window.partitionBy("test", "feature")
    first = counts.withColumn("k", F.row_number().over(own.orderBy("value"))).where(F.col("k") <= thresholds + 1)
    upto = own.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tried = first.withColumns({"next": F.lead("value").over(own.orderBy("value")), "nl": F.sum("n").over(upto), "n1l": F.sum("n1").over(upto)}).where(f"next IS NOT NULL AND k <= {thresholds}")
    totals = trained.groupBy("test", "feature").agg(F.count("*").alias("nt"), F.sum("label").alias("n1t"), F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("mean1"), F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("mean0"))
    right = F.col("n1l") + (F.col("nt") - F.col("n1t")) - (F.col("nl") - F.col("n1l"))
    scored = tried.join(F.broadcast(totals), ["test", "feature"]).withColumns({"right": F.greatest(right, F.col("nt") - right), "threshold": (F.col("value") + F.col("next")) / 2})
    best = scored.groupBy("test").agg(F.max(F.struct("right", -F.col("feature"), -F.col("threshold"), "mean1", "mean0")).alias("b"))
    best = best.select(F.col("test").alias("fold"), (-F.col("b.col2")).alias("feature"), (-F.col("b.col3")).alias("threshold"), "b.mean1", "b.mean0")
    judged = every.join(F.broadcast(best), ["fold", "feature"])
    above = F.coalesce(F.col("mean1"), F.lit(0.0)) > F.coalesce(F.col("mean0"), F.lit(0.0))
    return judged.select("id", "label", F.when(above, F.col("value") > F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")).cast("int").alias("guess"))


_FOLD = f"least(floor((row_number() OVER (ORDER BY artist_id) - 1) / ((SELECT count(*) FROM b_features) // {FOLDS})), {FOLDS - 1})"
_CROSS = f"""WITH e AS (SELECT artist_id, CAST(fold AS INTEGER) AS fold, label, unnest([{", ".join(map(str, range(len(_CV))))}]) AS feature, unnest([{", ".join(_CV)}]) AS value FROM (SELECT *, is_corpus AS label, {_FOLD} AS fold FROM b_features)),
    t AS (SELECT e.*, test FROM e, (SELECT unnest([0, 1, 2, 3, 4]) AS test) WHERE test <> fold), c AS (SELECT test, feature, value, count(*) AS n, sum(label) AS n1 FROM t GROUP BY 1, 2, 3),
    w AS (SELECT *, row_number() OVER o AS k, lead(value) OVER o AS nxt, sum(n) OVER o AS nl, sum(n1) OVER o AS n1l FROM c WINDOW o AS (PARTITION BY test, feature ORDER BY value)), a AS (SELECT test, feature, count(*) AS nt, sum(label) AS n1t, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0 FROM t GROUP BY 1, 2),
    s AS (SELECT w.test, w.feature, (value + nxt) / 2 AS threshold, greatest(n1l + nt - n1t - (nl - n1l), nt - (n1l + nt - n1t - (nl - n1l))) AS ok, m1, m0 FROM w JOIN a ON w.test = a.test AND w.feature = a.feature WHERE nxt IS NOT NULL AND k <= {THRESHOLDS}),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY test ORDER BY ok DESC, feature, threshold) = 1), g AS (SELECT label, CASE WHEN coalesce(m1, 0) > coalesce(m0, 0) THEN value > threshold ELSE value <= threshold END AS guess FROM e JOIN b ON e.fold = b.test AND e.feature = b.feature),
    m AS (SELECT count(*) FILTER (guess AND label = 1) AS tp, count(*) FILTER (guess AND label = 0) AS fp, count(*) FILTER (NOT guess AND label = 1) AS fn, count(*) FILTER (NOT guess AND label = 0) AS tn FROM g)"""


@query(_CROSS + """ SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision_, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall_,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM m""")
def confusion_matrix(spark, d):
    """Five contiguous folds, one threshold rule each."""
    rows = features(spark, d).select(F.col("artist_id").alias("id"), *_CV, F.col("is_corpus").alias("label"))
    cell = lambda y, g: _count((F.col("label") == y) & (F.col("guess") == g))
    t = cross_validation(rows, _CV).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, n: F.round(F.when(n > 0, a / n).otherwise(0.0), 4)
    return t.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall_"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"""WITH v AS (SELECT feature, value, label FROM ({_LONG_C})), c AS (SELECT feature, value, count(*) AS n, sum(label) AS k FROM v GROUP BY 1, 2),
    w AS (SELECT feature, value, lead(value) OVER o AS nxt, sum(n) OVER o AS nl, sum(k) OVER o AS kl, sum(n) OVER (PARTITION BY feature) AS nt, sum(k) OVER (PARTITION BY feature) AS kt FROM c WINDOW o AS (PARTITION BY feature ORDER BY value)),
    g AS (SELECT feature, (value + nxt) / 2 AS threshold, round(2 * (kt / nt) * (1 - kt / nt) - nl / nt * (2 * (kl / nl) * (1 - kl / nl)) - (nt - nl) / nt * (2 * ((kt - kl) / (nt - nl)) * (1 - (kt - kl) / (nt - nl))), 10) AS gain FROM w WHERE nxt IS NOT NULL)
    SELECT feature, threshold, round(gain, 8) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1""")
def feature_importance(spark, d):
    """The best split of every continuous feature."""
    return gini_splits(unpivot(features(spark, d), list(CONTINUOUS), "is_corpus")).select("feature", "threshold", F.round("gain", 8).alias("gain"))
