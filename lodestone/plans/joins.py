"""Lookups and joins over the bound relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.rules import REVIEW_AT, is_flagged, lookup
from lodestone.operators import evaluation
from lodestone.operators.network import all_flagged, degrees, limit_per, overlap_with, set_overlaps
from lodestone.operators.written import write_once
from lodestone.plans.base import query
from lodestone.sources import bindings as b
from lodestone.sources.dossier import dossiers


@query("SELECT artist_id, name, threat_status FROM b_artist WHERE threat_status IN ('confirmed_bad', 'suspected')")
def bad_entities(spark, d):
    return b.artists(spark, d).where(F.col("threat_status").isin("confirmed_bad", "suspected")).select("artist_id", "name", "threat_status").orderBy("threat_status", "name")


@query("SELECT artist_id, name, fans FROM b_artist WHERE latest_verdict = 'Suspicious' ORDER BY fans, artist_id LIMIT 50")
def artists_by_verdict(spark, d):
    return b.artists(spark, d).where("latest_verdict = 'Suspicious'").select("artist_id", "name", "fans").orderBy("fans", "artist_id").limit(50)


@query("""SELECT kind, id, n_artists FROM (
    SELECT 'songwriter' AS kind, CAST(songwriter_id AS VARCHAR) AS id, CAST(count(DISTINCT artist_id) AS BIGINT) AS n_artists FROM b_credit GROUP BY 2
    UNION ALL SELECT 'label', label, CAST(count(DISTINCT artist_id) AS BIGINT) FROM b_artist_label GROUP BY 2
    UNION ALL SELECT 'publisher', CAST(nation_id AS VARCHAR), CAST(count(*) AS BIGINT) FROM b_artist GROUP BY 2)
    WHERE n_artists BETWEEN 3 AND 20000 ORDER BY n_artists DESC, kind, id LIMIT 100 OFFSET 10""")
def review_queue(spark, d):
    sides = [
        b.credits(spark, d).groupBy(F.col("songwriter_id").cast("string").alias("id")).agg(F.countDistinct("artist_id").alias("n_artists")).withColumn("kind", F.lit("songwriter")),
        b.artist_labels(spark, d).groupBy(F.col("label").alias("id")).agg(F.countDistinct("artist_id").alias("n_artists")).withColumn("kind", F.lit("label")),
        b.artists(spark, d).groupBy(F.col("nation_id").cast("string").alias("id")).agg(F.count("*").alias("n_artists")).withColumn("kind", F.lit("publisher")),
    ]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).where("n_artists BETWEEN 3 AND 20000")
    return rows.select("kind", "id", "n_artists").orderBy(F.desc("n_artists"), "kind", "id").offset(10).limit(100)


@query("SELECT event_id, api_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM b_api_call WHERE api_name = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def review_history(spark, d):
    rows = b.api_calls(spark, d).where("api_name = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).offset(5).limit(20)
    return rows.select("event_id", "api_name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT artist_id FROM b_artist a WHERE NOT EXISTS (SELECT 1 FROM b_scan_result s WHERE s.artist_id = a.artist_id)")
def should_scan(spark, d):
    done = b.scan_results(spark, d).select("artist_id")
    return b.artists(spark, d).select("artist_id").join(done, "artist_id", "left_anti")


@query("SELECT artist_id FROM b_dossier WHERE followers >= 500000 AND has_wiki_url AND n_genres >= 3 AND albums >= 5 AND NOT name_ai AND n_pfc_labels = 0")
def obviously_legitimate(spark, d):
    return dossiers(spark, d).where(evaluation.legitimate()).select("artist_id")


@query("""WITH s AS (SELECT scan_id, artist_id, 100 - score AS suspicion, count(*) OVER (PARTITION BY scan_id) AS n FROM b_scan_result)
    SELECT scan_id, artist_id, CAST(suspicion AS BIGINT) AS suspicion FROM s WHERE suspicion > 50 OR n <= 20""")
def escalation(spark, d):
    rows = b.scan_results(spark, d).select("scan_id", "artist_id", (F.lit(100) - F.col("score")).alias("suspicion"))
    small = rows.groupBy("scan_id").count().where("count <= 20").select("scan_id", F.lit(True).alias("small"))
    return rows.join(small, "scan_id", "left").where("suspicion > 50 OR small").select("scan_id", "artist_id", "suspicion")


@query("SELECT artist_id, songwriter, role FROM b_credit JOIN b_songwriter USING (songwriter_id)")
def artist_songwriters(spark, d):
    return b.credits(spark, d).join(b.songwriters(spark, d), "songwriter_id").select("artist_id", "songwriter", "role")


@query("SELECT label, artist_id, name FROM b_artist_label JOIN b_artist USING (artist_id)")
def label_artists(spark, d):
    return b.artist_labels(spark, d).join(b.artists(spark, d), "artist_id").select("label", "artist_id", "name")


def _entity_network(spark, d):
    """Every songwriter's artists."""
    return b.credits(spark, d).select("songwriter_id", "artist_id").distinct().join(b.artists(spark, d), "artist_id").select("songwriter_id", "artist_id", "name", "fans")


for _name in ("entity_network", "entity_network_full"):
    query("SELECT songwriter_id, artist_id, name, fans FROM b_credit JOIN b_artist USING (artist_id) GROUP BY ALL", name=_name)(_entity_network)

COWRITERS = "SELECT DISTINCT x.artist_id, y.artist_id AS other FROM (SELECT DISTINCT artist_id, songwriter_id FROM b_credit) x JOIN (SELECT DISTINCT artist_id, songwriter_id FROM b_credit) y USING (songwriter_id) WHERE x.artist_id <> y.artist_id"


@query("WITH l AS (SELECT DISTINCT artist_id, songwriter_id FROM b_credit) SELECT artist_id, songwriter_id, CAST(count(*) OVER (PARTITION BY songwriter_id) - 1 AS BIGINT) AS others FROM l QUALIFY others > 0")
def cowriter_network(spark, d):
    """Every artist's songwriters, with how many other artists each leads to. The pairs of artists themselves, as many as the squares of these, aren't made: network.neighbours() gives one artist's."""
    links = b.credits(spark, d).select("artist_id", "songwriter_id").distinct()
    sizes = links.groupBy("songwriter_id").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return links.join(sizes.hint("rebalance"), "songwriter_id").select("artist_id", "songwriter_id", "others")


@query("SELECT songwriter_id, CAST(count(DISTINCT artist_id) AS BIGINT) AS artists, CAST(count(DISTINCT artist_id) * (count(DISTINCT artist_id) - 1) AS BIGINT) AS pairs FROM b_credit GROUP BY 1")
def cowriter_pairs_full(spark, d):
    """How many ordered pairs of artists each songwriter joins."""
    n = F.countDistinct("artist_id")
    return b.credits(spark, d).groupBy("songwriter_id").agg(n.alias("artists"), (n * (n - 1)).alias("pairs"))


def _written_by(spark, d):
    """Artists with their songwriters, a row a line: degrees() tells them apart, so that they aren't shuffled for that before."""
    return b.lines(spark, d).select("artist_id", F.col("l_suppkey").alias("songwriter_id"))


@query(f"SELECT artist_id, CAST(count(DISTINCT other) AS BIGINT) AS degree FROM ({COWRITERS}) GROUP BY 1")
def cowriter_network_full(spark, d):
    return degrees(_written_by(spark, d), "artist_id", "songwriter_id")


def _label_network(spark, d):
    """How many artists share a label with each; no pairs are made."""
    return degrees(b.artist_labels(spark, d), "artist_id", "label")


for _name in ("label_network", "label_network_full"):
    query("SELECT x.artist_id, CAST(count(DISTINCT y.artist_id) AS BIGINT) AS degree FROM b_artist_label x JOIN b_artist_label y USING (label) WHERE x.artist_id <> y.artist_id GROUP BY 1", name=_name)(_label_network)


def _artist_scan_history(spark, d):
    """The five newest scans of every artist."""
    return limit_per(b.scan_results(spark, d), "artist_id", [F.desc("scan_id")], 5).select("artist_id", "scan_id", "score", "verdict")


for _name in ("artist_scan_history", "artist_scan_history_full"):
    query("SELECT artist_id, scan_id, score, verdict FROM b_scan_result QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY scan_id DESC) <= 5", name=_name)(_artist_scan_history)


@query("""SELECT songwriter_id, CAST(count(*) AS BIGINT) AS n_links, string_agg(artist_id || ':' || role, ',' ORDER BY artist_id, role) AS flagged_artists
    FROM b_credit JOIN b_artist USING (artist_id) WHERE threat_status IN ('confirmed_bad', 'suspected') GROUP BY 1 HAVING count(*) >= 3""")
def cowriter_overlap(spark, d):
    """Link rows count, so that an artist in two roles counts twice."""
    bad = b.artists(spark, d).where(F.col("threat_status").isin("confirmed_bad", "suspected")).select("artist_id")
    rows = b.credits(spark, d).join(bad, "artist_id").groupBy("songwriter_id").agg(F.count("*").alias("n_links"), F.array_sort(F.collect_list(F.struct("artist_id", "role"))).alias("items")).where("n_links >= 3")
    return rows.select("songwriter_id", "n_links", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["artist_id"], x["role"])), ",").alias("flagged_artists"))


@query("""SELECT DISTINCT artist_id, songwriter_id FROM b_credit WHERE songwriter_id IN (SELECT songwriter_id FROM b_credit JOIN b_artist USING (artist_id) WHERE threat_status = 'confirmed_bad')
    AND artist_id NOT IN (SELECT artist_id FROM b_artist WHERE threat_status = 'confirmed_bad')""")
def bad_actor_songwriter_overlap(spark, d):
    return overlap_with(b.credits(spark, d), b.artists(spark, d).where("threat_status = 'confirmed_bad'"), "artist_id", "songwriter_id")


@query("""SELECT s.scan_id, CAST(count(r.artist_id) AS BIGINT) AS result_count, CAST(sum(CASE WHEN r.verdict IN ('Suspicious', 'Likely Artificial') THEN 1 ELSE 0 END) AS BIGINT) AS flagged_count
    FROM (SELECT DISTINCT scan_id FROM b_scan_result UNION ALL SELECT 209901) s LEFT JOIN b_scan_result r ON r.scan_id = s.scan_id GROUP BY 1""")
def scan_history(spark, d):
    """Scans without results stay, with counts of 0."""
    rows = b.scan_results(spark, d)
    scans = rows.select("scan_id").distinct().union(spark.range(1).select(F.lit(209901).cast("long")))
    flagged = F.sum(F.when(is_flagged(F.col("verdict")), 1).otherwise(0)).alias("flagged_count")
    return scans.join(rows, "scan_id", "left").groupBy("scan_id").agg(F.count("artist_id").alias("result_count"), flagged)


@query("""WITH bad AS (SELECT 'label' AS kind, label AS id FROM b_artist_label WHERE label IN ('Brand#3', 'Brand#4') GROUP BY 2 UNION ALL SELECT 'songwriter', CAST(songwriter_id AS VARCHAR) FROM b_songwriter WHERE balance < 0),
    links AS (SELECT artist_id, 'label' AS kind, label AS id FROM b_artist_label UNION ALL SELECT DISTINCT artist_id, 'songwriter', CAST(songwriter_id AS VARCHAR) FROM b_credit)
    SELECT artist_id, kind, id FROM links JOIN bad USING (kind, id)""")
def network_proximity(spark, d):
    labels, writers = b.artist_labels(spark, d), b.credits(spark, d)
    bad = labels.where(F.col("label").isin("Brand#3", "Brand#4")).select(F.lit("label").alias("kind"), F.col("label").alias("id")).distinct()
    bad = bad.union(b.songwriters(spark, d).where("balance < 0").select(F.lit("songwriter"), F.col("songwriter_id").cast("string")))
    links = labels.select("artist_id", F.lit("label").alias("kind"), F.col("label").alias("id")).union(writers.select("artist_id", F.lit("songwriter"), F.col("songwriter_id").cast("string")).distinct())
    return links.join(bad, ["kind", "id"]).select("artist_id", "kind", "id")


@query("SELECT artist_id, label FROM b_artist_label WHERE lower(label) IN ('brand#5', 'brand#6', 'nobody')")
def blocklist_match(spark, d):
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, ("brand#5", "brand#6", "nobody")))).alias("name"))
    rows = b.artist_labels(spark, d)
    return rows.join(F.broadcast(listed), F.lower("label") == F.col("name"), "left_semi").select("artist_id", "label")


@query("""SELECT x.playlist_id AS a, y.playlist_id AS b, CAST(count(*) AS BIGINT) AS shared FROM (SELECT DISTINCT playlist_id, artist_id FROM b_playlist_track) x
    JOIN (SELECT DISTINCT playlist_id, artist_id FROM b_playlist_track) y ON x.artist_id = y.artist_id AND x.playlist_id < y.playlist_id GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY shared DESC, a, b LIMIT 30""")
def playlist_overlap(spark, d):
    return set_overlaps(b.playlist_tracks(spark, d), "playlist_id", "artist_id", 5, 30)


@query("""SELECT x.label AS a, y.label AS b, CAST(count(*) AS BIGINT) AS shared FROM b_artist_label x JOIN b_artist_label y ON x.artist_id = y.artist_id AND x.label < y.label
    GROUP BY 1, 2 ORDER BY shared DESC, a, b LIMIT 20""")
def label_cooccurrence(spark, d):
    return set_overlaps(b.artist_labels(spark, d), "label", "artist_id", 1, 20)


@query("""SELECT songwriter_id, CAST(count(DISTINCT artist_id) AS BIGINT) AS n_artists, CASE WHEN count(DISTINCT artist_id) >= 10 THEN 'high' ELSE 'medium' END AS priority
    FROM b_credit WHERE songwriter_id NOT IN (SELECT songwriter_id FROM b_songwriter WHERE balance < 0) GROUP BY 1 HAVING count(DISTINCT artist_id) >= 5""")
def new_bad_actors(spark, d):
    listed = b.songwriters(spark, d).where("balance < 0").select("songwriter_id")
    rows = b.credits(spark, d).join(listed, "songwriter_id", "left_anti").groupBy("songwriter_id").agg(F.countDistinct("artist_id").alias("n_artists")).where("n_artists >= 5")
    return rows.withColumn("priority", F.when(F.col("n_artists") >= 10, "high").otherwise("medium"))


_GRAPH_LINKS = "SELECT DISTINCT 'songwriter' AS kind, CAST(songwriter_id AS VARCHAR) AS id, artist_id FROM b_credit UNION ALL SELECT 'label', label, artist_id FROM b_artist_label UNION ALL SELECT 'publisher', CAST(nation_id AS VARCHAR), artist_id FROM b_artist"


@query(f"""WITH links AS ({_GRAPH_LINKS}), sized AS (SELECT kind, id, count(*) AS n, count(*) FILTER (fans < 1000) AS flagged FROM links JOIN b_artist USING (artist_id) GROUP BY 1, 2),
    wide AS (SELECT * FROM sized WHERE n >= 2 AND flagged >= CASE kind WHEN 'songwriter' THEN 3 WHEN 'label' THEN 5 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) <= 200),
    edges AS (SELECT kind, id, artist_id FROM links JOIN wide USING (kind, id) QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY artist_id) <= 50)
    SELECT 'edge' AS what, kind, id, artist_id FROM edges UNION ALL SELECT DISTINCT 'artist', NULL, NULL, artist_id FROM edges UNION ALL SELECT DISTINCT 'entity', kind, id, CAST(NULL AS BIGINT) FROM edges""")
def network_graph(spark, d):
    """Nodes and edges of entities with enough flagged artists for review: the 200 largest of each kind, at most 50 artists each."""
    text = lambda c: F.col(c).cast("string").alias("id")
    kinds = (("songwriter", b.credits(spark, d).select(text("songwriter_id"), "artist_id").distinct()), ("label", b.artist_labels(spark, d).select(text("label"), "artist_id")), ("publisher", b.artists(spark, d).select(text("nation_id"), "artist_id")))
    links = kinds[0][1].withColumn("kind", F.lit(kinds[0][0]))
    for kind, rows in kinds[1:]:
        links = links.unionByName(rows.withColumn("kind", F.lit(kind)))
    flags = b.artists(spark, d).select("artist_id", (F.col("fans") < 1000).cast("int").alias("flag"))
    sized = links.join(flags, "artist_id").groupBy("kind", "id").agg(F.count("*").alias("n"), F.sum("flag").alias("flagged"))
    sized = sized.where((F.col("n") >= 2) & (F.col("flagged") >= lookup(REVIEW_AT, F.col("kind"))))
    wide = limit_per(sized, "kind", [F.desc("n"), F.col("id")], 200).select("kind", "id")
    edges = limit_per(links.join(F.broadcast(wide), ["kind", "id"]), ["kind", "id"], [F.col("artist_id")], 50).select(F.lit("edge").alias("what"), "kind", "id", "artist_id")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    artists = edges.select(F.lit("artist").alias("what"), none("string", "kind"), none("string", "id"), "artist_id").distinct()
    return edges.unionByName(artists).unionByName(edges.select(F.lit("entity").alias("what"), "kind", "id", none("long", "artist_id")).distinct())


@query("""WITH links AS (SELECT DISTINCT o_custkey AS artist_id, l_partkey AS contributor_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT contributor_id, CAST(count(*) AS BIGINT) AS n_artists, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence
    FROM links JOIN b_artist USING (artist_id) GROUP BY 1 HAVING count(*) >= 2 AND bool_and(fans < 9000)""")
def exclusive_contributors(spark, d):
    """Parts stand for contributors here: songwriters have too many artists for all to be flagged."""
    flags = b.artists(spark, d).select("artist_id", (F.col("fans") < 9000).alias("flag"))
    rows = all_flagged(b.lines(spark, d).select("artist_id", F.col("l_partkey").alias("contributor_id")), flags, "artist_id", "contributor_id", 2)
    return rows.withColumn("confidence", F.when(F.col("n_artists") >= 5, "high").when(F.col("n_artists") >= 3, "medium").otherwise("low"))


@query("""SELECT label, CAST(count(*) AS BIGINT) AS n_flagged, CASE WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM b_artist_label JOIN b_artist USING (artist_id)
    WHERE threat_status IN ('confirmed_bad', 'suspected') AND label NOT IN ('Brand#1', 'Brand#2') GROUP BY 1 HAVING count(*) >= 2""")
def suspicious_labels(spark, d):
    bad = b.artists(spark, d).where(F.col("threat_status").isin("confirmed_bad", "suspected")).select("artist_id")
    rows = b.artist_labels(spark, d).where(~F.col("label").isin("Brand#1", "Brand#2")).join(bad, "artist_id", "left_semi").groupBy("label").agg(F.count("*").alias("n_flagged")).where("n_flagged >= 2")
    return rows.withColumn("confidence", F.when(F.col("n_flagged") >= 3, "medium").otherwise("low"))


@query("SELECT artist_id, name FROM b_artist WHERE latest_verdict = 'Likely Artificial' AND name NOT IN ('Customer#000000010', 'Customer#000000020')")
def new_ai_artists(spark, d):
    listed = spark.range(1).select(F.explode(F.array(F.lit("Customer#000000010"), F.lit("Customer#000000020"))).alias("name"))
    return b.artists(spark, d).where("latest_verdict = 'Likely Artificial'").join(F.broadcast(listed), "name", "left_anti").select("artist_id", "name")


_PRIOR_SQL = """WITH w AS (SELECT DISTINCT artist_id, songwriter_id FROM b_credit), wb AS (SELECT artist_id, count(*) FILTER (balance < 0) AS bad, count(*) FILTER (balance >= 0 AND balance < 500) AS susp FROM w JOIN b_songwriter USING (songwriter_id) GROUP BY 1),
    lb AS (SELECT artist_id, count(*) FILTER (label IN ('Brand#3', 'Brand#4')) AS bad, count(*) FILTER (label = 'Brand#5') AS susp FROM b_artist_label GROUP BY 1), bad AS (SELECT artist_id FROM b_artist WHERE threat_status IN ('confirmed_bad', 'suspected')),
    c AS (SELECT x.artist_id, count(DISTINCT y.artist_id) AS n FROM w x JOIN (SELECT * FROM w SEMI JOIN bad USING (artist_id)) y USING (songwriter_id) WHERE x.artist_id <> y.artist_id GROUP BY 1)
    SELECT a.artist_id, threat_status AS status, CAST(coalesce(wb.bad, 0) AS BIGINT) AS bad_writers, CAST(coalesce(wb.susp, 0) AS BIGINT) AS suspected_writers, CAST(coalesce(lb.bad, 0) AS BIGINT) AS bad_labels, CAST(coalesce(lb.susp, 0) AS BIGINT) AS suspected_labels, CAST(coalesce(c.n, 0) AS BIGINT) AS connections
    FROM b_artist a LEFT JOIN wb USING (artist_id) LEFT JOIN lb USING (artist_id) LEFT JOIN c USING (artist_id)"""


@query(_PRIOR_SQL)
def prior_intelligence(spark, d):
    """What the entity store holds on the artist, its labels, its songwriters, and flagged artists that share one.

    Each side is counted before it is joined, so that labels and writers don't multiply each other; the connections are counted by bitmaps.
    """
    credits = write_once(_written_by(spark, d).repartition("artist_id").distinct(), "credits")  # for writers and connections
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    balance, label = F.col("balance"), F.col("label")
    writers = credits.join(b.songwriters(spark, d).select("songwriter_id", "balance"), "songwriter_id")
    writers = writers.groupBy("artist_id").agg(count(balance < 0).alias("bad_writers"), count((balance >= 0) & (balance < 500)).alias("suspected_writers"))
    labels = b.artist_labels(spark, d).groupBy("artist_id").agg(count(label.isin("Brand#3", "Brand#4")).alias("bad_labels"), count(label == "Brand#5").alias("suspected_labels"))
    artists = b.artists(spark, d).select("artist_id", F.col("threat_status").alias("status"))
    near = degrees(credits, "artist_id", "songwriter_id", artists.where(F.col("status").isin("confirmed_bad", "suspected"))).select("artist_id", F.col("marked").alias("connections"))
    rows = artists.join(writers, "artist_id", "left").join(labels, "artist_id", "left").join(near, "artist_id", "left")
    return rows.fillna(0, ["bad_writers", "suspected_writers", "bad_labels", "suspected_labels", "connections"])


@query(f"SELECT artist_id, round(avg(CASE WHEN o.threat_status = 'confirmed_bad' THEN 1.0 ELSE 0.0 END), 4) AS bad_share FROM ({COWRITERS}) n JOIN (SELECT artist_id AS other, threat_status FROM b_artist) o USING (other) GROUP BY 1")
def similar_corpus_overlap(spark, d):
    """The share of an artist's neighbours that belong to the corpus (are listed as bad); no pairs are made."""
    rows = degrees(_written_by(spark, d), "artist_id", "songwriter_id", b.artists(spark, d).where("threat_status = 'confirmed_bad'"))
    return rows.select("artist_id", F.round(F.col("marked") / F.col("degree"), 4).alias("bad_share"))
