"""Point lookups, entity joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.network import limit_per
from lodestone.operators.order import numbered
from lodestone.operators.written import write_once
from lodestone.plans.base import query
from lodestone.sources import bindings as b

_NORM = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({{}})), '\s*\b({text.ENTITY_WORDS})\b\.?', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_ASKED = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_brand) || ' Records' WHEN 1 THEN p_brand || ', Inc.' ELSE 'Nobody ' || p_brand END AS asked FROM part"


@query(f"WITH a AS ({_ASKED}), l AS (SELECT DISTINCT p_brand AS label FROM part) SELECT id, label FROM a JOIN l ON {_NORM.format('asked')} = {_NORM.format('label')}")
def lookup_by_name(spark, d):
    """Labels by any spelling that comes to the same normalized name."""
    brand = F.col("p_brand")
    asked = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper(brand), F.lit(" Records"))).when(F.col("p_partkey") % 3 == 1, F.concat(brand, F.lit(", Inc."))).otherwise(F.concat(F.lit("Nobody "), brand))
    parts = b.table(spark, d, "part")
    labels = parts.select(brand.alias("label")).distinct().withColumn("norm", text.normalize_entity(F.col("label")))
    return parts.select(F.col("p_partkey").alias("id"), text.normalize_entity(asked).alias("norm")).join(labels, "norm").select("id", "label")


@query("SELECT artist_id, name, fans FROM b_artist WHERE artist_id = (SELECT max(artist_id) FROM b_artist)")
def point_read(spark, d):
    """One artist by its key: a literal in the scan's filter."""
    artists = b.artists(spark, d)
    key = artists.agg(F.max("artist_id")).first()[0]
    return artists.where(F.col("artist_id") == F.lit(key)).select("artist_id", "name", "fans")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS place FROM events QUALIFY place <= 10")
def entity_observations(spark, d):
    """The ten newest observations of every entity."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = b.table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("place", F.row_number().over(newest)).where("place <= 10")
    return rows.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


_ALIAS_SQL = "SELECT DISTINCT 'artist' AS kind1, c_custkey AS id1, 'nation' AS kind2, CAST(c_nationkey AS BIGINT) AS id2 FROM customer"


def _aliases(spark, d):
    rows = b.table(spark, d, "customer")
    return rows.select(F.lit("artist").alias("kind1"), F.col("c_custkey").alias("id1"), F.lit("nation").alias("kind2"), F.col("c_nationkey").cast("long").alias("id2")).distinct()


@query(f"SELECT kind1 AS kind, id1 AS id, kind2 AS other_kind, id2 AS other_id FROM ({_ALIAS_SQL}) UNION SELECT kind2, id2, kind1, id1 FROM ({_ALIAS_SQL})")
def entity_aliases(spark, d):
    """Aliases in both directions: a union of two projections, no OR in a join."""
    rows = _aliases(spark, d)
    return rows.toDF("kind", "id", "other_kind", "other_id").union(rows.select("kind2", "id2", "kind1", "id1")).distinct()


@query("SELECT name, CAST(row_number() OVER (ORDER BY name, artist_id) AS BIGINT) AS place FROM b_artist WHERE threat_status = 'confirmed_bad'")
def export_blocklist(spark, d):
    """All listed names in order."""
    rows = b.artists(spark, d).where("threat_status = 'confirmed_bad'").select("name", "artist_id")
    return numbered(rows, [F.col("name"), F.col("artist_id")]).select("name", F.col("place").cast("long").alias("place"))


@query("SELECT artist_id, name FROM b_artist WHERE contains(lower(name), '99')")
def name_filter(spark, d):
    return b.artists(spark, d).where(F.lower("name").contains("99")).select("artist_id", "name")


_VIEW_SQL = "SELECT scan_id, artist_id, CASE WHEN artist_id % 9 = 0 THEN NULL ELSE score END AS score, name FROM b_scan_result JOIN b_artist USING (artist_id) WHERE verdict <> 'Verified Artist'"


@query(f"""SELECT scan_id, artist_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(score, 0), artist_id) AS BIGINT) AS by_score, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(score, 0) DESC, artist_id) AS BIGINT) AS by_score_desc,
    CAST(row_number() OVER (PARTITION BY scan_id ORDER BY name, artist_id) AS BIGINT) AS by_name FROM ({_VIEW_SQL})""")
def scan_results_view(spark, d):
    """A scan's results filtered by verdict, with their place in each of three orders; a missing score counts as 0."""
    rows = b.scan_results(spark, d).where("verdict <> 'Verified Artist'").join(b.artists(spark, d).select("artist_id", "name"), "artist_id")
    rows = rows.withColumn("score", F.coalesce(F.when(F.col("artist_id") % 9 != 0, F.col("score")), F.lit(0)))
    place = lambda *order: F.row_number().over(Window.partitionBy("scan_id").orderBy(*order, "artist_id")).cast("long")
    return rows.select("scan_id", "artist_id", place(F.col("score")).alias("by_score"), place(F.desc("score")).alias("by_score_desc"), place(F.col("name")).alias("by_name"))


@query("SELECT artist_id, name, label FROM b_artist JOIN b_artist_label USING (artist_id)")
def artist_labels(spark, d):
    return b.artists(spark, d).select("artist_id", "name").join(b.artist_labels(spark, d), "artist_id")


@query("SELECT DISTINCT songwriter_id, songwriter, artist_id, name FROM b_songwriter JOIN b_credit USING (songwriter_id) JOIN b_artist USING (artist_id)")
def songwriter_artists(spark, d):
    links = b.credits(spark, d).select("songwriter_id", "artist_id").distinct()
    return links.join(b.songwriters(spark, d).select("songwriter_id", "songwriter"), "songwriter_id").join(b.artists(spark, d).select("artist_id", "name"), "artist_id").select("songwriter_id", "songwriter", "artist_id", "name")


#: Similar artists of the bound tables: those one, seven and thirty numbers on.
SIMILAR_SQL = "SELECT a.artist_id, a.artist_id + step AS similar_id, CASE WHEN step = 7 THEN 'lastfm' ELSE 'deezer' END AS source FROM b_artist a, (SELECT unnest([1, 7, 30]) AS step)"


def similar(spark, d):
    step = F.explode(F.array(F.lit(1), F.lit(7), F.lit(30)))
    rows = b.artists(spark, d).select("artist_id", step.alias("step"))
    return rows.select("artist_id", (F.col("artist_id") + F.col("step")).alias("similar_id"), F.when(F.col("step") == 7, "lastfm").otherwise("deezer").alias("source"))


@query(f"SELECT s.artist_id, s.similar_id, o.name, s.source FROM ({SIMILAR_SQL}) s JOIN b_artist o ON s.similar_id = o.artist_id")
def similar_artists(spark, d):
    other = b.artists(spark, d).select(F.col("artist_id").alias("similar_id"), "name")
    return similar(spark, d).join(other, "similar_id").select("artist_id", "similar_id", "name", "source")


@query("SELECT scan_id, artist_id, name, score, verdict FROM b_scan_result JOIN b_artist USING (artist_id)")
def scan_artists(spark, d):
    return b.scan_results(spark, d).join(b.artists(spark, d).select("artist_id", "name"), "artist_id").select("scan_id", "artist_id", "name", "score", "verdict").orderBy("scan_id", "score", "artist_id")


@query("""SELECT a.artist_id, lower(a.name) IN ('customer#000000007', 'customer#000000070') AS name_listed, CAST(coalesce(l.n, 0) AS BIGINT) AS labels_listed, CAST(coalesce(w.n, 0) AS BIGINT) AS writers_listed FROM b_artist a
    LEFT JOIN (SELECT artist_id, count(*) AS n FROM b_artist_label WHERE lower(label) IN ('brand#5', 'brand#6') GROUP BY 1) l USING (artist_id)
    LEFT JOIN (SELECT artist_id, count(DISTINCT songwriter_id) AS n FROM b_credit JOIN b_songwriter USING (songwriter_id) WHERE balance < 0 GROUP BY 1) w USING (artist_id)""")
def blocklist_membership(spark, d):
    """Name, labels and contributors of every artist against the lists."""
    lists = spark.createDataFrame([("label", "brand#5"), ("label", "brand#6"), ("name", "customer#000000007"), ("name", "customer#000000070")], "kind string, listed string")
    of = lambda kind: F.broadcast(lists.where(F.col("kind") == kind).select("listed"))  # noqa: E731  a handful of names
    labels = b.artist_labels(spark, d).withColumn("listed", F.lower("label")).join(of("label"), "listed", "left_semi").groupBy("artist_id").agg(F.count("*").alias("labels_listed"))
    bad = b.songwriters(spark, d).where("balance < 0").select("songwriter_id")
    writers = b.credits(spark, d).select("artist_id", "songwriter_id").distinct().join(bad, "songwriter_id", "left_semi").groupBy("artist_id").agg(F.count("*").alias("writers_listed"))
    names = of("name").withColumn("name_listed", F.lit(True))
    rows = b.artists(spark, d).select("artist_id", F.lower("name").alias("listed")).join(names, "listed", "left").join(labels, "artist_id", "left").join(writers, "artist_id", "left")
    return rows.select("artist_id", F.coalesce("name_listed", F.lit(False)).alias("name_listed"), F.coalesce("labels_listed", F.lit(0)).alias("labels_listed"), F.coalesce("writers_listed", F.lit(0)).alias("writers_listed"))


_LISTED_SQL = "SELECT unnest([lower(trim(n_name)), 'nation ' || n_nationkey, 'region ' || n_regionkey]) AS alias, n_nationkey AS entity, n_name FROM nation"


@query(f"WITH l AS ({_LISTED_SQL}), one AS (SELECT alias, arg_max(n_name, entity) AS entity FROM l GROUP BY 1), asked AS (SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN ' Nation ' || s_nationkey ELSE 'REGION ' || (s_nationkey % 7) END AS name FROM supplier) SELECT id, entity FROM asked JOIN one ON lower(trim(name)) = alias")
def alias_blocklist(spark, d):
    """Names against listed entities by name or alias; of entities that share an alias the last definition wins."""
    nations = b.table(spark, d, "nation")
    names = F.array(F.lower(F.trim("n_name")), F.concat(F.lit("nation "), F.col("n_nationkey")), F.concat(F.lit("region "), F.col("n_regionkey")))
    listed = nations.select(F.explode(names).alias("alias"), "n_nationkey", "n_name").groupBy("alias").agg(F.max_by("n_name", "n_nationkey").alias("entity"))
    key = F.col("s_nationkey")
    asked = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" Nation "), key)).otherwise(F.concat(F.lit("REGION "), key % 7))
    return b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lower(F.trim(asked)).alias("alias")).join(listed, "alias").select("id", "entity")


@query("SELECT artist_id, CAST(count(*) AS BIGINT) AS associated, CAST(count(*) FILTER (balance < 0) AS BIGINT) AS flagged, round(count(*) FILTER (balance < 0) / count(*), 4) AS ratio, CASE WHEN count(*) FILTER (balance < 0) = 0 THEN 'none' WHEN count(*) FILTER (balance < 0) / count(*) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT DISTINCT artist_id, songwriter_id FROM b_credit) JOIN b_songwriter USING (songwriter_id) GROUP BY 1")
def collaborator_crossref(spark, d):
    """How many of an artist's distinct collaborators are listed."""
    rows = b.credits(spark, d).select("artist_id", "songwriter_id").distinct().join(b.songwriters(spark, d).select("songwriter_id", (F.col("balance") < 0).cast("long").alias("bad")), "songwriter_id")
    rows = rows.groupBy("artist_id").agg(F.count("*").alias("associated"), F.sum("bad").alias("flagged"))
    share = F.col("flagged") / F.col("associated")
    return rows.select("artist_id", "associated", "flagged", F.round(share, 4).alias("ratio"), F.when(F.col("flagged") == 0, "none").when(share >= 0.5, "moderate").otherwise("weak").alias("strength"))


ENTITY_PCT_SQL = """WITH l AS (SELECT DISTINCT artist_id, songwriter_id FROM b_credit), n AS (SELECT count(DISTINCT artist_id) AS n FROM l), p AS (SELECT songwriter_id, round(count(*) / max(n.n), 4) AS pct FROM l, n GROUP BY 1),
    k AS (SELECT count(DISTINCT artist_id) AS n FROM b_artist_label), q AS (SELECT label, round(count(*) / max(k.n), 4) AS pct FROM b_artist_label, k GROUP BY 1),
    w AS (SELECT artist_id, max(pct) AS producer_pct, bool_or(balance < 0) AS bad_producer FROM l JOIN p USING (songwriter_id) JOIN b_songwriter USING (songwriter_id) GROUP BY 1), x AS (SELECT artist_id, max(pct) AS label_pct, bool_or(label IN ('Brand#1', 'Brand#2')) AS bad_label FROM b_artist_label JOIN q USING (label) GROUP BY 1)"""


def corpus_features_of(spark, d):
    """artist_id with the largest corpus share of its songwriters and labels, and whether one is listed."""
    links, labels = write_once(b.credits(spark, d).select("artist_id", "songwriter_id").distinct(), "links"), write_once(b.artist_labels(spark, d), "labels")  # each for its three uses

    def shares(rows, key):
        total = rows.agg(F.countDistinct("artist_id").alias("n_all"))
        return rows.groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(key, F.round(F.col("n") / F.col("n_all"), 4).alias("pct"))

    writers = links.join(shares(links, "songwriter_id"), "songwriter_id").join(b.songwriters(spark, d).select("songwriter_id", (F.col("balance") < 0).alias("bad")), "songwriter_id")
    writers = writers.groupBy("artist_id").agg(F.max("pct").alias("producer_pct"), F.bool_or("bad").alias("bad_producer"))
    own = labels.join(shares(labels, "label"), "label").groupBy("artist_id").agg(F.max("pct").alias("label_pct"), F.bool_or(F.col("label").isin("Brand#1", "Brand#2")).alias("bad_label"))
    return writers.join(own, "artist_id")


@query(ENTITY_PCT_SQL + " SELECT artist_id, producer_pct, bad_producer, label_pct, bad_label FROM w JOIN x USING (artist_id)")
def corpus_features(spark, d):
    return corpus_features_of(spark, d)


@query("SELECT n_nationkey AS playlist_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000)")
def resume_fetch(spark, d):
    """Playlists that aren't fetched yet."""
    done = b.table(spark, d, "supplier").where("s_acctbal < 5000").select(F.col("s_nationkey").alias("playlist_id"))
    return b.table(spark, d, "nation").select(F.col("n_nationkey").alias("playlist_id")).join(done, "playlist_id", "left_anti")


@query("SELECT artist_id, seq, strength, CAST(row_number() OVER (PARTITION BY artist_id ORDER BY strength DESC, seq) AS BIGINT) AS place FROM b_found")
def export_order(spark, d):
    """The export's order: strengths as text, so that weak comes before strong and moderate."""
    from lodestone.operators.collectors import collect
    from lodestone.sources.dossier import dossiers

    place = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc("strength"), "seq")).cast("long")
    return collect(dossiers(spark, d)).select("artist_id", "seq", "strength", place.alias("place"))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def shared_names(spark, d):
    """Names that two sets share."""
    nations = b.table(spark, d, "nation")
    named = lambda rows, key: rows.select(F.col(key).alias("n_nationkey")).join(nations, "n_nationkey").select(F.col("n_name").alias("name"))
    return named(b.table(spark, d, "customer").where("c_acctbal < 0"), "c_nationkey").intersect(named(b.table(spark, d, "supplier"), "s_nationkey"))


@query("WITH t AS (SELECT playlist_id, artist_id, CASE WHEN playlist_id % 2 = 0 THEN artist_id END AS id FROM b_playlist_track), any_ids AS (SELECT playlist_id, bool_or(id IS NOT NULL) AS has FROM t GROUP BY 1) SELECT DISTINCT t.playlist_id, CASE WHEN has THEN CAST(id AS VARCHAR) ELSE name END AS key FROM t JOIN any_ids USING (playlist_id) JOIN b_artist USING (artist_id) WHERE NOT has OR id IS NOT NULL")
def unique_artist_keys(spark, d):
    """Artists of each playlist by id where it has any ids, else by name."""
    rows = b.playlist_tracks(spark, d).select("playlist_id", "artist_id", F.when(F.col("playlist_id") % 2 == 0, F.col("artist_id")).alias("id"))
    has = rows.groupBy("playlist_id").agg(F.bool_or(F.col("id").isNotNull()).alias("has"))
    rows = rows.join(F.broadcast(has), "playlist_id").join(b.artists(spark, d).select("artist_id", "name"), "artist_id").where("NOT has OR id IS NOT NULL")
    return rows.select("playlist_id", F.when(F.col("has"), F.col("id").cast("string")).otherwise(F.col("name")).alias("key")).distinct()


@query("SELECT p_partkey AS id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part)")
def ordered_distinct(spark, d):
    """Words without repeats, in the order of their first place."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_distinct(words), " ").alias("words"))


@query("SELECT artist_id, threat_status = 'confirmed_bad' AS priority FROM b_artist ORDER BY priority DESC, md5(name || '42'), artist_id LIMIT 100")
def demo_sample(spark, d):
    """A fixed sample: the listed first, then by a hash with a seed."""
    rows = b.artists(spark, d).select("artist_id", "name", (F.col("threat_status") == "confirmed_bad").alias("priority"))
    return rows.orderBy(F.desc("priority"), F.md5(F.concat("name", F.lit("42")).cast("binary")), "artist_id").limit(100).select("artist_id", "priority")


@query(f"WITH s AS ({SIMILAR_SQL}) SELECT similar_id, CAST(count(*) AS BIGINT) AS connections, string_agg(CAST(s.artist_id AS VARCHAR), ',' ORDER BY s.artist_id) AS connected_to, bool_or(a.artist_id IS NOT NULL) AS in_corpus FROM s LEFT JOIN b_artist a ON s.similar_id = a.artist_id GROUP BY 1")
def similar_graph(spark, d):
    corpus = b.artists(spark, d).select(F.col("artist_id").alias("similar_id"), F.lit(True).alias("known"))
    rows = similar(spark, d).groupBy("similar_id").agg(F.count("*").alias("connections"), F.array_sort(F.collect_list("artist_id")).alias("ids")).join(corpus, "similar_id", "left")
    return rows.select("similar_id", "connections", F.array_join(F.col("ids").cast("array<string>"), ",").alias("connected_to"), F.coalesce("known", F.lit(False)).alias("in_corpus"))


@query("SELECT name, label, fans FROM b_artist_label JOIN b_artist USING (artist_id) QUALIFY row_number() OVER (PARTITION BY label ORDER BY fans DESC, artist_id) <= 20")
def network_head(spark, d):
    """The first twenty artists of each label, as the command line shows them."""
    rows = b.artist_labels(spark, d).join(b.artists(spark, d).select("artist_id", "name", "fans"), "artist_id")
    return limit_per(rows, "label", [F.desc("fans"), F.col("artist_id")], 20).select("name", "label", "fans")
