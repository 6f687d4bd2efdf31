"""Labels as four sources spell them, resolved into entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import resolution
from lodestone.plans.base import query
from lodestone.sources import bindings as b

_MENTIONS = """SELECT DISTINCT p_brand || '-' || p_partkey % 17 || CASE (p_partkey // 17) % 7 WHEN 0 THEN ' Records' WHEN 1 THEN ' Music Group' WHEN 2 THEN ', Inc.' WHEN 3 THEN '  Intl' WHEN 4 THEN ' ENTERTAINMENT' WHEN 5 THEN ' & Friends' ELSE '' END AS name,
    CASE l_suppkey % 4 WHEN 0 THEN 'deezer' WHEN 1 THEN 'discogs' WHEN 2 THEN 'musicbrainz' ELSE 'album' END AS source, o_custkey AS artist_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
_ALIASES = "SELECT 'Brand#' || (n_nationkey % 5 + 1) || '-' || n_nationkey % 17 || ' & Friends' AS alias, 'brand#' || (n_nationkey % 3 + 2) || '-' || (n_nationkey + 5) % 17 AS name FROM nation"
_LISTED = "SELECT 'BRAND#' || (n_nationkey % 5 + 1) || '-' || n_nationkey % 17 || ' Records' AS name FROM nation WHERE n_nationkey < 6"
_KEY = rf"translate(trim(regexp_replace(lower(trim(name)), '\s+({text.LABEL_ENDINGS})\.?$', '')), '.,''\"', '')"
_NORM = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\s*\b({text.ENTITY_WORDS})\b\.?', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_CLASSES = f"""m AS ({_MENTIONS}), al AS ({_ALIASES}), ns AS (SELECT name FROM m UNION SELECT alias FROM al UNION SELECT name FROM al),
  ks AS (SELECT name, 'k:' || {_KEY} AS key FROM ns WHERE {_KEY} <> '' UNION SELECT name, 'n:' || {_NORM} FROM ns WHERE {_NORM} <> ''),
  lk AS (SELECT x.name AS a, y.name AS b FROM ks x JOIN ks y USING (key) UNION SELECT alias, name FROM al UNION SELECT name, alias FROM al),
  rc AS (SELECT name AS node, name AS other FROM ns UNION SELECT rc.node, lk.b FROM rc JOIN lk ON rc.other = lk.a),
  cl AS (SELECT node AS name, min(other) AS entity FROM rc GROUP BY 1)"""


def label_mentions(spark, d):
    k = F.col("p_partkey")
    ends = F.array(*map(F.lit, (" Records", " Music Group", ", Inc.", "  Intl", " ENTERTAINMENT", " & Friends", "")))
    parts = b.table(spark, d, "part").select(k.alias("l_partkey"), F.concat("p_brand", F.lit("-"), (k % 17).cast("string"), F.get(ends, (F.floor(k / 17) % 7).cast("int"))).alias("name"))
    sources = F.array(*map(F.lit, ("deezer", "discogs", "musicbrainz", "album")))
    return b.lines(spark, d).join(parts, "l_partkey").select("name", F.get(sources, (F.col("l_suppkey") % 4).cast("int")).alias("source"), "artist_id").distinct()


def label_aliases(spark, d):
    n = F.col("n_nationkey")
    text_ = lambda x: x.cast("string")
    return b.table(spark, d, "nation").select(F.concat(F.lit("Brand#"), text_(n % 5 + 1), F.lit("-"), text_(n % 17), F.lit(" & Friends")).alias("alias"), F.concat(F.lit("brand#"), text_(n % 3 + 2), F.lit("-"), text_((n + 5) % 17)).alias("name"))


def listed_labels(spark, d):
    n = F.col("n_nationkey")
    return b.table(spark, d, "nation").where(n < 6).select(F.concat(F.lit("BRAND#"), (n % 5 + 1).cast("string"), F.lit("-"), (n % 17).cast("string"), F.lit(" Records")).alias("name"))


@query(f"WITH RECURSIVE {_CLASSES} SELECT name, entity FROM cl")
def label_classes(spark, d):
    """Every spelling of a label with the entity that it is."""
    return resolution.resolve(label_mentions(spark, d), label_aliases(spark, d))


@query(f"""WITH RECURSIVE {_CLASSES}, r AS (SELECT m.*, entity FROM m JOIN cl USING (name)), v AS (SELECT entity, name, count(DISTINCT artist_id) AS n FROM r GROUP BY 1, 2), li AS ({_LISTED}), kn AS (SELECT DISTINCT entity FROM cl WHERE lower(trim(name)) IN (SELECT lower(trim(name)) FROM li))
  SELECT entity, any_value(display) AS display, CAST(any_value(nv) AS BIGINT) AS n_variants, any_value(variants) AS variants, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, CAST(count(DISTINCT artist_id) AS BIGINT) AS n_artists,
    round(count(DISTINCT artist_id) / (SELECT count(DISTINCT artist_id) FROM m), 4) AS share, entity IN (SELECT entity FROM kn) AS known
  FROM r JOIN (SELECT entity, count(*) AS nv, string_agg(name, '|' ORDER BY name) AS variants FROM v GROUP BY 1) USING (entity) JOIN (SELECT entity, name AS display FROM v QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, name) = 1) USING (entity) GROUP BY entity""")
def label_entities(spark, d):
    """The label side of the entity graph: variants, sources, artists and the blocklist by resolved label."""
    return resolution.entities(label_mentions(spark, d), label_aliases(spark, d), listed_labels(spark, d))
