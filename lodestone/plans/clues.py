"""The context clues of every label, songwriter and publisher."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import clues
from lodestone.operators.written import write_once
from lodestone.plans.base import query
from lodestone.sources import bindings as b

_PLATFORMS, _GENRE = "artist_id % 5 + CASE WHEN fans > 5000 THEN 1 ELSE 0 END", "CASE WHEN artist_id % 3 = 0 THEN lower(genre) END"
_LINKS = "SELECT DISTINCT 'songwriter' AS kind, CAST(l_partkey AS VARCHAR) AS id, o_custkey AS artist_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'label', label, artist_id FROM b_artist_label UNION ALL SELECT 'publisher', CAST(nation_id AS VARCHAR), artist_id FROM b_artist"
_ALIASES = "SELECT 'songwriter' AS kind, CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 2 WHEN 0 THEN 'label' ELSE 'songwriter' END AS other_kind, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE CAST(p_partkey // 2 AS VARCHAR) END AS other_id FROM part UNION ALL SELECT 'label', 'Brand#' || (n_nationkey + 1), 'label', 'Brand#' || (n_nationkey % 7 + 1) FROM nation UNION ALL SELECT 'publisher', CAST(n_nationkey AS VARCHAR), 'label', 'Brand#3' FROM nation"
_BAD = "SELECT 'label' AS kind, label AS id, label AS name FROM b_artist_label WHERE label IN ('Brand#3', 'Brand#4') GROUP BY label UNION ALL SELECT 'songwriter', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey % 13 = 0"
_FLAG = "threat_status IN ('confirmed_bad', 'suspected') OR latest_verdict IN ('Suspicious', 'Likely Artificial')"


def sides(spark, d):
    """links, artists, genres, labels, aliases, bad."""
    artists, labels = b.artists(spark, d), write_once(b.artist_labels(spark, d), "labels")  # for links, labels and bad
    text = lambda c: F.col(c).cast("string")
    links = b.lines(spark, d).select(F.lit("songwriter").alias("kind"), text("l_partkey").alias("id"), "artist_id")  # told apart with the others
    links = links.union(labels.select(F.lit("label"), "label", "artist_id")).union(artists.select(F.lit("publisher"), text("nation_id"), "artist_id"))
    told = artists.select("artist_id", F.expr(_PLATFORMS).alias("platforms"), F.expr(_FLAG).alias("flagged"))
    genres = artists.select("artist_id", F.explode(F.array(F.col("genre"), F.expr(_GENRE))).alias("genre"))
    parts, k, n = b.table(spark, d, "part"), F.col("p_partkey"), F.col("n_nationkey")
    aliases = parts.select(F.lit("songwriter").alias("kind"), text("p_partkey").alias("id"), F.when(k % 2 == 0, "label").otherwise("songwriter").alias("other_kind"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.floor(k / 2).cast("string")).alias("other_id"))
    nations = b.table(spark, d, "nation")
    aliases = aliases.union(nations.select(F.lit("label"), F.concat(F.lit("Brand#"), (n + 1).cast("string")), F.lit("label"), F.concat(F.lit("Brand#"), (n % 7 + 1).cast("string")))).union(nations.select(F.lit("publisher"), n.cast("string"), F.lit("label"), F.lit("Brand#3")))
    bad = labels.where(F.col("label").isin("Brand#3", "Brand#4")).select(F.lit("label").alias("kind"), F.col("label").alias("id"), F.col("label").alias("name")).distinct()
    return links, told, genres, labels, aliases, bad.union(parts.where(k % 13 == 0).select(F.lit("songwriter"), text("p_partkey"), "p_name"))


@query(f"""WITH li AS ({_LINKS}), ar AS (SELECT artist_id, {_PLATFORMS} AS platforms, {_FLAG} AS flagged FROM b_artist), o AS (SELECT * FROM li JOIN ar USING (artist_id)),
  ge AS (SELECT artist_id, unnest([genre, {_GENRE}]) AS genre FROM b_artist), gc AS (SELECT kind, id, genre, count(*) AS n FROM o JOIN ge USING (artist_id) WHERE genre IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY count(*) DESC, genre) <= 3),
  su AS (SELECT kind, id, count(*) AS n, avg(platforms) AS mean, count(*) FILTER (flagged) AS k FROM o GROUP BY 1, 2), al AS ({_ALIASES}), ba AS ({_BAD}),
  sh AS (SELECT kind, id, label, count(*) AS m FROM o JOIN b_artist_label USING (artist_id) WHERE kind = 'songwriter' AND flagged GROUP BY 1, 2, 3 HAVING count(*) >= 2)
  SELECT kind, id, 'genre_clustering' AS clue, 'genres: ' || string_agg(genre || ' (' || n || ')', ', ' ORDER BY n DESC, genre) AS text, 'info' AS severity FROM gc GROUP BY 1, 2
  UNION ALL SELECT kind, id, 'platform_absence', 'platforms on average: ' || printf('%.1f', round(mean, 1)), 'warning' FROM su WHERE mean < 2.5
  UNION ALL SELECT kind, id, 'flagged_ratio', k || ' of ' || n || ' artists are flagged', 'critical' FROM su WHERE n >= 3 AND 100.0 * k / n >= 50
  UNION ALL SELECT kind, id, 'label_cooccurrence', m || ' of ' || k || ' flagged artists share ' || label, 'warning' FROM sh JOIN su USING (kind, id)
  UNION ALL SELECT DISTINCT al.kind, al.id, 'network_proximity', 'alias of ' || name || ' (' || al.other_kind || ')', 'critical' FROM al JOIN ba ON al.other_kind = ba.kind AND al.other_id = ba.id SEMI JOIN li ON li.kind = al.kind AND li.id = al.id WHERE al.kind IN ('label', 'songwriter')""")
def entity_context_clues(spark, d):
    """Clues of every entity, as composed for review."""
    return clues.context_clues(*sides(spark, d))
