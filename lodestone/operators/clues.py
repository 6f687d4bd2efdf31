"""Context clues of entities: what the artists connected with one have in common, and bad entities that it is an alias of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.written import write_once

# fixed values
TOP_GENRES, FEW_PLATFORMS, LEAST_ARTISTS, FLAGGED_PERCENT, LEAST_SHARED = 3, 2.5, 3, 50, 2


def context_clues(links: DataFrame, artists: DataFrame, genres: DataFrame, labels: DataFrame, aliases: DataFrame, bad: DataFrame) -> DataFrame:
    """kind, id, clue, text, severity of every entity that has some.

    links: kind, id, artist_id; artists: artist_id, platforms, flagged; genres: artist_id, genre (each counts); labels: artist_id,
    label; aliases: kind, id, other_kind, other_id (forward); bad: kind, id, name of entities that are confirmed as bad.

    genre_clustering: the TOP_GENRES by count, ties by name (info). platform_absence: the artists' mean number of platforms is below
    FEW_PLATFORMS (warning). flagged_ratio: of LEAST_ARTISTS or more FLAGGED_PERCENT are flagged (critical). label_cooccurrence:
    labels that LEAST_SHARED flagged artists of a songwriter share (warning). network_proximity: labels and songwriters that are
    aliases of a bad one (critical). Nothing is collected by entity but the first genres.

    The links go once to their artists, which bring all their genres along; links and sums are written for their uses.
    """
    told = genres.dropna().groupBy("artist_id").agg(F.collect_list("genre").alias("genres"))
    own = write_once(links.dropna().distinct().join(artists.join(told, "artist_id", "left"), "artist_id"), "connected")
    clue = lambda rows, name, text, severity: rows.select("kind", "id", F.lit(name).alias("clue"), text.alias("text"), F.lit(severity).alias("severity"))
    counted = own.select("kind", "id", F.explode("genres").alias("genre")).groupBy("kind", "id", "genre").agg(F.count("*").alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("n"), "genre"))).where(F.col("place") <= TOP_GENRES)
    named = F.transform(F.array_sort(F.collect_list(F.struct("place", "genre", "n"))), lambda g: F.concat(g["genre"], F.lit(" ("), g["n"].cast("string"), F.lit(")")))
    first = first.groupBy("kind", "id").agg(F.array_join(named, ", ").alias("said"))
    sums = write_once(own.groupBy("kind", "id").agg(F.count("*").alias("n"), F.avg("platforms").alias("mean"), F.sum(F.col("flagged").cast("long")).alias("k")), "sums")
    share = F.col("k") * 100.0 / F.col("n")
    shared = own.where("kind = 'songwriter' AND flagged").select("kind", "id", "artist_id").join(labels.dropna().distinct(), "artist_id").groupBy("kind", "id", "label").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_SHARED)
    shared = shared.join(sums.select("kind", "id", "k"), ["kind", "id"])
    near = aliases.where(F.col("kind").isin("label", "songwriter")).join(bad.select(F.col("kind").alias("other_kind"), F.col("id").alias("other_id"), "name"), ["other_kind", "other_id"]).select("kind", "id", "name", "other_kind").distinct()
    near = near.join(sums.select("kind", "id"), ["kind", "id"], "left_semi")
    text = lambda c: F.col(c).cast("string")
    parts = [
        clue(first, "genre_clustering", F.concat(F.lit("genres: "), F.col("said")), "info"),
        clue(sums.where(F.col("mean") < FEW_PLATFORMS), "platform_absence", F.concat(F.lit("platforms on average: "), F.format_string("%.1f", F.round("mean", 1))), "warning"),
        clue(sums.where((F.col("n") >= LEAST_ARTISTS) & (share >= FLAGGED_PERCENT)), "flagged_ratio", F.concat(text("k"), F.lit(" of "), text("n"), F.lit(" artists are flagged")), "critical"),
        clue(shared, "label_cooccurrence", F.concat(text("m"), F.lit(" of "), text("k"), F.lit(" flagged artists share "), F.col("label")), "warning"),
        clue(near, "network_proximity", F.concat(F.lit("alias of "), F.col("name"), F.lit(" ("), F.col("other_kind"), F.lit(")")), "critical"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def stored_clues(old: DataFrame, computed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The store after entities (recomputed: kind, id) were computed anew: their clues replace all of their old ones, others keep theirs."""
    return old.join(recomputed.select("kind", "id").distinct(), ["kind", "id"], "left_anti").unionByName(computed.join(recomputed.select("kind", "id").distinct(), ["kind", "id"], "left_semi"))
