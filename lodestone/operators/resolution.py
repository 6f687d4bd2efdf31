"""Entity resolution across sources: names that share a key or an alias are one entity, with its variants, sources and artists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import label_key, normalize_entity
from lodestone.operators.written import write_once


def hash_to_min(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, least): the least node that each reaches, itself included.

    Every node holds a cluster, as rows. In each round it sends the whole cluster to its least member, and the least member to
    all others, until nothing changes: some log of the longest path rounds. Nulls are left out. Each round's clusters are written.
    """
    pairs = edges.select("a", "b").dropna()
    both = pairs.union(pairs.select("b", "a")).union(pairs.select("a", F.col("a").alias("b"))).union(pairs.select("b", F.col("b").alias("a")))
    clusters, seen = write_once(both.toDF("node", "member").distinct(), "clusters"), None
    while True:
        # no group is collected: the least member comes back to the rows by a join that AQE can split
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        told = clusters.join(least.hint("rebalance"), "node")
        sent = told.select(F.col("least").alias("node"), "member").union(told.select(F.col("member").alias("node"), F.col("least").alias("member")))
        clusters = write_once(sent.distinct(), "clusters")
        mark = clusters.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        if mark == seen:
            return clusters.groupBy("node").agg(F.min("member").alias("least"))
        seen = mark


def resolve(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mentions: name, source; aliases: alias, name -> name, entity (the least name of its class).

    Names are linked that share the label key (without a company word at the end), or the normalized name (without any), or an
    alias, by the names themselves or by keys of these. Names without a key (nothing but company words and marks) stay alone.
    """
    names = mentions.select("name").union(aliases.select(F.col("alias").alias("name"))).union(aliases.select("name")).where("trim(name) <> ''").distinct()
    names = write_once(names, "names")
    keys = F.array(F.concat(F.lit("k:"), label_key(F.col("name"))), F.concat(F.lit("n:"), normalize_entity(F.col("name"))))
    keyed = names.select("name", F.explode(keys).alias("key")).where("length(key) > 2")
    # a key's names are linked to the least of them, not to each other
    firsts = keyed.groupBy("key").agg(F.min("name").alias("first"))
    edges = keyed.join(firsts, "key").where("name <> first").select(F.col("first").alias("a"), F.col("name").alias("b"))
    edges = edges.union(aliases.select(F.col("alias").alias("a"), F.col("name").alias("b"))).where("trim(a) <> '' AND trim(b) <> ''")
    least = hash_to_min(edges)
    return names.join(least.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("least", "name").alias("entity"))


def entities(mentions: DataFrame, aliases: DataFrame, listed: DataFrame) -> DataFrame:
    """mentions: name, source, artist_id; listed: name (a blocklist's).

    entity, display (the variant with the most artists; ties: the least), n_variants, variants, sources (sorted, joined by |),
    n_artists, share (of all artists, 4 places), known (whether a variant or an alias of it is listed). Classes that no mention
    has are left out.
    """
    own = write_once(mentions.where("trim(name) <> '' AND artist_id IS NOT NULL").select("name", "source", "artist_id"), "mentions")
    classes = write_once(resolve(own, aliases), "classes")
    known = classes.join(listed.select(F.lower(F.trim("name")).alias("low")).distinct(), F.lower(F.trim("name")) == F.col("low"), "left_semi").select("entity").distinct()
    rows = own.join(classes, "name")
    # distinct pairs first, so that no group holds an entity's artists
    variants = rows.select("entity", "name", "artist_id").distinct().groupBy("entity", "name").agg(F.count("*").alias("n"))
    display = variants.withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "name"))).where("rn = 1").select("entity", F.col("name").alias("display"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    spelt = variants.groupBy("entity").agg(F.count("*").alias("n_variants"), joined("name").alias("variants"))
    sources = rows.select("entity", "source").distinct().groupBy("entity").agg(joined("source").alias("sources"))
    artists = rows.select("entity", "artist_id").distinct().groupBy("entity").agg(F.count("*").alias("n_artists"))
    total = own.agg(F.countDistinct("artist_id").alias("total"))
    out = spelt.join(display, "entity").join(sources, "entity").join(artists, "entity").join(known.withColumn("known", F.lit(True)), "entity", "left").join(F.broadcast(total))  # one row
    return out.select("entity", "display", "n_variants", "variants", "sources", "n_artists", F.round(F.col("n_artists") / F.col("total"), 4).alias("share"), F.coalesce("known", F.lit(False)).alias("known"))
