"""Clues on a small graph, the store's replacement of them, and numbers over ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators.clues import context_clues, stored_clues
from lodestone.operators.order import numbered


def test_each_clue(spark):
    make = spark.createDataFrame
    links = make([("songwriter", "s", a) for a in (1, 2, 3)] + [("label", "l", 1), ("label", "l", 4), ("publisher", "p", 4), ("songwriter", "s", 1), ("label", None, 1)], "kind string, id string, artist_id long")
    artists = make([(1, 1, True), (2, 2, True), (3, 3, False), (4, 9, False)], "artist_id long, platforms int, flagged boolean")
    genres = make([(1, "pop"), (1, "folk"), (2, "pop"), (3, "jazz"), (3, "rock"), (4, None)], "artist_id long, genre string")
    labels = make([(1, "x"), (2, "x"), (3, "x"), (2, "y"), (2, "y")], "artist_id long, label string")
    aliases = make([("songwriter", "s", "label", "l"), ("publisher", "p", "label", "l"), ("label", "l", "songwriter", "s"), ("label", "nobody", "label", "l")], "kind string, id string, other_kind string, other_id string")
    bad = make([("label", "l", "Lister")], "kind string, id string, name string")
    got = {tuple(r) for r in context_clues(links, artists, genres, labels, aliases, bad).collect()}
    assert got == {
        ("songwriter", "s", "genre_clustering", "genres: pop (2), folk (1), jazz (1)", "info"), ("label", "l", "genre_clustering", "genres: folk (1), pop (1)", "info"),
        ("songwriter", "s", "platform_absence", "platforms on average: 2.0", "warning"), ("songwriter", "s", "flagged_ratio", "2 of 3 artists are flagged", "critical"),
        ("songwriter", "s", "label_cooccurrence", "2 of 2 flagged artists share x", "warning"), ("songwriter", "s", "network_proximity", "alias of Lister (label)", "critical"),
    }
    old = make([("songwriter", "s", "old", "t", "info"), ("label", "z", "old", "t", "info")], "kind string, id string, clue string, text string, severity string")
    computed = context_clues(links, artists, genres, labels, aliases, bad)
    after = {tuple(r) for r in stored_clues(old, computed, make([("songwriter", "s")], "kind string, id string")).collect()}
    assert after == {g for g in got if g[0] == "songwriter"} | {("label", "z", "old", "t", "info")}


def test_numbers_follow_the_order(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = {(r.a, r.b): r.place for r in numbered(df, [-F.col("a"), F.col("b")]).collect()}
    assert got == {r: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert numbered(df.limit(0), [F.col("a")]).count() == 0
