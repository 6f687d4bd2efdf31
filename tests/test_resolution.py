"""Classes of names against a loop."""

from __future__ import annotations

import random

from lodestone.operators.resolution import entities, hash_to_min, resolve


def least_reached(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def test_hash_to_min(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 7), (9, 8), (8, 9)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)] + [(5000, 5000 + k) for k in range(1, 80)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    assert {r.node: r.least for r in hash_to_min(df).collect()} == least_reached(edges)
    assert hash_to_min(df.limit(0)).count() == 0


def test_names_become_entities(spark):
    rows = [("Blue Pier Records", "deezer", 1), ("blue pier", "discogs", 1), ("BLUE PIER, Inc.", "discogs", 2), ("Old Quay", "deezer", 3), ("Quay Street Music", "album", 4), ("Records", "album", 5), ("Music", "deezer", 6), ("", "deezer", 7), (None, "deezer", 7), ("Old Quay", "deezer", 3), ("Old Quay", "album", None)]
    mentions = spark.createDataFrame(rows, "name string, source string, artist_id long")
    aliases = spark.createDataFrame([("quay street", "Old  Quay LLC"), ("never mentioned", "nor this"), ("", "Music")], "alias string, name string")
    got = {r.name: r.entity for r in resolve(mentions, aliases).collect()}
    assert got["Blue Pier Records"] == got["blue pier"] == got["BLUE PIER, Inc."] == "BLUE PIER, Inc."
    assert got["Old Quay"] == got["Quay Street Music"] == got["quay street"] == got["Old  Quay LLC"] and got["Records"] != got["Music"]
    listed = spark.createDataFrame([("QUAY STREET ",)], "name string")
    told = {r.display: (r.n_variants, r.variants, r.sources, r.n_artists, r.share, r.known) for r in entities(mentions, aliases, listed).collect()}
    assert told["BLUE PIER, Inc."] == (3, "BLUE PIER, Inc.|Blue Pier Records|blue pier", "deezer|discogs", 2, 0.3333, False)
    assert told["Old Quay"] == (2, "Old Quay|Quay Street Music", "album|deezer", 2, 0.3333, True) and len(told) == 4
    assert entities(mentions.limit(0), aliases.limit(0), listed).count() == 0
