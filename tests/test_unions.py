"""Unions of lists and buckets against sets, and how much of a graph without neighbourhoods is sent."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import containers as c
from lodestone.operators import written
from lodestone.operators.network import degrees


def batches(rows, names, types, size):
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=size)


def test_lists_and_buckets_unite_alike(monkeypatch):
    """Small and large sets of one cell, whole groups from cut batches, sorted together and one by one."""
    rng = random.Random(4)
    links = sorted({(w, s, s * c.WIDE + rng.randrange(c.WIDE)) for w in "abcdef" for s in (0, 2, -1) for _ in range(rng.choice([0, 1, 30, 90]))})
    links += [("dense", 0, k) for k in range(70_000)]
    by_via = {}
    for via, _, node in links:
        by_via.setdefault(via, set()).add(node)
    asked = {1000 + k: sorted(rng.sample(sorted(by_via), rng.randint(1, len(by_via)))) for k in range(40)}
    marked = set(range(0, 70_000, 7)) | {x for _, _, x in links[::5]}
    for dense, few, high in ((1 << 15, 1 << 10, 1 << 21), (50, 0, 8), (1 << 20, 60, 64)):
        for name, value in (("DENSE", dense), ("FEW", few), ("SORTED", high)):
            monkeypatch.setattr(c, name, value)
        made = [b for b in c._contained(iter(batches([x for x in links for _ in range(1 + (x[2] % 9 == 0))], ["via", "wide", "node"], [pa.string(), pa.int64(), pa.int64()], 37)))]
        bits = list(c._bits(iter(batches(sorted((x // c.WIDE, x) for x in marked), ["wide", "node"], [pa.int64(), pa.int64()], 1000))))
        rows = [(0, 0, 0, 0, *r.values(), None, None) for b in made for r in b.to_pylist()]
        rows += [(0, 0, 0, 0, None, r["bucket"], -1, r["data"], None, None) for b in bits for r in b.to_pylist()]
        rows += [(0, 0, 0, 1, None, None, None, None, node, vias) for node, vias in asked.items()]
        names = ["strip", "cut", "part", "side", "via", "bucket", "kind", "data", "node", "vias"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.string())]
        got = {r["node"]: (r["n"], r["marked"]) for b in c._united(iter(batches(rows, names, types, 11))) for r in b.to_pylist()}
        want = {node: set().union(*[by_via[v] for v in vias]) for node, vias in asked.items()}
        assert got == {node: (len(x), len(x & marked)) for node, x in want.items()}


def test_a_few_nodes_far_apart_are_one_container(spark):
    links = spark.range(200).selectExpr(f"id * {c.SPAN} div 16 AS node", "id % 5 AS via")
    assert c.set_containers(links).count() == 5


def test_what_is_sent_of_a_graph_without_neighbourhoods_is_bounded(spark, monkeypatch):
    """Each block asks for nearly all vias, however small blocks could be."""
    monkeypatch.setattr(c, "BLOCK_LINKS", 4)
    kept = {}

    def write(df, label):
        kept[label] = written.write_once(df, label)
        return kept[label]

    monkeypatch.setattr(c, "write_once", write)
    links = spark.range(600).selectExpr("id % 150 AS artist", "pmod(xxhash64(id), 20) AS w")
    rows = links.collect()
    got = {r.artist: r.degree for r in degrees(links.union(links), "artist", "w").collect()}
    by = {w: {r.artist for r in rows if r.w == w} for w in range(20)}
    assert got == {a: len(set().union(*[by[r.w] for r in rows if r.artist == a])) - 1 for a in {r.artist for r in rows}}
    assert kept["asked"].count() <= (c.CELLS + 1) * 20 and "links" not in kept
    assert kept["vias"].select(F.sum(F.size("vias"))).first()[0] == links.distinct().count()
