"""Adaptive containers and the degrees that they give, against sets and pairs."""

from __future__ import annotations

import random

import numpy as np
from conftest import SF

from lodestone.operators import containers as c
from lodestone.operators.network import degrees
from lodestone.sources import bindings as b


def some_sets():
    rng = np.random.default_rng(3)
    yield c.ARRAY, np.sort(rng.choice(c.SPAN, 500, replace=False))
    yield c.BITMAP, np.sort(rng.choice(c.SPAN, 30_000, replace=False))
    yield c.RUNS, np.arange(c.SPAN)
    yield c.RUNS, np.concatenate((np.arange(5, 9000), np.arange(60_000, c.SPAN)))
    yield c.ARRAY, np.array([7])
    yield c.ARRAY, np.array([0, c.SPAN - 1])


def members(words):
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def test_each_kind_gives_its_members_back():
    for kind, offsets in some_sets():
        got, data = c.encode(offsets)
        assert got == kind and len(data) <= min(2 * len(offsets), c.SPAN // 8)
        assert (members(c.bitmap(got, data)) == offsets).all()


def test_union_sizes_of_all_kinds():
    sets = [s for _, s in some_sets()]
    made = [c.encode(s) for s in sets]
    marked = np.arange(0, c.SPAN, 3)
    bits = c.bitmap(*c.encode(marked))
    rng = random.Random(1)
    asked = [np.array(sorted(rng.sample(range(len(sets)), rng.randint(1, len(sets))))) for _ in range(30)]
    asked += [np.array([0, 4, 5])]
    n, m = c.union_sizes(made, asked, bits)
    for own, size, hits in zip(asked, n, m, strict=True):
        union = set().union(*[sets[k].tolist() for k in own])
        assert (size, hits) == (len(union), len(union & set(marked.tolist())))
    assert c.union_sizes(made, asked)[0] == n


def loop(links, marked=frozenset()):
    by_via, by_node = {}, {}
    for node, via in links:
        if node is not None and via is not None:
            by_via.setdefault(via, set()).add(node)
            by_node.setdefault(node, set()).add(via)
    out = {}
    for node, vias in by_node.items():
        others = set().union(*[by_via[v] for v in vias]) - {node}
        if others:
            out[node] = (len(others), len(others & marked))
    return out


def test_degrees_over_several_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_LINKS", 400)
    rng = random.Random(2)
    nodes = [rng.choice([0, 1, 5, 1 << 33, -3]) * c.SPAN + rng.randrange(50) for _ in range(150)]
    links = [(n, rng.choice("abcdefgh") * rng.randint(1, 4)) for n in nodes for _ in range(rng.randint(0, 6))]
    links += [(n, "everywhere") for n in nodes[:40]] + [(None, "a"), (3, None), (nodes[0], "a"), (nodes[0], "a"), (99, "alone")]
    marked = set(nodes[::3]) | {12345}
    df = spark.createDataFrame(links, "artist long, label string")
    flags = spark.createDataFrame([(n,) for n in [*marked, nodes[0], None]], "artist long")
    got = {r.artist: (r.degree, r.marked) for r in degrees(df, "artist", "label", flags).collect()}
    assert got == loop(links, marked)
    assert {r.artist: r.degree for r in degrees(df, "artist", "label").collect()} == {k: n for k, (n, _) in got.items()}
    assert degrees(df.limit(0), "artist", "label", flags).count() == 0


def test_bytes_sent_stay_below_pairs(spark):
    """What union_degrees sends of the catalogue's links against the pairs of ids that they stand for."""
    links = b.credits(spark, SF).select(b.F.col("artist_id").alias("node"), b.F.col("songwriter_id").alias("via")).distinct()
    sizes = [r[0] for r in links.groupBy("via").count().select("count").collect()]
    sent = sum(len(r.data) for r in c.set_containers(links).collect()) + 16 * sum(sizes)
    assert sent < 2 * 16 * sum(sizes) < sum(16 * n * n for n in sizes)


def test_equal_sets_are_united_once_and_blocks_are_stretches(spark, monkeypatch):
    """What is sent grows with the nodes, not with nodes times buckets or blocks times vias: copies with the same vias, and groups apart."""
    from lodestone.operators import written

    monkeypatch.setattr(c, "BLOCK_LINKS", 40)
    kept = {}

    def write(df, label):
        kept[label] = written.write_once(df, label)
        return kept[label]

    monkeypatch.setattr(c, "write_once", write)
    same = [(k * c.SPAN + j, f"v{i}") for k in range(6) for j in range(5) for i in range(5) if i != j]
    assert {r.artist: r.degree for r in degrees(spark.createDataFrame(same, "artist long, label string"), "artist", "label").collect()} == {n: d for n, (d, _) in loop(same).items()}
    assert kept["firsts"].count() == 5
    apart = [(k * 10 + j, f"v{k}-{i}") for k in range(40) for j in range(10) for i in range(4) if (j >> i) & 1 == 0]
    assert {r.artist: r.degree for r in degrees(spark.createDataFrame(apart, "artist long, label string"), "artist", "label").collect()} == {n: d for n, (d, _) in loop(apart).items()}
    assert kept["asked"].count() <= 3 * 160  # a via meets a few blocks, not all
    assert kept["parts"].count() >= 10


def test_parts_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(c, "PART_BYTES", 150)
    rng = random.Random(5)
    links = list({(rng.randrange(8) * c.SPAN + rng.randrange(30), rng.randrange(12)) for _ in range(400)})
    marked = {n for n, _ in links[::4]}
    got = {r.artist: (r.degree, r.marked) for r in degrees(spark.createDataFrame(links, "artist long, w int"), "artist", "w", spark.createDataFrame([(n,) for n in marked], "artist long")).collect()}
    assert got == loop(links, marked)
