"""Whole forms against plain loops: no ids, endings or links are left out."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from conftest import SF
from pyspark.sql import functions as F

from lodestone.functions.text import CAREER_WORDS
from lodestone.operators.network import degrees
from lodestone.operators.statistics import running
from lodestone.registry import ORACLES, QUERIES
from lodestone.sources import bindings as b


def linked(rows):
    """(node, via) pairs -> node -> the other nodes that share a via with it."""
    nodes = defaultdict(set)
    for node, via in rows:
        nodes[via].add(node)
    out = defaultdict(set)
    for node, via in rows:
        out[node] |= nodes[via] - {node}
    return {node: others for node, others in out.items() if others}


def test_degrees_by_bitmaps(spark):
    """Nodes in several bitmaps, repeated links, nulls, a node alone."""
    rows = [(k * 9001, f"v{k % 7}") for k in range(60)] + [(k * 9001, f"v{k % 3}") for k in range(60)] + [(5, "alone"), (0, "v0")]
    got = degrees(spark.createDataFrame([*rows, (None, "v0"), (7, None)], "a long, v string"), "a", "v").collect()
    assert dict(map(tuple, got)) == {node: len(others) for node, others in linked(rows).items()}


def test_degrees_of_marked_nodes(spark):
    rows = [(k, f"v{k % 4}") for k in range(30)] + [(k, f"w{k % 7}") for k in range(30)]
    marked = {k for k in range(30) if k % 3 == 0}
    got = degrees(spark.createDataFrame(rows, "a long, v string"), "a", "v", spark.createDataFrame([(k,) for k in marked], "a long")).collect()
    assert {r["a"]: (r["degree"], r["marked"]) for r in got} == {n: (len(o), len(o & marked)) for n, o in linked(rows).items()}


def test_networks_have_every_id(spark):
    labels = [tuple(r) for r in b.artist_labels(spark, SF).select("artist_id", "label").collect()]
    got = dict(map(tuple, QUERIES["label_network"](spark, SF).select("artist_id", "degree").collect()))
    assert got == {node: len(others) for node, others in linked(labels).items()} and max(got) >= 100
    links = {(r["artist_id"], r["songwriter_id"]) for r in b.credits(spark, SF).collect()}
    members = QUERIES["entity_network"](spark, SF).collect()
    assert {(r["artist_id"], r["songwriter_id"]) for r in members} == links and len(members) == len(links)
    sizes = Counter(w for _, w in links)
    assert {tuple(r) for r in QUERIES["cowriter_network"](spark, SF).collect()} == {(a, w, sizes[w] - 1) for a, w in links if sizes[w] > 1}
    scans = defaultdict(set)
    for r in b.scan_results(spark, SF).collect():
        scans[r["artist_id"]].add(r["scan_id"])
    own = [(r["artist_id"], r["scan_id"]) for r in QUERIES["artist_scan_history"](spark, SF).collect()]
    assert sorted(own) == sorted((a, s) for a, all_ in scans.items() for s in sorted(all_)[-5:]) and max(own)[0] >= 20


def test_bio_signals_search_whole_texts(spark, tmp_path):
    """A career word and a year after character 300, and the given documents by a plain loop."""
    long = spark.createDataFrame([(2, "x " * 400 + CAREER_WORDS[0].upper() + " in 1977 and 1066")], "doc_id long, text string")
    long.write.parquet(str(tmp_path / "documents.parquet"))
    assert tuple(QUERIES["bio_signals_full"](spark, str(tmp_path)).first()) == (2, 1, "1977")
    ends = (" Born 1984, toured in 1999 and 2150.", " She studied at the University.", "")
    expected = []
    for r in b.table(spark, SF, "documents").collect():
        bio = r["text"] + ends[r["doc_id"] % 3]
        years = [y for y in re.findall(r"\b((?:19|20)[0-9]{2})\b", bio, re.ASCII) if 1900 <= int(y) <= 2028]
        expected.append((r["doc_id"], sum(w in bio.lower() for w in CAREER_WORDS), ",".join(years)))
    assert sorted(map(tuple, QUERIES["bio_signals_full"](spark, SF).collect())) == sorted(expected)


def test_links_are_all_of_lineitem(spark):
    lines = b.table(spark, SF, "lineitem").join(b.table(spark, SF, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    expected = {(r[0], r[1], r[2]) for r in lines.select("o_custkey", "l_suppkey", "l_returnflag").collect()}
    assert {tuple(r) for r in b.credits(spark, SF).collect()} == expected
    assert not any("l_quantity >=" in sql and "WHERE" in sql.split("l_quantity >=")[0][-8:] for sql in ORACLES.values())


def test_running_totals_by_slices(spark):
    """The same totals as one window over all rows, and the same statistics however values are sliced."""
    rows = [(f"g{k % 3}", k * 7 % 50 // 10, k * 7 % 50, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, slice int, v int, x long")
    got = {(r["g"], r["v"], r["x"]): r["total"] for r in running(df, ["g"], "slice", ["v", "x"], {"total": F.col("x")}).collect()}
    total, want = defaultdict(int), {}
    for g, _, v, x in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        total[g] += x
        want[g, v, x] = total[g]
    assert got == want


def test_breaker_tells_all_runs_of_failures(spark, tmp_path):
    """Short runs and those that open the breaker, of every API."""
    calls = "f" * 3 + "." + "f" * 15 + ".." + "f" * 14 + "." + "f"
    rows = [(k, f"2024-01-{1 + k // 9:02}", api, '{"k": 10}' if c == "f" else '{"k": 3}') for api, first in (("view", 0), ("click", 1)) for k, c in ((2 * j + first, c) for j, c in enumerate(calls))]
    rows += [(1000 + k, "2024-03-01", "error", '{"k": 3}') for k in range(2)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, props string").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "event_type", "0.5D AS value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["circuit_breaker"](spark, str(tmp_path)).select("api_name", "first_call", "length", "opens").collect())
    runs = [(1, 3, False), (5, 15, True), (22, 14, False), (37, 1, False)]
    assert got == sorted([("error", 1, 2, False), *[(api, *r) for api in ("view", "click") for r in runs]])
