"""Exports: parts and their order, digests, faults, and the way back."""

from __future__ import annotations

import glob
import json
import os

from conftest import SF

from lodestone.operators.evaluation import CATEGORIES
from lodestone.plans.exports import export
from lodestone.sources.exports import read_scans, summary, write_scans

RESULT = "scan_id long, artist_id long, name string, verdict string, score long, " + ", ".join(f"{c} long" for c in CATEGORIES)
FINDING = "scan_id long, artist_id long, finding string, source string, evidence_type string, strength string, detail string, tags array<string>"


def test_written_and_read(spark, tmp_path):
    results = [(1, a, f"n{a}", "Suspicious" if a % 2 else "Verified Artist", 90 - a % 5, *range(6)) for a in range(23)] + [(2, 5, None, None, None, *[None] * 6)]
    found = [(1, 3, "late", "B", "red_flag", "weak", None, ["t"]), (1, 3, "first", "B", "red_flag", "strong", "d", []), (1, 3, "good\n\"x\"", "A", "green_flag", "strong", None, ["a", "b"]), (1, 3, "so so", "A", "neutral", "weak", None, ["z"])]
    named = [(3, "x", "label", "on"), (3, "x", "label", "on"), (3, "a", "songwriter", "by"), (99, "none", "label", "on")]
    args = spark.createDataFrame(results, RESULT), spark.createDataFrame(found, FINDING), spark.createDataFrame(named, "artist_id long, name string, kind string, relationship string")
    told = write_scans(*args, f"{tmp_path}/x", 10).collect()
    assert sorted((r.scan_id, r.part, r.first, r.rows) for r in told) == [(1, 0, 1, 10), (1, 1, 11, 10), (1, 2, 21, 3), (2, 0, 1, 1)]
    order = [a for _, a in sorted((r[4], r[1]) for r in results if r[0] == 1)]
    lines = []
    for part in range(3):
        (file,) = glob.glob(f"{tmp_path}/x/scans/scan_id=1/part={part}/*.txt")
        lines += [json.loads(line) for line in open(file)]
    assert [x["artist_id"] for x in lines] == order and [x["place"] for x in lines] == list(range(1, 24))
    own = next(x for x in lines if x["artist_id"] == 3)
    assert [f["finding"] for f in own["red_flags"]] == ["first", "late"] and own["green_flags"][0]["tags"] == ["a", "b"] and len(own["neutral_notes"]) == 1
    assert own["entities"] == [{"name": "x", "type": "label", "relationship": "on"}, {"name": "a", "type": "songwriter", "relationship": "by"}] and own["radar"] == {"labels": list(CATEGORIES), "scores": list(range(6))}
    back, evidence, entities, faults = read_scans(spark, f"{tmp_path}/x")
    assert sorted(map(tuple, back.drop("tier").collect()), key=str) == sorted([(*r[:5], *[x or 0 for x in r[5:]]) for r in results], key=str)
    assert sorted(map(tuple, evidence.collect()), key=str) == sorted(found, key=str) and faults.count() == 0
    assert sorted(map(tuple, entities.collect())) == [(3, "a", "songwriter", "by"), (3, "x", "label", "on")]
    assert {(r.scan_id, r.verdict): r.n for r in summary(back).collect()} == {(1, "Suspicious"): 11, (1, "Verified Artist"): 12, (2, None): 1}
    # a changed and a missing part
    (file,) = glob.glob(f"{tmp_path}/x/scans/scan_id=1/part=1/*.txt")
    text = open(file).read()
    with open(file, "w") as out:
        out.write("no json\n" + text.split("\n", 1)[1])
    for crc in glob.glob(f"{tmp_path}/x/scans/scan_id=1/part=1/.*.crc"):
        os.remove(crc)
    for file in glob.glob(f"{tmp_path}/x/scans/scan_id=2/part=0/*.txt"):
        os.remove(file)
    back, *_, faults = read_scans(spark, f"{tmp_path}/x")
    assert back.count() == 22 and sorted((r.scan_id, r.part) for r in faults.collect()) == [(1, 1), (2, 0)]


def test_exports_of_queries_are_compressed(spark):
    """The lines repeat keys and names: what is written is far less than the manifest's bytes, and comes back whole."""
    path, told = export(spark, SF)
    files = glob.glob(f"{path}/scans/*/*/*.gz")
    assert len(files) == told.count()
    assert sum(map(os.path.getsize, files)) < told.agg({"bytes": "sum"}).first()[0] / 2
    assert read_scans(spark, path)[3].count() == 0


def test_bundles_hold_many_parts(spark, tmp_path, monkeypatch):
    """The same manifest and the same rows from a file for many parts as from one for each; a changed line is its part's fault alone."""
    from lodestone.sources import exports

    monkeypatch.setattr(exports, "BUNDLE_ROWS", 60)
    results = [(s, a, f"n{a}", "Suspicious", a % 7, *range(6)) for s in (1, 2) for a in range(95)]
    found = [(1, a, 'x "entities":[]', "B", "red_flag", "weak", None, ["t"]) for a in range(0, 95, 3)]
    named = [(a, n, "label", "on") for a in range(90) for n in ("x", "x", 'y"}', None)]
    args = spark.createDataFrame(results, RESULT), spark.createDataFrame(found, FINDING), spark.createDataFrame(named, "artist_id long, name string, kind string, relationship string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(write_scans(*args, f"{tmp_path}/one", 10)) == rows(write_scans(*args, f"{tmp_path}/many", 10, bundled=True))
    files = glob.glob(f"{tmp_path}/many/scans/*/*/*.txt")
    assert len(files) == 4 and len(glob.glob(f"{tmp_path}/one/scans/*/*/*.txt")) == 20
    places = [json.loads(line)["place"] for line in open(next(f for f in files if "scan_id=1/bundle=0" in f))]
    assert places == list(range(1, 61))
    one, many = read_scans(spark, f"{tmp_path}/one"), read_scans(spark, f"{tmp_path}/many", 10)
    for a, b in zip(one, many, strict=True):
        assert rows(a) == rows(b)
    assert [x.count() for x in many] == [190, 32, 270, 0]
    (file,) = [f for f in files if "scan_id=2/bundle=0" in f]
    lines = open(file).read().split("\n")
    with open(file, "w") as out:
        out.write("\n".join([*lines[:25], "no json", *lines[26:40], *lines[41:]]))
    for crc in glob.glob(f"{tmp_path}/many/scans/scan_id=2/bundle=0/.*.crc"):
        os.remove(crc)
    back, *_, faults = read_scans(spark, f"{tmp_path}/many", 10)
    assert back.count() == 188 and sorted((r.scan_id, r.part) for r in faults.collect()) == [(2, 2), (2, 4)]


def test_exports_read_again_are_bundled(spark):
    """No file for each hundred lines, and the results are computed once."""
    path, told = export(spark, SF, bundled=True)
    scans = told.select("scan_id").distinct().count()
    assert len(glob.glob(f"{path}/scans/*/*/*.gz")) == scans
    assert read_scans(spark, path, 100)[3].count() == 0
