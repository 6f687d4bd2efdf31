"""The change log against a plain fold over its deltas: replays, deletes, snapshots, as-of reads, streams."""

from __future__ import annotations

import random

import pytest

from lodestone.operators.changelog import ChangeLog

POLICIES = {"name": "filled", "first_seen": "kept", "verdict": "given", "scans": "sum", "best": "most", "worst": "least"}
SCHEMA = "seq long, artist_id long, name string, first_seen long, verdict string, scans long, best long, worst long, gone boolean"


def fold(deltas, upto):
    state = {}
    for seq, key, name, first, verdict, scans, best, worst, gone in sorted(deltas, key=lambda d: d[0]):
        if key is None or seq > upto:
            continue
        if gone:
            state.pop(key, None)
            continue
        old = state.get(key, (None,) * 6)
        add = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        state[key] = (name or old[0], old[1] if old[1] is not None else first, verdict, add(lambda a, b: a + b, old[3], scans), add(max, old[4], best), add(min, old[5], worst))
    return state


def some_deltas(seed):
    rng = random.Random(seed)
    out = []
    for seq in range(1, 13):
        for key in rng.sample(range(15), rng.randint(1, 9)):
            some = lambda *of: rng.choice([None, *of])
            out.append((seq * 10, key, some("", f"n{seq}", f"m{seq}"), some(seq), some("good", "bad"), some(1, 2), some(seq % 5, seq), some(-seq, seq), rng.random() < 0.15))
    return [*out, (10, None, "x", 1, "bad", 1, 1, 1, False)]


def state(df):
    return {r.artist_id: tuple(r)[1:] for r in df.select("artist_id", *POLICIES).collect()}


def test_replay_as_of_and_snapshots(spark, tmp_path):
    deltas = some_deltas(1)
    df = spark.createDataFrame(deltas, SCHEMA)
    log = ChangeLog(spark, f"{tmp_path}/log", "artist_id", POLICIES)
    with pytest.raises(ValueError):
        log.as_of()
    assert log.append(df.where("seq <= 60")) == [10, 20, 30, 40, 50, 60]
    assert log.append(df.where("seq <= 60")) == []  # the same deltas again
    assert state(log.as_of()) == fold(deltas, 60)
    assert log.compact(40) == 40 and log.compact(45) == 40
    assert log.append(df) == [70, 80, 90, 100, 110, 120]  # a replay with new ones
    for n in (5, 10, 35, 40, 55, 60, 120, 500):
        assert state(log.as_of(n)) == fold(deltas, n), n
    assert log.compact() == 120 and state(log.as_of()) == fold(deltas, 120) and state(log.as_of(30)) == fold(deltas, 30)
    assert log.changes(40, 60).count() == sum(40 < d[0] <= 60 for d in deltas) and log.changes(500, 600).count() == 0
    fresh = ChangeLog(spark, f"{tmp_path}/log", "artist_id", POLICIES)  # another reader
    assert state(fresh.as_of(70)) == fold(deltas, 70)


def test_a_changed_delta_of_a_known_number_counts_nothing(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", "k", {"v": "sum"})
    one = spark.createDataFrame([(1, 7, 5)], "seq long, k long, v long")
    assert log.append(one) == [1] and log.append(one.selectExpr("seq", "k", "v + 1 AS v")) == []
    assert [tuple(r) for r in log.as_of().collect()] == [(7, 5)]
    with pytest.raises(ValueError):
        ChangeLog(spark, f"{tmp_path}/x", "k", {"v": "newest"})


def test_stream_batches_count_once(spark, tmp_path):
    """A stream that is started anew from an older checkpoint gives its batches again."""
    rows = [(k % 4, 1) for k in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "k long, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = ChangeLog(spark, f"{tmp_path}/log", "k", {"v": "sum"})
    for run in ("a", "b"):
        source = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream = source.writeStream.foreachBatch(log.apply).option("checkpointLocation", f"{tmp_path}/check-{run}").trigger(availableNow=True).start()
        stream.awaitTermination(120)
    assert {r.k: r.v for r in log.as_of().collect()} == {k: 10 for k in range(4)}
