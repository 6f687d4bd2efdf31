"""Stateful streams: restarts from the checkpoint, timers, time to live."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest

from lodestone.streaming.stateful import crossings, first_within, stale_heartbeats, use_rocksdb

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


@pytest.fixture
def stream(spark, tmp_path):
    """Writes files, and runs a stream over those that are there; each run goes on from the checkpoint."""
    use_rocksdb(spark)

    class Runner:
        files = 0

        def add(self, rows, schema):
            self.schema = schema
            self.files += 1
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{self.files:03}")

        def run(self, transform):
            source = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
            query = transform(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
            return spark.read.parquet(f"{tmp_path}/out").collect()

    return Runner()


def test_each_crossing_comes_once_whatever_the_restarts(stream):
    schema, least = "kind string, id string, artist_id long", {"songwriter": 3, "label": 2}
    transform = lambda rows: crossings(rows, least)
    stream.add([("songwriter", "a", 1), ("songwriter", "a", 1), ("label", "x", 1), ("songwriter", "b", None), ("other", "o", 1)], schema)
    stream.add([("songwriter", "a", 2), ("label", "x", 1)], schema)
    assert stream.run(transform) == []
    stream.add([("songwriter", "a", 2), ("songwriter", "a", 3), ("label", "x", 5)], schema)
    assert sorted(map(tuple, stream.run(transform))) == [("label", "x", 2), ("songwriter", "a", 3)]
    stream.add([("songwriter", "a", 4), ("label", "x", 6), ("label", "y", 1), ("label", "y", 2), ("label", "y", 3), ("other", "o", 2)], schema)
    assert sorted(map(tuple, stream.run(transform))) == [("label", "x", 2), ("label", "y", 3), ("songwriter", "a", 3)]
    assert len(stream.run(transform)) == 3


def test_silent_sessions_are_found_by_their_timers(stream):
    schema, at = "session string, ts timestamp", lambda s: START + timedelta(seconds=s)
    transform = lambda rows: stale_heartbeats(rows, timedelta(seconds=45))
    stream.add([("a", at(0)), ("a", at(30)), ("b", at(10))], schema)
    stream.add([("a", at(60)), ("c", at(70))], schema)
    assert {(r.session, r.beats) for r in stream.run(transform)} == {("b", 1)}  # the clock stands at 70
    stream.add([("c", at(110)), ("d", at(100)), ("d", at(150))], schema)
    stream.add([("z", at(1000))], schema)
    got = {(r.session, round((r.last - r.first).total_seconds()), r.beats) for r in stream.run(transform)}
    assert got == {("b", 0, 1), ("a", 60, 3), ("c", 40, 2), ("d", 0, 1), ("d", 0, 1)}


def kept(rows, ttl):
    """The rows that stay, by a loop."""
    last, out = {}, []
    for key, t, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or t - last[key] >= ttl:
            last[key] = t
            out.append((key, v))
    return sorted(out)


def test_first_within_is_the_same_for_tables_and_streams(spark, stream):
    import random

    rng, ttl = random.Random(3), timedelta(minutes=10)
    rows = [(rng.choice("abc"), START + timedelta(minutes=m, seconds=rng.randint(0, 50)), m) for m in range(0, 120, 2)]
    rows += [("d", START + timedelta(minutes=9 * k), 1000 + k) for k in range(9)]  # each within ttl of the one before
    schema = "k string, ts timestamp, v long"
    static = first_within(spark.createDataFrame(rows, schema), "k", ttl)
    want = kept(rows, ttl)
    assert sorted((r.k, r.v) for r in static.collect()) == want
    rows.sort(key=lambda r: r[1])
    for k in range(0, len(rows), 20):
        stream.add(rows[k : k + 20], schema)
    assert sorted((r.k, r.v) for r in stream.run(lambda source: first_within(source, "k", ttl))) == want
