"""Stateful streams with transformWithState: threshold crossings, heartbeats with timers, duplicates within a time to live.

State is kept by key in the state store and checkpointed with the stream, so that a restart goes on where it was and gives each
crossing once; no batch reads what earlier ones wrote. The session needs the RocksDB state store, see use_rocksdb().
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that transformWithState needs, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(at: datetime) -> int:
    """Microseconds since 1970 of a timestamp as Spark hands it over (in the worker's local time)."""
    return round(at.timestamp() * 1_000_000)


class Crossings(StatefulProcessor):
    """Of each entity the flagged artists so far, counted once each; a row when their number comes to the kind's threshold."""

    def __init__(self, least: dict[str, int]) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.artists = handle.getMapState("artists", "artist_id long", "seen boolean")
        self.state = handle.getValueState("state", "n long, crossed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        n, crossed = self.state.get() if self.state.exists() else (0, False)
        for row in rows:
            if row["artist_id"] is not None and not self.artists.containsKey((row["artist_id"],)):
                self.artists.updateValue((row["artist_id"],), (True,))
                n += 1
        now = key[0] in self.least and n >= self.least[key[0]]
        self.state.update((n, crossed or now))
        if now and not crossed:
            yield Row(kind=key[0], id=key[1], n=n)

    def close(self) -> None:
        pass


def crossings(flags: DataFrame, least: dict[str, int]) -> DataFrame:
    """A stream of (kind, id, artist_id) -> (kind, id, n): once for each entity, with the number of its flagged artists when a batch brings them to least[kind]."""
    return flags.groupBy("kind", "id").transformWithState(Crossings(least), "kind string, id string, n long", "Append", "None")


class Heartbeats(StatefulProcessor):
    """A session's first and last beat and their number; a row when a timer finds that none has come for gap."""

    def __init__(self, gap: timedelta) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "first long, last long, beats long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, last, beats, timer = self.state.get() if self.state.exists() else (None, None, 0, None)
        gap = self.gap // timedelta(microseconds=1)
        for at in sorted(_micros(row["ts"]) for row in rows):
            if last is not None and at - last > gap:  # a new session; the old one ends at once
                yield self._row(key, first, last, beats)
                first, last, beats = None, None, 0
            first, last, beats = (at if first is None else min(first, at)), (at if last is None else max(last, at)), beats + 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (last + gap) // 1000 + 1
        self.handle.registerTimer(timer)
        self.state.update((first, last, beats, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            first, last, beats, _ = self.state.get()
            self.state.clear()
            yield self._row(key, first, last, beats)

    @staticmethod
    def _row(key, first: int, last: int, beats: int) -> Row:
        at = lambda x: datetime.fromtimestamp(x / 1_000_000, timezone.utc)
        return Row(session=key[0], first=at(first), last=at(last), beats=beats)

    def close(self) -> None:
        pass


def stale_heartbeats(beats: DataFrame, gap: timedelta, lateness: str = "0 seconds") -> DataFrame:
    """A stream of (session, ts) -> (session, first, last, beats) of every session that has been silent for longer than gap, by event time. State goes with it."""
    rows = beats.select("session", "ts").withWatermark("ts", lateness)
    return rows.groupBy("session").transformWithState(Heartbeats(gap), "session string, first timestamp, last timestamp, beats long", "Append", "EventTime")


class FirstWithin(StatefulProcessor):
    """The last kept row's time by key; a row is kept that comes ttl or more after it. State expires by a timer."""

    def __init__(self, ttl: timedelta, columns: list[str]) -> None:
        self.ttl, self.columns = ttl, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", "at long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept, timer = self.state.get() if self.state.exists() else (None, None)
        ttl, before = self.ttl // timedelta(microseconds=1), kept
        for at, row in sorted(((_micros(row["ts"]), row) for row in rows), key=lambda x: x[0]):
            if kept is None or at - kept >= ttl:
                kept = at
                yield Row(**{c: row[c] for c in self.columns})
        if kept != before:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (kept + ttl) // 1000 + 1
            self.handle.registerTimer(timer)
            self.state.update((kept, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_within(rows: DataFrame, key: str, ttl: timedelta) -> DataFrame:
    """Of rows (with ts) that share a key, the first and each that comes ttl or more after the last kept one: the same for streams and static frames."""
    if rows.isStreaming:
        schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
        return rows.withWatermark("ts", "0 seconds").groupBy(key).transformWithState(FirstWithin(ttl, rows.columns), schema, "Append", "EventTime")
    micros = ttl // timedelta(microseconds=1)
    order = Window.partitionBy(key).orderBy("ts")
    before = F.lag("ts").over(order)
    # a row that comes ttl after the one before is kept in any case; between two such rows a fold over the times decides
    told = rows.withColumn("__group", F.sum(F.when(before.isNull() | (F.unix_micros("ts") - F.unix_micros(before) >= micros), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.array_sort(F.collect_list(F.unix_micros("ts")))
    times = told.groupBy(key, "__group").agg(own.alias("t"))
    step = lambda kept, at: F.when((F.size(kept) == 0) | (at - F.element_at(kept, -1) >= micros), F.concat(kept, F.array(at))).otherwise(kept)
    start = F.get("t", F.lit(0))
    times = times.select(F.col(key).alias("__key"), F.col("__group").alias("__of"), F.explode(F.aggregate(F.slice("t", F.lit(2), F.size("t")), F.array(start), step)).alias("__at"))
    met = told.join(times, (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__group") == F.col("__of")) & (F.unix_micros("ts") == F.col("__at")), "left_semi")
    one = F.row_number().over(Window.partitionBy(key, "ts").orderBy(*[c for c in rows.columns if c not in (key, "ts")] or [key]))
    return met.withColumn("__rn", one).where("__rn = 1").select(*rows.columns)
