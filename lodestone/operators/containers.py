"""Sets of whole numbers as adaptive containers, and the sizes of their unions.

Numbers are cut into stretches of WIDE. A set's members in a stretch are one LIST (offsets of 32 bits) while they are few; else they
are cut into buckets of SPAN numbers, each one container of the smallest of three kinds: ARRAY (sorted offsets of 16 bits) while
sparse, BITMAP (SPAN bits) when dense, RUNS (first offset and length less one) when full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.written import write_once

BITS = 16
SPAN = 1 << BITS
WIDE_BITS = 20
WIDE = 1 << WIDE_BITS
ARRAY, BITMAP, RUNS, LIST = 0, 1, 2, 3
#: Members in a stretch from which on a set's are cut into buckets: a LIST would be no smaller than WIDE bits.
DENSE = WIDE // 32
#: Links of a block of nodes at least, and blocks times stretches at most: each block gets the containers of its vias anew.
BLOCK_LINKS = 1 << 19
CELLS = 24
#: Bytes of containers that a task gets: a block whose vias have more is done in parts, by stretches.
PART_BYTES = 1 << 26
#: Containers that union_sizes() keeps as bitmaps.
KEPT = 1 << 12
#: A node with at most so many members of its vias in a stretch is sorted together with others; numbers sorted at once.
FEW, SORTED = 1 << 12, 1 << 16
#: Nodes with the same vias as another that are broadcast at most.
TWINS = 1 << 20


def encode(offsets: np.ndarray) -> tuple[int, bytes]:
    """Kind and bytes of sorted distinct offsets below SPAN."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(offsets) != 1)))
    sizes = {ARRAY: 2 * len(offsets), BITMAP: SPAN // 8, RUNS: 4 * len(first)}
    kind = min(sizes, key=lambda k: (sizes[k], k))
    if kind == ARRAY:
        return kind, offsets.astype("<u2").tobytes()
    if kind == RUNS:
        last = np.append(first[1:], len(offsets)) - 1
        return kind, np.column_stack((offsets[first], offsets[last] - offsets[first])).astype("<u2").tobytes()
    bits = np.zeros(SPAN, bool)
    bits[offsets] = True
    return kind, np.packbits(bits, bitorder="little").tobytes()


def bitmap(kind: int, data: bytes) -> np.ndarray:
    """A container as SPAN / 64 words of 64 bits."""
    if kind == BITMAP:
        return np.frombuffer(data, "<u8")
    bits = np.zeros(SPAN + 1, np.int8)
    if kind == ARRAY:
        bits[np.frombuffer(data, "<u2")] = 1
    else:
        runs = np.frombuffer(data, "<u2").reshape(-1, 2).astype(np.int64)
        np.add.at(bits, runs[:, 0], 1)
        np.add.at(bits, runs[:, 0] + runs[:, 1] + 1, -1)
        bits = np.cumsum(bits)
    return np.packbits(bits[:SPAN].astype(bool), bitorder="little").view("<u8")


def union_sizes(containers: list[tuple[int, bytes]], sets: list[np.ndarray], marked: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """For each of sets (places in containers, ascending) the size of the union, and how many of its members are marked (a bitmap).

    Arrays alone are merged as arrays while they are few; else bitmaps are united. A container of all offsets needs no union.
    Equal sets, as nodes of one label have, are united once.
    """
    dense: dict[int, np.ndarray] = {}
    full = {k for k, (kind, data) in enumerate(containers) if kind == RUNS and data == b"\0\0\xff\xff"}

    def words(k: int) -> np.ndarray:
        if k in dense:
            return dense[k]
        made = bitmap(*containers[k])
        if len(dense) < KEPT:
            dense[k] = made
        return made

    every = np.full(SPAN // 64, 0xFFFFFFFFFFFFFFFF, np.uint64)
    known: dict[bytes, tuple[int, int]] = {}
    for own in sets:
        key = own.tobytes()
        if key in known:
            continue
        some = own.tolist()
        if full and not full.isdisjoint(some):
            united = every
        elif all(containers[k][0] == ARRAY for k in some) and sum(len(containers[k][1]) for k in some) < SPAN // 16:
            members = np.unique(np.frombuffer(b"".join([containers[k][1] for k in some]), "<u2"))
            hits = int((marked[members >> 6] >> (members & 63).astype(np.uint64) & np.uint64(1)).sum()) if marked is not None else 0
            known[key] = len(members), hits
            continue
        else:
            united = words(some[0]).copy()
            for k in some[1:]:
                np.bitwise_or(united, words(k), out=united)
        known[key] = int(np.bitwise_count(united).sum()), int(np.bitwise_count(united & marked).sum()) if marked is not None else 0
    found = [known[own.tobytes()] for own in sets]
    return [n for n, _ in found], [m for _, m in found]


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    return np.concatenate(([True], pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)))


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of adjacent rows with equal keys."""
    pending: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        if pending and any(pending[-1][k][-1] != batch[k][0] for k in keys):
            yield joined()
            pending = []
        start = int(np.flatnonzero(np.logical_or.reduce([_changed(batch[k]) for k in keys]))[-1])  # of the last group
        if start:
            pending.append(batch.slice(0, start))
            yield joined()
            pending = []
        pending.append(batch.slice(start))
    if pending:
        yield joined()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, vias of rows (node, via) in order; repeated rows count once."""
    for batch in _whole(batches, ["node"]):
        first = _changed(batch["node"])
        kept = first | _changed(batch["via"])
        starts = np.append(np.flatnonzero(first[kept]), kept.sum())
        vias = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), batch["via"].filter(pa.array(kept)))
        yield pa.RecordBatch.from_arrays([batch["node"].filter(pa.array(first)), vias], names=["node", "vias"])


def _contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """via, bucket (of a LIST: its stretch's first), kind, data of rows (via, wide, node) in order; repeated rows count once."""
    names = ["via", "bucket", "kind", "data"]
    for batch in _whole(batches, ["via", "wide"]):
        first = _changed(batch["via"]) | _changed(batch["wide"])
        kept = first | _changed(batch["node"])
        offsets = (batch["node"].to_numpy()[kept] & (WIDE - 1)).astype("<u4")
        starts = np.append(np.flatnonzero(first[kept]), kept.sum())
        sizes, via, wide = np.diff(starts), batch["via"].filter(pa.array(first)), batch["wide"].to_numpy()[first]
        few = sizes < DENSE
        ends = np.concatenate(([0], np.cumsum(4 * sizes[few]))).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), int(few.sum()), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(offsets[np.repeat(few, sizes)]))])
        yield pa.RecordBatch.from_arrays([via.filter(pa.array(few)), pa.array(wide[few] << (WIDE_BITS - BITS)), pa.array(np.full(len(data), LIST, np.int32)), data], names=names)
        for k in np.flatnonzero(~few):
            own = offsets[starts[k] : starts[k + 1]]
            at = own >> BITS
            buckets = np.unique(at)
            made = [encode((own[at == x] & (SPAN - 1)).astype(np.int64)) for x in buckets]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([via.slice(k, 1)] * len(made)), pa.array((wide[k] << (WIDE_BITS - BITS)) + buckets.astype(np.int64)), pa.array([kind for kind, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=names)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket (its stretch's first), data (WIDE bits) of rows (wide, node) in order."""
    for batch in _whole(batches, ["wide"]):
        wide, node = batch["wide"].to_numpy(), batch["node"].to_numpy()
        for x in np.unique(wide):
            bits = np.zeros(WIDE, bool)
            bits[node[wide == x] & (WIDE - 1)] = True
            yield pa.RecordBatch.from_arrays([pa.array([x << (WIDE_BITS - BITS)]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "data"])


class _Places:
    """The place of each of some distinct values, -1 for others."""

    def __init__(self, values: pa.Array) -> None:
        self.table = self.index = None
        if pa.types.is_integer(values.type) and len(values):
            values = values.to_numpy().astype(np.int64)
            self.low, high = int(values.min()), int(values.max())
            if high - self.low < 8 * len(values) + SPAN:
                self.table = np.full(high - self.low + 2, -1, np.int32)
                self.table[values - self.low] = np.arange(len(values))
                return
        self.index = pd.Index(values if isinstance(values, np.ndarray) else values.to_numpy(zero_copy_only=False))

    def __getitem__(self, values: pa.Array) -> np.ndarray:
        if self.table is None:
            return self.index.get_indexer(pd.Index(values.to_numpy(zero_copy_only=False)))
        at = values.to_numpy().astype(np.int64) - self.low
        return self.table[np.where((at >= 0) & (at < len(self.table)), at, len(self.table) - 1)]


class _Cell:
    """The containers of one part of the stretches, for all vias of a block."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        self.marked, self.dense = {}, {}
        of, wide, sizes, members = [], [], [], []
        own = [r.filter(pc.greater_equal(r["kind"], 0)) for r in rows]
        names = pc.unique(pa.chunked_array([r["via"] for r in own], own[0]["via"].type)) if own else pa.array([], pa.int64())
        self.places, self.n = _Places(names), len(names)
        for row, r in zip(rows, own, strict=True):
            for bucket, data in zip(*(row.filter(pc.less(row["kind"], 0))[c].to_pylist() for c in ("bucket", "data")), strict=True):
                self.marked[bucket >> (WIDE_BITS - BITS)] = np.frombuffer(data, "u1")
            lists, others = r.filter(pc.equal(r["kind"], LIST)), r.filter(pc.not_equal(r["kind"], LIST))
            if lists.num_rows:
                ends = np.frombuffer(lists["data"].buffers()[1], np.int32)[lists["data"].offset :][: lists.num_rows + 1]
                members.append(np.frombuffer(lists["data"].buffers()[2], "u1")[ends[0] : ends[-1]].view("<u4").astype(np.int32))
                sizes.append(np.diff(ends) // 4)
                of.append(self.places[lists["via"]])
                wide.append(lists["bucket"].to_numpy() >> (WIDE_BITS - BITS))
            for place, bucket, kind, data in zip(self.places[others["via"]].tolist(), others["bucket"].to_pylist(), others["kind"].to_pylist(), others["data"].to_pylist(), strict=True):
                self.dense.setdefault(bucket >> (WIDE_BITS - BITS), {}).setdefault(bucket & (WIDE // SPAN - 1), []).append((place, kind, data))
        told = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.members, self.sizes = told(members, np.int32), told(sizes, np.int64).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        of, wide = told(of, np.int64), told(wide, np.int64)
        self.rows = {}
        for x in {*np.unique(wide).tolist(), *self.dense}:
            row, thick = np.full(self.n + 1, -1, np.int32), np.zeros(self.n + 1, bool)  # the last place is for vias without containers here
            at = np.flatnonzero(wide == x)
            row[of[at]] = at
            thick[[place for own in self.dense.get(x, {}).values() for place, *_ in own]] = True
            self.rows[x] = row, thick
        self.high = int(self.members.max()) + 1 if len(self.members) else 0
        self.flags, self.both, self.stamp, self.count = np.zeros(self.high, bool), np.zeros(self.high, bool), np.zeros(self.high, np.int32), np.arange(self.high // 16 + 1, dtype=np.int32)

    def union(self, nodes: pa.RecordBatch) -> pa.RecordBatch:
        """node, n, marked: the size of the union of each node's vias here, and how many of it are marked."""
        vias = nodes["vias"]
        node = np.repeat(np.arange(len(vias)), vias.value_lengths().to_numpy())
        via = self.places[vias.flatten()]
        n, m = np.zeros(len(vias), np.int64), np.zeros(len(vias), np.int64)
        for x, (row, thick) in self.rows.items():
            marked = self.marked.get(x)
            bits = None if marked is None else np.unpackbits(marked, bitorder="little").view(bool)
            heavy = np.zeros(len(vias), bool)
            if x in self.dense:
                heavy[node[thick[via]]] = True
                self._by_buckets(x, node, via, heavy, marked, n, m)
            at = row[via]
            some = np.flatnonzero((at >= 0) & ~heavy[node])
            self._by_lists(node[some], at[some], bits, n, m)
        return pa.RecordBatch.from_arrays([nodes["node"], pa.array(n), pa.array(m)], names=["node", "n", "marked"])

    def _by_lists(self, node: np.ndarray, at: np.ndarray, bits: np.ndarray | None, n: np.ndarray, m: np.ndarray) -> None:
        """Adds the unions of lists alone; rows are ordered by node."""
        if not len(node):
            return
        starts, sizes = self.starts[at], self.sizes[at]
        first = np.flatnonzero(np.concatenate(([True], np.diff(node) != 0)))
        totals, ends = np.add.reduceat(sizes, first), np.append(first[1:], len(node))
        for k in np.flatnonzero(totals > FEW).tolist():
            a, e = first[k], ends[k]
            own = np.concatenate([self.members[s:t] for s, t in zip(starts[a:e].tolist(), (starts[a:e] + sizes[a:e]).tolist(), strict=True)]).astype(np.intp)
            if 16 * len(own) > self.high:  # cheaper than to look each member up again
                self.flags[own] = True
                n[node[a]] += np.count_nonzero(self.flags)
                if bits is not None:
                    m[node[a]] += np.count_nonzero(np.logical_and(self.flags, bits[: self.high], out=self.both))
                self.flags.fill(False)
                continue
            count = self.count[: len(own)]
            self.stamp[own] = count
            last = self.stamp.take(own) == count  # of each member one place alone
            n[node[a]] += np.count_nonzero(last)
            if bits is not None:
                m[node[a]] += np.count_nonzero(last & bits.take(own))
        few = np.flatnonzero(np.repeat(totals <= FEW, ends - first))
        if not len(few):
            return
        upto = np.cumsum(sizes[few])
        for rows in np.split(few, np.flatnonzero(np.diff(upto // SORTED) * (np.diff(node[few]) != 0)) + 1):
            size = sizes[rows]
            flat = np.arange(size.sum()) + np.repeat(starts[rows] - np.cumsum(size) + size, size)
            told = np.repeat(node[rows], size) << WIDE_BITS | self.members[flat]
            told.sort()
            told = told[np.concatenate((np.ones(min(1, len(told)), bool), np.diff(told) != 0))]
            n += np.bincount(told >> WIDE_BITS, minlength=len(n))
            if bits is not None:
                m += np.bincount(told[bits[told & (WIDE - 1)]] >> WIDE_BITS, minlength=len(n))

    def _by_buckets(self, x: int, node: np.ndarray, via: np.ndarray, heavy: np.ndarray, marked: np.ndarray | None, n: np.ndarray, m: np.ndarray) -> None:
        """Adds the unions of nodes with a via that is cut into buckets: their lists are cut too."""
        links = np.flatnonzero(heavy[node])
        node, via = node[links], via[links]
        row, _ = self.rows[x]
        lists = np.unique(row[via])
        made: dict[int, list] = {k: list(own) for k, own in self.dense[x].items()}
        owner = dict(zip(row[via].tolist(), via.tolist(), strict=True))
        for k in lists[lists >= 0].tolist():
            own = self.members[self.starts[k] : self.starts[k] + self.sizes[k]]
            cuts = np.searchsorted(own, np.arange(0, WIDE + 1, SPAN))
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                made.setdefault(bucket, []).append((owner[k], ARRAY, (own[cuts[bucket] : cuts[bucket + 1]] & (SPAN - 1)).astype("<u2").tobytes()))
        for bucket, own in made.items():
            place = np.full(self.n + 1, -1, np.int64)
            place[[p for p, *_ in own]] = np.arange(len(own))
            at = place[via]
            some = np.flatnonzero(at >= 0)
            some = some[np.lexsort((at[some], node[some]))]
            if not len(some):
                continue
            first = np.flatnonzero(np.concatenate(([True], np.diff(node[some]) != 0)))
            words = None if marked is None else marked[bucket * SPAN // 8 : (bucket + 1) * SPAN // 8].view("<u8")
            sizes, hits = union_sizes([(kind, data) for _, kind, data in own], np.split(at[some], first[1:]), words)
            n[node[some][first]] += sizes
            m[node[some][first]] += hits


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, marked of each node in each part: rows are ordered by cell (strip, cut, part), a cell's containers before its nodes."""
    cell, rows, made = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy() for c in ("strip", "cut", "part", "side")]
        starts = np.flatnonzero(np.logical_or.reduce([_changed(batch[c]) for c in ("strip", "cut", "part", "side")]))
        for a, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            *own, side = (int(k[a]) for k in keys)
            if own != cell:
                cell, rows, made = own, [], None
            piece = batch.slice(a, e - a)
            if side == 0:
                rows.append(piece.select(["via", "bucket", "kind", "data"]))
                continue
            if made is None:
                made, rows = _Cell(rows), []
            yield made.union(piece)


def _ordered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*order)


def node_sets(links: DataFrame) -> DataFrame:
    """node, vias (distinct, in order) of links (node, via) without nulls, by one shuffle."""
    kind = dict(links.dtypes)["via"]
    return _ordered(links.select("node", "via"), ["node"], ["node", "via"]).mapInArrow(_sets, f"node long, vias array<{kind}>")


def set_containers(links: DataFrame) -> DataFrame:
    """via, bucket, kind, data: the nodes of each via. links: (node, via) without nulls; nodes are whole numbers."""
    kind = dict(links.dtypes)["via"]
    rows = links.select("via", F.shiftright("node", WIDE_BITS).alias("wide"), "node")
    return _ordered(rows, ["via", "wide"], ["via", "wide", "node"]).mapInArrow(_contained, f"via {kind}, bucket long, kind int, data binary")


def union_degrees(links: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """node, n (size of the union of its vias' sets, itself included), m (how many of these are in marked, a table of distinct nodes).

    links: rows (node, via) without nulls. Nodes with the same vias have the same union, which is made once, for the first of them.
    These are dealt into blocks of at least BLOCK_LINKS links, by stretches of their numbers (and by hash, where a stretch has
    more). A block gets each container of its vias once, in parts of about PART_BYTES, which a task holds while the block's nodes
    stream by. Blocks times stretches are CELLS at most, as both are sent more than once: a block's containers for each block, a
    node's vias for each part.
    """
    kind = dict(links.dtypes)["via"]
    alike = write_once(node_sets(links).withColumn("key", F.unhex(F.sha2(F.to_json("vias"), 256))), "vias")
    firsts = write_once(alike.groupBy("key").agg(F.min("node").alias("first")), "firsts")
    twins = alike.count() - firsts.count()
    nodes = alike.select("node", "vias")
    if twins:
        later = alike.select("key", "node").join(firsts, "key").where("node <> first").select("node")
        nodes = nodes.join(F.broadcast(later) if twins <= TWINS else later, "node", "left_anti")
    containers = write_once(set_containers(alike.select("node", F.explode("vias").alias("via"))), "containers")
    total, low, high = nodes.agg(F.sum(F.size("vias")), F.min("node"), F.max("node")).first()
    stretches = containers.select(F.shiftright("bucket", WIDE_BITS - BITS)).distinct().count()
    size = max(BLOCK_LINKS, -(-(total or 0) // max(1, CELLS // max(1, stretches))))
    width = max(1, (high - low + 1) * size // total) if total else 1
    strips = nodes.withColumn("strip", F.expr(f"(node - {low or 0}L) div {width}L"))
    cuts = strips.groupBy("strip").agg(F.ceil(F.sum(F.size("vias")) / F.lit(size)).alias("cuts"))  # a row a stretch
    dealt = strips.join(F.broadcast(cuts), "strip").select("node", "vias", "strip", F.pmod(F.xxhash64("node"), F.col("cuts")).alias("cut"))
    block = ["strip", "cut"]
    asked = write_once(dealt.select(*block, F.explode("vias").alias("via")).distinct(), "asked")
    bytes_ = containers.groupBy("via").agg(F.sum(F.length("data") + 32).alias("bytes"))
    parts = asked.join(bytes_, "via").groupBy(*block).agg(F.ceil(F.sum("bytes") / F.lit(PART_BYTES)).alias("parts"))
    parts = write_once(parts.withColumn("parts", F.least("parts", F.lit(max(1, stretches)))), "parts")  # a row a block
    cells = parts.agg(F.sum("parts")).first()[0] or 1
    wide = F.shiftright("bucket", WIDE_BITS - BITS)
    part = F.pmod(wide, "parts").alias("part")
    sent = asked.join(containers, "via").join(F.broadcast(parts), block).select(*block, part, "via", "bucket", "kind", "data")
    if marked is not None:
        bits = _ordered(marked.select(F.shiftright("node", WIDE_BITS).alias("wide"), "node"), ["wide"], ["wide"]).mapInArrow(_bits, "bucket long, data binary")
        sent = sent.unionByName(bits.join(F.broadcast(parts)).select(*block, part, F.lit(None).cast(kind).alias("via"), "bucket", F.lit(-1).alias("kind"), "data"))
    sent = sent.select(*block, "part", F.lit(0).alias("side"), "via", "bucket", "kind", "data", F.lit(None).cast("long").alias("node"), F.lit(None).cast(f"array<{kind}>").alias("vias"))
    placed = dealt.join(F.broadcast(parts), block).select(*block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("via"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("data"), "node", "vias")
    every = sent.unionByName(placed).repartition(int(min(8 * cells, 4096)), *block, "part").sortWithinPartitions(*block, "part", "side")
    united = every.mapInArrow(_united, "node long, n long, marked long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("marked").alias("m"))
    if not twins:
        return united
    found = firsts.join(united.withColumnRenamed("node", "first"), "first").select("key", "n", "m")
    return alike.select("node", "key").join(found, "key").select("node", "n", "m")
