"""MinHash near-dedup (operator 12): a multi-index Hamming join of signatures, links confirmed on the whole sets.

1. Each document's set of shingles becomes a signature of PARTS minima, of which 16 bits each are kept. Two sets of similarity s
   differ in a part with probability 1 - s, so at 0.85 in more than DISTANCE parts with a probability of 9e-6 (binomial), above it less.
2. Equal sets are one representative. Its signature is split into CHUNKS: of two signatures that differ in DISTANCE parts at
   most, some chunk differs in ERRORS = DISTANCE // CHUNKS parts at most (pigeonhole). A document is posted under each chunk
   with each choice of ERRORS parts left out, so that all pairs under the threshold share a key.
3. Of the documents under one key, all are held against one hub: by size, then by signature distance. Of its hubs a document
   keeps the nearest; this pair is confirmed on the whole sets, made anew from both texts. That joins groups of near copies
   without all their pairs. STARS such rounds go by different hubs. Keys whose documents are all in one component are done.
4. Of the others all pairs in different components are held against each other: by a join where HOT documents at most share
   the key. Documents under hotter keys are clustered (whatever shares such a key is in one cluster) and compared block by block
   of about BLOCK: a task sees the signatures and sets of two blocks, and what leaves it are links that join its components.
5. Of documents under keys that more than HOT share, the shingles that no other such document has are counted beforehand: two of
   these documents can't have them in common, which rules out most pairs of copies with changes of their own, and documents with too many; the
   document with the fewest is the hub.

Sets and keys are 64-bit fingerprints; a key's collisions only add candidates.

Defined results: null, empty or blank text: n_shingles 0, a component of its own. Rows that repeat a doc_id are one node and all
stay. Rows without doc_id link like others; component_id is the smallest doc_id reachable (none: null), kept is false. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, scratch, table
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import mix, shingle_sets

PARTS, DISTANCE, CHUNKS, HOT, BLOCK, STARS = 64, 23, 12, 256, 1024, 1
ERRORS = DISTANCE // CHUNKS
#: 100 * both >= PERCENT * union
PERCENT = 85
#: Nodes of rows without doc_id are above this number.
UNNAMED = 1 << 62
TEXT_BYTES = 8 << 20
EDGES = [k * PARTS // CHUNKS for k in range(CHUNKS + 1)]
_random = np.random.default_rng(12)
_FLIP = _random.integers(0, 1 << 63, PARTS, dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each (non-empty) set PARTS numbers of 16 bits: of the minima under PARTS permutations."""
    every = np.concatenate(sets)
    first = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), PARTS), np.uint64)
    for k in range(PARTS):
        out[:, k] = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], first)
    return (mix(out) >> np.uint64(48)).astype("<u2")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """node and text of a batch, in portions of TEXT_BYTES."""
    nodes, texts, size = [], [], 0
    for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        nodes.append(node)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size > TEXT_BYTES:
            yield nodes, texts
            nodes, texts, size = [], [], 0
    if nodes:
        yield nodes, texts


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nodes, texts in _slices(batch):
            sets = shingle_sets(texts)
            some = [s for s in sets if len(s)]
            signed = iter(signatures(some) if some else ())
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(digest, pa.binary()), pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary())], names=["node", "n", "digest", "signature"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole texts' sets are similar."""
    for batch in batches:
        own, other = [shingle_sets(batch.column(c).cast(pa.binary()).to_pylist()) for c in ("text_a", "text_b")]
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(own, other, strict=True)]
        near = [n * (100 + PERCENT) >= (len(x) + len(y)) * PERCENT for n, x, y in zip(both, own, other, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nodes, texts in _slices(batch):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nodes, texts in _slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["node", "members"])


def _keys(signature: Column) -> Column:
    """The chunks with each one part left out, hashed; equal for any two that agree in the other parts."""
    out = []
    for low, high in zip(EDGES, EDGES[1:], strict=False):
        for gone in range(low, high):
            out.append(F.xxhash64(F.lit(gone), F.substring(signature, 2 * low + 1, 2 * (gone - low)), F.substring(signature, 2 * gone + 3, 2 * (high - gone - 1))))
    return F.array(*out)


def _near_size(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _may_share(n_a, lonely_a, n_b, lonely_b):
    """Whether two sets can be similar although so many members of each are in no other set."""
    return ((n_a - lonely_a) * (100 + PERCENT) >= (n_a + n_b) * PERCENT) & ((n_b - lonely_b) * (100 + PERCENT) >= (n_a + n_b) * PERCENT)


def _may_meet(a: str, b: str) -> Column:
    """_may_share() of two documents under hot keys; others may."""
    told = [F.col(c + x) for x in (a, b) for c in ("n", "lonely")]
    return F.coalesce(_may_share(*told), F.lit(True))


def _parts(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, PARTS)


def _within_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        apart = (_parts(batch.column("sig_a").to_pylist()) != _parts(batch.column("sig_b").to_pylist())).sum(axis=1)
        rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart, pa.int32())], names=["a", "b", "apart"])
        yield rows.filter(pa.array(apart <= DISTANCE))


def _block_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between two blocks of one cluster: of the similar pairs those that join documents of different components, as far as this task knows them."""
    first, second = rows.filter(pc.equal(rows["side"], 0)), rows.filter(pc.equal(rows["side"], 1))
    if not len(second):
        second = first
    a, b = [t["node"].to_numpy() for t in (first, second)]
    of_a, of_b = [t["component"].to_numpy() for t in (first, second)]
    n_a, n_b = [t["n"].to_numpy().astype(np.int64) for t in (first, second)]
    lonely_a, lonely_b = [t["lonely"].to_numpy() for t in (first, second)]
    own, other = [_parts(t["signature"].to_pylist()) for t in (first, second)]
    sets_a, sets_b = [[np.frombuffer(x, np.uint64) for x in t["members"].to_pylist()] for t in (first, second)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    for k in range(len(a)):
        near = (own[k] != other).sum(axis=1) <= DISTANCE
        near &= (of_b != of_a[k]) & (np.minimum(n_a[k], n_b) * 100 >= np.maximum(n_a[k], n_b) * PERCENT) & _may_share(n_a[k], lonely_a[k], n_b, lonely_b)
        for j in np.flatnonzero(near).tolist():
            x, y = find(int(of_a[k])), find(int(of_b[j]))
            if x != y and len(np.intersect1d(sets_a[k], sets_b[j], assume_unique=True)) * (100 + PERCENT) >= (n_a[k] + n_b[j]) * PERCENT:
                root[max(x, y)] = min(x, y)
                left.append(int(min(a[k], b[j])))
                right.append(int(max(a[k], b[j])))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


class HammingJoin:
    """The links between the representatives of docs (node, text)."""

    def __init__(self, docs: DataFrame, own_cut) -> None:
        self.cut = own_cut
        self.sets = own_cut(docs.mapInArrow(_signed, "node long, n int, digest binary, signature binary"), "signatures")
        some = self.sets.where("digest is not null")
        self.reps = own_cut(some.groupBy("digest").agg(F.min("node").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")), "representatives")
        keyed = self.reps.select(F.explode(_keys(F.col("signature"))).alias("key"), F.col("rep").alias("node"), "n")
        shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("m")).where("low <> high").select("key", "m")
        postings = own_cut(keyed.join(shared.hint("rebalance"), "key"), "shared")
        self.texts = own_cut(docs.join(postings.select("node").distinct().hint("rebalance"), "node", "left_semi"), "candidate-texts")
        hot = postings.where(F.col("m") > HOT).select("node").distinct()
        members = self.texts.join(hot, "node", "left_semi").mapInArrow(_shingles, "node long, shingle long")
        alone = members.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
        lonely = hot.join(alone.groupBy("node").agg(F.count("*").cast("int").alias("lonely")), "node", "left").fillna(0, ["lonely"])
        self.postings = own_cut(postings.drop("m").join(lonely, "node", "left"), "postings")  # null: under no hot key
        self.links = self.labels = None

    def _verified(self, pairs: DataFrame, label: str, nearest: bool) -> DataFrame:
        """Pairs (a, b) of similarity PERCENT or more: by signatures (if asked, of each b the nearest a alone), then by the whole texts."""
        side = lambda k: self.reps.select(F.col("rep").alias(k), F.col("signature").alias(f"sig_{k}"))
        near = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_within_distance, "a long, b long, apart int")
        near = near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), "b") if nearest else near.select("a", "b").distinct()
        near = self.cut(near, f"{label}-near")
        told = lambda k: self.texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
        held = near.join(told("b"), "b").join(told("a"), "a").select("a", "b", "text_a", "text_b")
        return self.cut(held.mapInArrow(_confirmed, "a long, b long"), f"{label}-links")

    def _open(self, label: str) -> DataFrame:
        """Postings of the keys whose documents are in more than one component: key, node, n, lonely, component, m (documents of the key)."""
        placed = self.postings.withColumn("component", F.col("node"))
        if self.labels is not None:
            own = self.labels.withColumnRenamed("node", "of").withColumnRenamed("component", "found").hint("rebalance")
            placed = placed.join(own, placed["node"] == own["of"], "left").select("key", "node", "n", "lonely", F.coalesce("found", "node").alias("component"))
        placed = self.cut(placed, f"{label}-placed")
        kept = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high").select("key", "m")
        return placed.join(kept.hint("rebalance"), "key")

    def _add(self, found: DataFrame) -> None:
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.labels = connected_components(self.links)

    def star(self, nth: int) -> None:
        """Holds each key's documents against one of them: that with the fewest lonely shingles for its size, then by an order of the round's own."""
        rows = self.cut(self._open(f"star-{nth}"), f"open-{nth}")
        place = F.xxhash64("node", F.lit(nth)) if nth else F.col("node")
        hub = rows.groupBy("key").agg(F.min(F.struct((F.coalesce("lonely", F.lit(0)) / F.col("n")).alias("share"), place.alias("place"), "node", "n", "lonely", "component")).alias("hub"))
        told = rows.join(hub.hint("rebalance"), "key").where((F.col("component") != F.col("hub.component")) & _near_size("n", "hub.n"))
        told = told.withColumns({"n_hub": F.col("hub.n"), "lonely_hub": F.col("hub.lonely")}).where(_may_meet("", "_hub"))
        self._add(self._verified(told.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), f"star-{nth}", True))

    def rest(self) -> None:
        """All pairs that share a key and are still in different components."""
        rows = self.cut(self._open("rest"), "rest")
        few, hot = rows.where(F.col("m") <= HOT), rows.where(F.col("m") > HOT)
        side = lambda k: few.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "lonely", "component")])
        both = side("a").join(side("b"), "key").where((F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b")) & _near_size("n_a", "n_b"))
        both = both.where(_may_meet("_a", "_b"))
        links = self._verified(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "rest", False)
        hot = self.cut(hot.where((F.col("n") - F.col("lonely")) * 100 >= F.col("n") * PERCENT).drop("m"), "hot")
        if not hot.isEmpty():
            links = links.union(self._hot_links(hot))
        self._add(links)

    def _hot_links(self, hot: DataFrame) -> DataFrame:
        """Of postings under hot keys: links found block by block of each cluster."""
        firsts = hot.groupBy("key").agg(F.min("node").alias("a"))
        clusters = connected_components(hot.join(firsts.hint("rebalance"), "key").select("a", F.col("node").alias("b")), "clusters").withColumnRenamed("component", "cluster")
        told = hot.select("node", "n", "lonely", "component").distinct().join(clusters, "node")
        sets = self.texts.join(told.select("node"), "node", "left_semi").mapInArrow(_sets, "node long, members binary")
        told = told.join(self.reps.select(F.col("rep").alias("node"), "signature"), "node").join(sets, "node")
        sizes = told.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        told = told.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        told = told.select("cluster", "node", "n", "lonely", "component", "signature", "members", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
        return self.cut(told.groupBy("cluster", "i", "j").applyInArrow(_block_links, "a long, b long").distinct(), "hot-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity 0.85 or more), kept (whether it is the document's own)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(UNNAMED))
    with scratch(docs.sparkSession) as own_cut:
        join = HammingJoin(docs.select(node.alias("node"), text.alias("text")), own_cut)
        for nth in range(STARS):
            join.star(nth)
        join.rest()
        reps = join.reps.select("digest", F.col("rep").alias("component"))
        if join.labels is not None:
            reps = join.reps.join(join.labels, join.reps["rep"] == join.labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
        found = join.sets.where("digest is not null").select("node", "n", "digest").join(reps.hint("rebalance"), "digest").select("node", "n", "component")
        found = found.union(join.sets.where("digest is null").select("node", "n", F.col("node").alias("component")))
        named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
        out = found.select(named("node").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), named("component").alias("component_id"))
        return cut(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near-duplicates")


def op12_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
