"""N-gram Jaccard join (operator 6): multiple-global-order prefix filtering, then exact verification.

1. Block pass: documents are dealt into blocks; each block sends its distinct shingle fingerprints, split by range, as
   packed integers. Each range counts in how many blocks a fingerprint occurs and answers with one byte each.
2. With these frequencies each document takes its prefix, of n - ceil(3n/4) + 1 shingles, under ORDERS global orders: rare
   classes first, and within a class by a hash of its own seed. Two sets of similarity 0.75 or more share a shingle in
   each of these prefixes. Shingles that occur once match nothing and are left out of the prefixes' rows; a document whose
   prefix is made of such shingles has no partner.
3. Equal sets are one representative. Candidates share a shingle of the first order's prefix at ranks that leave enough
   room, and shingles of the other prefixes too. They are verified on the whole sets.
4. First each shingle's documents are held against one hub, which joins groups of copies without making all their pairs;
   then the pairs that still lie in different components are: of a shingle's documents, those outside the component that most
   of them lie in are held against all. A shingle with more than HOT such documents gives no pairs of its own: they meet by
   the pair of a shared token of the first order and one of the second, and where more than HOT share that, by one of the
   third order too.

Sets hold 64-bit fingerprints of shingles; two different shingles of a pair of documents agree with a probability of about
n * m / 2**64.

Defined results: null, empty or blank text: n_shingles 0, a component of its own. doc_ids are whole numbers; rows without
one are left out. Rows that repeat a doc_id stay, as one node. An empty table gives no rows. Other columns are ignored.
one_of_each_group() takes rows without doc_id too: as if their text's hash were a doc_id above all others.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, groups_for, scratch, table, text_bytes
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import mix, shingle_sets

#: Text bytes of a block, and of the shingles of a range (about two million); both grow with the root of the corpus beyond
#: GROW_BYTES, up to MOST_TIMES, so that a block still sends each range several fingerprints at once.
BLOCK_BYTES, RANGE_BYTES, GROW_BYTES, MOST_TIMES = 4 << 20, 12 << 20, 4 << 30, 16
ORDERS, HOT = 3, 256
SEEDS = [np.uint64(0x51ED270B0F3D1A2B * (k + 1) % (1 << 64)) for k in range(ORDERS)]
SET_SCHEMA = "doc_id long, n int, single int, digest binary, first array<long>, second array<int>, third array<int>, shingles array<long>"


def _pack(x: np.ndarray) -> bytes:
    """Sorted 32-bit integers as differences, byte plane by byte plane, so that the shuffle's compression drops the empty planes."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _block_tokens(texts: pa.Table, bits: int):
    """The block's sets; its distinct fingerprints with local counts; their leading 32 + bits bits, and those without repeats."""
    sets = shingle_sets(texts["text"].cast(pa.binary()).to_pylist())
    every = np.concatenate([np.empty(0, np.uint64), *sets])
    tokens, local = np.unique(every, return_counts=True)
    lead = tokens >> np.uint64(32 - bits)
    return sets, tokens, local, lead, np.unique(lead)


def shingle_tables(docs: DataFrame) -> DataFrame:
    """SET_SCHEMA for every document; only those that may have a partner have more than doc_id and n."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(rows)
    times = min(MOST_TIMES, max(1, math.isqrt(total // GROW_BYTES)))
    blocks = groups_for(total, BLOCK_BYTES * times, 64)
    bits = max(2, math.ceil(math.log2(groups_for(total, RANGE_BYTES * times, 4))))

    def send(key: tuple, texts: pa.Table) -> pa.Table:
        unique = _block_tokens(texts, bits)[4]
        ranges = (unique >> np.uint64(32)).astype(np.int64)
        low = unique.astype(np.uint32)
        cuts = np.searchsorted(ranges, np.arange((1 << bits) + 1))
        got = np.flatnonzero(np.diff(cuts))
        return pa.table({"block": pa.array([key[0].as_py()] * len(got), pa.int32()), "range": pa.array(got, pa.int32()), "tokens": pa.array([_pack(low[cuts[r] : cuts[r + 1]]) for r in got], pa.binary())})

    def answer(key: tuple, packed: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in packed["tokens"].to_pylist()]
        values, df = np.unique(np.concatenate(lists), return_counts=True)
        classes = np.where(df == 1, 0, np.minimum(255, 8 * np.log2(df))).astype(np.uint8)
        return pa.table({"block": packed["block"], "range": packed["range"], "classes": pa.array([classes[np.searchsorted(values, x)].tobytes() for x in lists], pa.binary())})

    def choose(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        sets, tokens, local, lead, unique = _block_tokens(texts, bits)
        classes = np.frombuffer(b"".join(answers.sort_by("range")["classes"].to_pylist()), np.uint8)
        classes = classes[np.searchsorted(unique, lead)].astype(np.int16)
        classes[(classes == 0) & (local > 1)] = 1
        out = []
        for s in sets:
            n = len(s)
            own = classes[np.searchsorted(tokens, s)]
            single, prefix = int((own == 0).sum()), n - -(-3 * n // 4) + 1
            if n and single < prefix:
                orders = [s[np.lexsort((mix(s ^ seed), own))[single:prefix]].view(np.int64) for seed in SEEDS]
                out.append((n, single, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), orders[0], orders[1].astype(np.int32), orders[2].astype(np.int32), s.view(np.int64)))
            else:
                out.append((n, *[None] * 6))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
        return pa.Table.from_arrays([texts["doc_id"], *columns], names=[x.split()[0] for x in SET_SCHEMA.split(", ")])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    lists = dealt.groupBy("block").applyInArrow(send, "block int, range int, tokens binary")
    answers = lists.groupBy("range").applyInArrow(answer, "block int, range int, classes binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(choose, SET_SCHEMA)


def _room(n_a: Column, n_b: Column, rank_a: Column, rank_b: Column) -> Column:
    """Whether different sets of these sizes, whose first common shingle has these ranks, can still overlap in 3/7 of the sizes' sum."""
    most = F.least(n_a - rank_a, n_b - rank_b, F.when(n_a == n_b, n_a - 1).otherwise(n_a))
    return most * 7 >= (n_a + n_b) * 3


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those of similarity 0.75 or more: first both other prefixes, then the whole sets.

    Nothing that needs a key's rows together stands above the joins, so that AQE can split those of a hub.
    """
    other = lambda k: sets.select(F.col("doc_id").alias(k), F.col("second").alias(f"second_{k}"), F.col("third").alias(f"third_{k}"))
    whole = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}"))
    near = pairs.join(other("b"), "b").join(other("a"), "a")
    near = near.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    held = near.join(whole("b"), "b").join(whole("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return held.where(common * 7 >= (F.size("set_a") + F.size("set_b")) * 3).select("a", "b")


def _by_key(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys that different components share: of those with HOT rows at most outside the key's largest component, and of the others.

    out: whether a row is outside of it. Of two rows of different components at least one is.
    """
    each = rows.groupBy(*keys, "component").agg(F.count("*").alias("m"))
    shared = each.groupBy(*keys).agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("m"), F.count("*").alias("k")).where("k > 1")
    shared = shared.select(*keys, F.col("main.component").alias("main"), (F.col("m") - F.col("main.m")).alias("outside"))
    found = rows.join(shared.hint("rebalance"), keys).withColumn("out", F.col("component") != F.col("main")).drop("main")
    return found.where(F.col("outside") <= HOT).drop("outside"), found.where(F.col("outside") > HOT).drop("outside")


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different components that share a key and may be similar; one of them is outside the key's largest component."""
    side = lambda k, rows: rows.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "n", "rank", "component", "out")])
    both = side("a", rows.where("out")).join(side("b", rows), keys).where(F.when(F.col("out_b"), F.col("component_a") < F.col("component_b")).otherwise(True))
    both = both.where(_room(F.col("n_a"), F.col("n_b"), F.col("rank_a"), F.col("rank_b")))
    return both.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity 0.75 or more)."""
    with scratch(docs.sparkSession) as own_cut:
        sets = own_cut(shingle_tables(docs), "sets")
        some = sets.where("digest is not null")
        reps = own_cut(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
        own = some.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        postings = own_cut(own.select("doc_id", "n", "single", F.posexplode("first").alias("at", "token")).withColumn("rank", F.col("single") + F.col("at")), "postings")

        hubs = postings.groupBy("token").agg(F.min(F.struct("single", "doc_id", "n", "rank")).alias("hub"), F.count("*").alias("m")).where("m > 1")
        star = postings.join(hubs.hint("rebalance"), "token").where(F.col("doc_id") != F.col("hub.doc_id"))
        star = star.where(_room(F.col("n"), F.col("hub.n"), F.col("rank"), F.col("hub.rank")))
        star = own_cut(star.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
        links = own_cut(_verify(star, some), "star-links")
        labels = connected_components(links)

        placed = postings.join(labels.hint("rebalance"), postings["doc_id"] == labels["node"], "left").select("token", "doc_id", "n", "rank", F.coalesce("component", "doc_id").alias("component"))
        least = placed.groupBy("token").agg(F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "least")
        open_ = placed.join(least.hint("rebalance"), "token").where((F.col("n") - F.col("rank")) * 7 >= (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * 3 / 4))) * 3)
        few, hot = _by_key(own_cut(open_.select("token", "doc_id", "n", "rank", "component"), "open"), ["token"])
        cross = _pairs(few, ["token"])
        hot = own_cut(hot, "hot")
        if not hot.isEmpty():  # the same candidates by narrower keys
            told = lambda rows, order: rows.drop("out").join(own.select("doc_id", order), "doc_id").withColumn(order, F.explode(order))
            few, hotter = _by_key(told(hot, "second"), ["token", "second"])
            cross = cross.union(_pairs(few, ["token", "second"]))
            narrowest = ["token", "second", "third"]
            for some_keys in _by_key(told(hotter, "third"), narrowest):
                cross = cross.union(_pairs(some_keys, narrowest))
        cross = own_cut(cross.distinct(), "cross")
        more = own_cut(_verify(cross, some), "cross-links")
        if not more.isEmpty():
            labels = connected_components(links.union(more))

        of_rep = reps.join(labels, reps["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
        found = some.select("doc_id", "n", "digest").join(of_rep.hint("rebalance"), "digest").select("doc_id", "n", "component_id")
        alone = sets.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return cut(found.union(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"), "near-duplicates")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without those that are near duplicates of a document with a smaller doc_id; rows that repeat doc_id (or have none) and text become one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), without).alias("doc_id"), text.alias("text"))
    found = near_duplicates(keyed.select("doc_id", "text"))
    kept = cut(found.where((F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0)).select("doc_id").distinct(), "kept")
    return keyed.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
