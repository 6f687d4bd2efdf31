"""Periodic run detection (operator 13): Gusfield and Stoye's linear tandem-repeat method on the words of a text.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, TIMES * q) that no neighbouring word
extends. Each task handles its documents whole, in groups of GROUP_WORDS words (a longer document is a group of its own):

1. Words become numbers, exactly, by a dictionary for each document. A run's words occur at least four times and its
   three-word sequences at least three times in the document; only stretches of six or more words of which that is so go on.
   No run is lost: it lies within one stretch, and so would a word that extends it.
2. The stretches of a group are one sequence, with marks between them that occur nowhere else. Its suffix tree comes from a
   suffix array (prefix doubling) and the longest common prefixes.
3. Lempel-Ziv blocks (the longest factor that began earlier) give, with extensions to both sides of the block ends, a set
   of squares that covers the leftmost one of each kind; they are marked in the tree, bottom-up.
4. Walks along suffix links from each mark find the rotations, until the vocabulary of all squares is complete.
5. The leaves below a square with a primitive root are its places; places that follow each other with one period are a run.

Defined results: null text: no words; no words or no runs: n_runs 0 and four nulls. Words are compared as they are (no
lower-casing). Rows without doc_id and rows that repeat one are documents of their own. Very long texts need memory in
proportion to their stretches. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, table, words
from lodestone.llm.shingles import mix

LEAST, TIMES, GROUP_WORDS = 6, 4, 1 << 18
RUN_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def prefix_ranks(x: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the ranks of all substrings of 2**k symbols; the last one's are all different (x ends in a symbol of its own)."""
    levels, n, width = [np.unique(x, return_inverse=True)[1].astype(np.int64)], len(x), 1
    while levels[-1].max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = levels[-1][width:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return levels


def common_ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and j on agree (i <> j)."""
    i, j, start = i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - start


def common_behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols up to i and up to j, inclusive, agree (i <> j)."""
    i, j, start = i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - (1 << k) + 1, j - (1 << k) + 1
        step = ((a >= 0) & (b >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
        i -= step
        j -= step
    return start - i


def lz_blocks(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks start. A block is the longest factor that also begins earlier, or one new symbol."""
    n = len(order)
    before, after, stack = np.full(n, -1), np.full(n, -1), []
    for i in order.tolist():  # the nearest suffixes in the order, to both sides, that begin earlier
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    longest = np.zeros(n, np.int64)
    for other in (before, after):
        some = np.flatnonzero(other >= 0)
        longest[some] = np.maximum(longest[some], common_ahead(levels, some, other[some]))
    size, starts, at = np.maximum(longest, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += size[at]
    return np.array(starts)


def _counting(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group g its members 1..sizes[g]: (g, member)."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def covering_squares(levels: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, period) of which one is at or left of the leftmost square of each kind, with only squares of that period between."""
    n = len(levels[0])
    edges = np.append(starts, n)
    size = np.diff(edges)
    # period k about a block's end: the first half starts within the block
    of, k = _counting(np.where(edges[1:] < n, size, 0))
    end = edges[1:][of]
    q = end - k
    ahead, behind = common_ahead(levels, q, end), np.zeros(len(q), np.int64)
    some = q > 0
    behind[some] = common_behind(levels, q[some] - 1, end[some] - 1)
    start = np.maximum(q - behind, q - k + 1)
    good = (ahead + behind >= k) & (ahead > 0) & (start >= 0)
    found = [(start[good], k[good])]
    # period k about a block's start: the first half begins before the block and ends within it
    of, k = _counting(np.minimum(size + np.append(size[1:], 0), n - 1 - starts))
    head = starts[of]
    some = head > 0
    of, k, head = of[some], k[some], head[some]
    ahead, behind = common_ahead(levels, head, head + k), common_behind(levels, head - 1, head + k - 1)
    start = np.maximum(head - behind, head - k + 1)
    good = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (start + k <= edges[1:][of])
    found.append((start[good], k[good]))
    return np.concatenate([s for s, _ in found]), np.concatenate([k for _, k in found])


class SuffixTree:
    """Nodes 0..n-1 are the leaves in the order of their suffixes, the others internal; the first of these, n, is the root."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]) -> None:
        n = len(x)
        self.x, self.rank, self.order = x, levels[-1], np.argsort(levels[-1])
        shared = [0, *common_ahead(levels, self.order[:-1], self.order[1:]).tolist()]
        depth, low, high, parent, above, stack = [0], [0], [n - 1], [n], [n] * n, [0]
        for r in range(1, n):
            here, last = shared[r], -1
            while depth[stack[-1]] > here:
                last = stack.pop()
                high[last] = r - 1
                if depth[stack[-1]] >= here:
                    parent[last] = n + stack[-1]
            if depth[stack[-1]] < here:
                new = len(depth)
                depth.append(here)
                low.append(r - 1 if last < 0 else low[last])
                high.append(n - 1)
                parent.append(n + stack[-1])
                if last < 0:
                    above[r - 1] = n + new
                else:
                    parent[last] = n + new
                stack.append(new)
            above[r] = n + stack[-1]
        every = np.arange(n)
        self.low, self.high = np.concatenate((every, low)), np.concatenate((every, high))
        parent_of, depth_of = np.array([*above, *parent]), np.concatenate((n - self.order, depth))
        least = np.concatenate((self.order, np.full(len(depth), n)))
        self.root, self.symbols = n, int(x.max()) + 1
        for v in np.argsort(-depth_of, kind="stable").tolist():  # children before their parents
            if least[parent_of[v]] > least[v]:
                least[parent_of[v]] = least[v]
        others = np.flatnonzero(np.arange(len(parent_of)) != n)
        keys = parent_of[others] * self.symbols + x[self.order[self.low[others]] + depth_of[parent_of[others]]]
        self.child = dict(zip(keys.tolist(), others.tolist(), strict=True))
        self.parent, self.depth, self.least, self.text = parent_of.tolist(), depth_of.tolist(), least.tolist(), x.tolist()
        self._link()

    def down(self, v: int, at: int, length: int) -> int:
        """From node v to the end of the text's `length` symbols from `at`, which the tree holds: the node at or below that end."""
        depth, child, text, symbols = self.depth, self.child, self.text, self.symbols
        while depth[v] < length:
            v = child[v * symbols + text[at + depth[v]]]
        return v

    def _link(self) -> None:
        """Suffix links of the internal nodes, from the root down."""
        n, depth = self.root, self.depth
        self.link = link = {n: n}
        inner = range(n + 1, len(depth))
        for v in sorted(inner, key=depth.__getitem__):
            link[v] = self.down(link[self.parent[v]], self.least[v] + 1, depth[v] - 1)


def square_vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> set[tuple[int, int]]:
    """The ends of all different squares in the tree, as (node at or below the end, length), from a set that covers the leftmost ones."""
    order = np.lexsort((period, start))
    own: dict[int, list[int]] = {}
    for s, k in zip(start[order].tolist(), period[order].tolist(), strict=True):
        own.setdefault(s, []).append(2 * k)
    parent, depth, least, text, link = tree.parent, tree.depth, tree.least, tree.text, tree.link
    marks: set[tuple[int, int]] = set()
    for s, lengths in own.items():  # upwards while s is the leftmost leaf
        v = int(tree.rank[s])
        while lengths:
            while lengths and lengths[-1] > depth[parent[v]]:
                marks.add((v, lengths.pop()))
            v = parent[v]
            if least[v] != s:
                break
    for v, length in list(marks):
        while True:  # drop the first symbol and append it at the end
            at = least[v]
            v = tree.down(link[parent[v]], at + 1, length - 1)
            if depth[v] == length - 1:
                v = tree.child.get(v * tree.symbols + text[at], -1)
                if v < 0:
                    break
            elif text[least[v] + length - 1] != text[at]:
                break
            if (v, length) in marks:
                break
            marks.add((v, length))
    return marks


def _primitive(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the `period` symbols from `at` on are no power of a shorter word: none of their largest proper divisors is a period."""
    out, rest, d = np.ones(len(at), bool), period.copy(), 2
    while True:
        some = np.flatnonzero(rest > 1)
        if not len(some):
            return out
        d = d if d * d <= rest[some].max() else 0
        prime = np.full(len(some), d) if d else rest[some]
        divides = rest[some] % prime == 0
        some, prime = some[divides], prime[divides]
        short = period[some] // prime
        out[some] &= common_ahead(levels, at[some], at[some] + short) < period[some] - short
        while len(some):
            rest[some] //= prime
            again = rest[some] % prime == 0
            again &= rest[some] > 1
            some, prime = some[again], prime[again]
        d += 1


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal stretches of x with a smallest period q and at least 2 q symbols: start, length, period. x ends in a symbol of its own."""
    none = np.empty(0, np.int64)
    levels = prefix_ranks(x)
    start, period = covering_squares(levels, lz_blocks(levels, np.argsort(levels[-1])))
    if not len(start):
        return none, none, none
    tree = SuffixTree(x, levels)
    marks = np.array(sorted(square_vocabulary(tree, start, period)), np.int64)
    node, period = marks[:, 0], marks[:, 1] // 2
    keep = _primitive(levels, tree.order[tree.low[node]], period)
    node, period = node[keep], period[keep]
    many = tree.high[node] - tree.low[node] + 1
    of, nth = _counting(many)
    at, q = tree.order[tree.low[node][of] + nth - 1], period[of]
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(q) != 0) | (np.diff(at) != 1))))
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] - at[first] + 2 * q[first], q[first]


def _stretches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which a run may lie. ids: words of all documents, -1 between them."""
    n = len(ids) - 2
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    often = np.append(np.bincount(ids[ids >= 0], minlength=1) >= TIMES, False)[ids]  # -1: the last one
    three = np.flatnonzero(often[:n] & often[1:-1] & often[2:])
    u = ids.astype(np.uint64)
    _, of, count = np.unique(mix(mix(mix(u[three]) + u[three + 1]) + u[three + 2]), return_inverse=True, return_counts=True)
    three = three[count[of] >= TIMES - 1]
    if not len(three):
        return three, three
    first = np.flatnonzero(np.concatenate(([True], np.diff(three) != 1)))
    start, end = three[first], three[np.append(first[1:], len(three)) - 1] + 3
    keep = end - start >= LEAST
    return start[keep], end[keep]


def document_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text (its words) all its runs (start, length, period), by start, then period."""
    parts, base = [], 0
    for text in texts:
        own: dict[bytes, int] = {}
        parts += [np.fromiter((own.setdefault(w, len(own)) for w in text), np.int64, len(text)) + base, np.array([-1])]
        base += len(own)
    ids = np.concatenate([*parts, np.empty(0, np.int64)])
    start, end = _stretches(ids)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(start):
        return out
    of, nth = _counting(end - start + 1)
    place = start[of] + nth - 1
    x, last = ids[place], nth == (end - start + 1)[of]
    x[last] = base + of[last]  # a symbol of its own ends each stretch
    at, length, period = runs_of(x)
    good = length >= np.maximum(LEAST, TIMES * period)
    at, length, period = place[at[good]], length[good], period[good]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    doc = np.searchsorted(begins, at, side="right") - 1
    order = np.lexsort((period, at))
    for d, a, n, q in zip(doc[order].tolist(), (at - begins[doc])[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        out[d].append((a, n, q))
    return out


def _collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(text)
    dropped = np.zeros(len(text), bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return b" ".join([w for w, gone in zip(text, dropped.tolist(), strict=True) if not gone])


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    group, size = [], 0
    for row in rows:
        if group and size + len(row[1]) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1])
    if group:
        yield group


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for group in _groups((d, (t.as_py() or b"").split()) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
            found = document_runs([t for _, t in group])
            best = [min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None) for runs in found]
            columns = [pa.array([d for d, _ in group], pa.int64()), pa.array([len(r) for r in found], pa.int64())]
            columns += [pa.array([b[k] for b in best], pa.int64()) for k in range(3)]
            columns.append(pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found], pa.list_(run)))
            columns.append(pa.array([_collapsed(t, r).decode() for (_, t), r in zip(group, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """RUN_SCHEMA for every document: its runs, the one of greatest length / period (ties: smallest start, then period) and the text without repeats."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judge, RUN_SCHEMA)


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents (by their id's checksum h) repeat p words from word a on, up to their last word."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    g = F.floor(crc_mod("doc_id", 1 << 32) / 10)
    chosen = crc_mod("doc_id", 10) == 0
    own = F.array(F.struct(words(F.when(chosen, F.col("text"))).alias("w"), g.alias("g")))  # bound by a lambda: words are split once

    def changed(s: Column) -> Column:
        n = F.greatest(F.size(s["w"]), F.lit(1)).cast("long")
        a = s["g"] % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + s["g"] % 8))
        repeated = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(s["w"], (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(s["w"], F.lit(1), a.cast("int")), repeated), " ")

    return rows.select("doc_id", F.when(chosen & (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))) > 0), F.get(F.transform(own, changed), F.lit(0))).otherwise(F.col("text")).alias("text"))


def digest_of_runs(runs: Column) -> Column:
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_ends(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), digest_of_runs(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
