"""Toxicity (operator 10): averaged subword-bag embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its n-grams of 3 to 5 bytes (with marks for its ends), a window of WINDOW words the
mean of its words, and a linear softmax tells the classes. A document's score is that of its worst window, put through a
logistic curve fitted on labelled documents that the training didn't see. Since a window's score is linear in its words'
vectors, a trained model comes down to one number per n-gram bucket.

The training takes at most MAX_DOCS labelled documents of each class, those with the least hash of doc_id, of at most
MAX_BYTES each: a bounded sample, by which nothing else is limited. All texts are scored whole.

Defined results: null, empty and blank texts have one window without words; documents without doc_id are scored (and held
out); rows that repeat stay; an empty table gives no rows; without labels of both classes every score is 0. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, free_name, table

BUCKETS, DIM, WINDOW, STEP = 1 << 17, 8, 6, 3
MAX_DOCS, MAX_BYTES = 2500, 20_000
#: An n-gram bucket has a vector if so many training documents have it.
LEAST_DOCS = 4
DECAY = 1e-6
ROUNDS, STEPS, RATE = 8, 15, 0.05
THRESHOLD = 0.7
WORDS_KEPT = 300_000


_PLACE = np.random.default_rng(10).integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = np.uint64(64 - 17)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams, word after word, and how many each word has (one at least)."""
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    length = np.array([len(w) + 2 for w in words])
    last = np.repeat(np.cumsum(length), length)  # where each byte's word ends
    at = np.arange(len(data))
    grams, keep, total = [], [], np.zeros(len(data), np.uint64)
    for n in range(min(5, len(data))):
        total[: len(data) - n] += data[n:] * _PLACE[n]
        if n >= 2:
            grams.append(((total * np.uint64(0x9E3779B97F4A7C15)) >> SHIFT).astype(np.int64))
            keep.append(at + n < last)
    keep = np.stack(keep, 1)
    sizes = np.add.reduceat(keep.sum(1), np.cumsum(length) - length)
    return np.stack(grams, 1)[keep], sizes


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one word of each window of n words; the windows cover all words."""
    first = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    return first, np.minimum(first + WINDOW, n)


@dataclass
class Model:
    bucket: np.ndarray
    bias: float
    slope: float
    offset: float

    def words(self, words: list[bytes]) -> list[float]:
        flat, sizes = subwords(words)
        return (np.add.reduceat(self.bucket[flat], np.cumsum(sizes) - sizes) / sizes).tolist()

    def worst(self, z: np.ndarray) -> float:
        first, last = windows(len(z))
        total = np.concatenate(([0.0], np.cumsum(z)))
        return float(((total[last] - total[first]) / np.maximum(1, last - first)).max() + self.bias)

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40))))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Jointly trains n-gram vectors and the softmax on windows; a toxic document's worst windows carry its label."""
    rng = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -40.0)
    types: dict[bytes, int] = {}
    docs = [np.array([types.setdefault(w, len(types)) for w in text_words(t)], np.int64) for t in texts]
    if not types:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -40.0)
    flat, sizes = subwords(list(types))
    starts = np.cumsum(sizes) - sizes
    share = (1 / np.repeat(sizes, sizes)).astype(np.float32)

    held = rng.random(len(docs)) < 0.25  # for the logistic curve
    rows, of = [], []
    for d, words in enumerate(docs):
        first, _ = windows(len(words))
        if len(words):
            at = np.minimum(first[:, None] + np.arange(WINDOW), len(words))
            rows.append(np.where(at < len(words), np.append(words, -1)[at], -1))
            of.append(np.full(len(first), d))
    rows, of = np.concatenate(rows), np.concatenate(of)
    filled = (rows >= 0).sum(1)
    seen = np.zeros(BUCKETS, np.int64)
    for words in docs:
        if len(words):
            own = np.unique(words)
            seen[np.unique(np.concatenate([flat[starts[w] : starts[w] + sizes[w]] for w in own]))] += 1
    useful = seen >= LEAST_DOCS
    vectors = np.where(useful[:, None], rng.normal(0, 0.1, (BUCKETS, DIM)), 0).astype(np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [vectors, soft, bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def logits() -> np.ndarray:
        z = np.append(np.add.reduceat((vectors @ (soft[:, 1] - soft[:, 0]))[flat] * share, starts), 0)
        return z[rows].sum(1) / filled + bias[1] - bias[0]

    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    toxic = labels[of] == 1
    for turn in range(ROUNDS):
        noise = rng.random(len(rows))
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((noise if turn == 0 else -logits(), of))] = place
        pick = np.flatnonzero(((rank < np.where(toxic, 6 if turn == 0 else 1, 3)) | (~toxic & (noise < 0.02))) & ~held[of])
        kinds, local = np.unique(rows[pick], return_inverse=True)  # the first is the empty place, -1, if there is one
        local = local.reshape(-1, WINDOW)
        words = kinds[kinds >= 0]
        shift = len(kinds) - len(words)
        here = np.concatenate([np.arange(starts[w], starts[w] + sizes[w]) for w in words])
        gram, weight_of = flat[here], share[here]
        size = sizes[words]
        heads, mine = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(np.arange(len(words)), size)
        buckets, slot = np.unique(gram, return_inverse=True)
        free = useful[buckets][:, None]
        y = labels[of[pick]].astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
        for _ in range(STEPS):
            each = np.vstack([np.zeros((shift, DIM), np.float32), np.add.reduceat(vectors[gram] * weight_of[:, None], heads)])
            inside = each[local].sum(1) / filled[pick, None]
            s = inside @ soft + bias
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.stack([1 - y, y], 1)) * weight[:, None]
            back = (d @ soft.T) / filled[pick, None]
            to_word = np.stack([np.bincount(local.ravel(), np.repeat(back[:, k], WINDOW), len(kinds))[shift:] for k in range(DIM)], 1)
            to_gram = np.stack([np.bincount(slot, to_word[mine, k] * weight_of, len(buckets)) for k in range(DIM)], 1)
            t += 1
            for k, (g, at) in enumerate(((to_gram * free + DECAY * vectors[buckets], buckets), (inside.T @ d, slice(None)), (d.sum(0), slice(None)))):
                m[k][at] += 0.1 * (g - m[k][at])
                v[k][at] += 0.01 * (g * g - v[k][at])
                params[k][at] -= RATE * (m[k][at] / (1 - 0.9**t)) / (np.sqrt(v[k][at] / (1 - 0.99**t)) + 1e-7)
    model = Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    got = logits()
    worst = np.full(len(docs), -20.0)
    np.maximum.at(worst, of, got)
    x, y = worst[held], labels[held].astype(float)
    if len(set(y.tolist())) == 2:
        centre, spread = x.mean(), x.std() + 1e-6
        a, b, u = 1.0, 0.0, (x - centre) / spread
        for _ in range(3000):
            p = 1 / (1 + np.exp(-np.clip(a * u + b, -40, 40)))
            a, b = a - 0.5 * (((p - y) * u).mean() + 1e-4 * a), b - 0.5 * (p - y).mean()
        model.slope, model.offset = a / spread, b - a * centre / spread
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample: MAX_DOCS of each class at most, of the rows whose crc32 modulo 3 isn't 1."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1)).select("doc_id", "toxic")
    ids = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS) for k in (0, 1)]
    small = F.broadcast(ids[0].union(ids[1]))  # 2 * MAX_DOCS rows at most
    rows = docs.where(F.octet_length("text") <= MAX_BYTES).select("doc_id", "text").join(small, "doc_id").orderBy("doc_id", "text").limit(4 * MAX_DOCS).toPandas()
    return [t.encode("utf-8", "surrogatepass") for t in rows["text"]], rows["toxic"].to_numpy(np.int64)


def _with_score(docs: DataFrame, labels: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """The rows of, some columns of docs, with the score in a column of this name."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(*training_sample(docs, labels)))  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        m = model.value
        for batch in batches:
            out = []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = text_words(text)
                new = list({w for w in words if w not in known})
                if new:
                    if len(known) > WORDS_KEPT:
                        known, new = {}, list(set(words))
                    known.update(zip(new, m.words(new), strict=True))
                out.append(m.score(m.worst(np.fromiter(map(known.__getitem__, words), float, len(words)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    scored = of.withColumn("text", F.col("text").cast("string"))
    return scored.mapInArrow(score, scored.withColumn(name, F.lit(0.0)).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = _with_score(docs, labels, docs.select("doc_id", "text"), "score")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted to be toxic."""
    name = free_name(docs, "toxicity")
    return _with_score(docs, labels, docs, name).where(F.col(name) < THRESHOLD).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
