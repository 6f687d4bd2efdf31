"""LM scoring (operator 9): online logistic context mixing over the bits of a text's tokens.

Training documents are those whose crc32(doc_id as text) modulo 7 isn't 2. A first pass counts their lower-cased words and
ends. The most frequent words, at most DICTIONARY that occur LEAST_COUNT times or more, get code words; other words are spelt
out. In a second pass the bit predictors of context_mixing learn from whole texts, with contexts that run across the ends of
words; their mixing weights and last stage learn in the same online pass. Tasks learn apart: their counts are summed,
exactly, and their weights averaged by the bits that each has seen. The score is the log10 probability that the mixer gives
all of a document's tokens and its end; bits_per_byte is the same by the text's bytes.

The base score counts words: log10 of (c + 1) / (N + V + 1) for each token. Frequent words' values (at most FREQUENT) are
broadcast as arrays; those of the others are joined by the word's 64-bit hash. The tables that are gathered on the driver
have fixed sizes (DICTIONARY words, SLOTS counts, the learners' sums).

Defined results: null and empty texts are the end alone; rows that repeat stay; rows without doc_id count as training
documents; an empty table gives no rows; without training documents N is 0 and the mixer knows nothing. Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, cut, table
from lodestone.llm.context_mixing import GATES, LEVELS, PAGE, PLACES, PREDICTORS, SLOTS, Code, Learner, Mixer, tokens
from lodestone.llm.shingles import word_hashes

FREQUENT, DICTIONARY, LEAST_COUNT = 1 << 19, 1 << 18, 3
#: Words that a task counts before it passes the counts on.
HELD = 400_000
#: Bytes that a task counts in 32 bits before it passes the counts on.
FULL = 1 << 30
#: Rows of a batch that are scored or learned together.
ROWS = 512
#: Partitions whose counts are added up together, and the training tokens beyond which those sums are added up in a step of their own.
ADDED, MANY = 512, 1 << 33
_PARTS = "salt int, page int, at binary, small binary, large binary, over binary, learner array<double>"


def _tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), b""]


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; the end token's is 0."""
    out = np.zeros(len(words), np.uint64)
    full = [k for k, w in enumerate(words) if w]
    out[full] = word_hashes([words[k] for k in full])[0] if full else []
    return out


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text."""
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, c (training tokens); words of held-out documents alone have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, Counter] = {}

        def flush() -> pa.RecordBatch:
            words = [w for c in kept.values() for w in c]
            counts = [0 if held else n for held, c in kept.items() for n in c.values()]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for held, text in zip(batch["held_out"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                kept.setdefault(held, Counter()).update(_tokens(text))
            if sum(map(len, kept.values())) > HELD:
                yield flush()
        yield flush()

    return rows.select("held_out", "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield [t or b"" for t in batch["text"].slice(at, ROWS).cast(pa.binary()).to_pylist()]


def _part(salt: int, pages: list[int], fields: list[list[bytes]], learner: list[float] | None = None) -> pa.RecordBatch:
    own = pa.array([learner] * len(pages), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([salt] * len(pages), pa.int32()), pa.array(pages, pa.int32()), *[pa.array(x, pa.binary()) for x in fields], own], names=[c.split()[0] for c in _PARTS.split(", ")])


def _packed(salt: int, table: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """The pages of counts that have any: places, counts up to 254 as bytes, and the places and values of larger ones."""
    pages, fields = [], [[], [], [], []]
    for page in np.flatnonzero(table.reshape(-1, PAGE * 2).any(1)).tolist():
        part = table[page * PAGE : (page + 1) * PAGE]
        at = np.flatnonzero(part.any(1))
        own = part[at].ravel()
        over = np.flatnonzero(own > 254)
        pages.append(first + page)
        row = (at.astype("<u2"), np.where(own > 254, 0, own).astype("u1"), over.astype("<u2"), own[over].astype("<i8"))
        for field, x in zip(fields, row, strict=True):
            field.append(x.tobytes())
    return _part(salt, pages, fields)


def _summed(parts: pa.Table) -> np.ndarray:
    """The sum of a page's parts, exact."""
    total = np.zeros((PAGE, 2), np.int64)
    for at, small, large, over in zip(*[parts[c].to_pylist() for c in ("at", "small", "large", "over")], strict=True):
        own = np.frombuffer(small, "u1").astype(np.int64)
        own[np.frombuffer(large, "<u2")] = np.frombuffer(over, "<i8")
        total[np.frombuffer(at, "<u2")] += own.reshape(-1, 2)
    return total


def _train(rows: DataFrame, code: Code, many: bool) -> Mixer:
    """rows: the training documents' text. One online pass; the tasks' counts are summed by pages, their weights averaged."""
    from pyspark import TaskContext

    sent = rows.sparkSession.sparkContext.broadcast(code)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, salt = np.zeros((SLOTS, 2), np.uint32), 0, TaskContext.get().partitionId() // ADDED
        learner = Learner(table)
        for texts in _texts(batches):
            learner.learn(sent.value, texts)
            size += sum(map(len, texts)) + len(texts)
            if size > FULL:
                yield _packed(salt, table)
                table[:], size = 0, 0
        if not learner.mass:
            return
        yield _packed(salt, table)
        # page -1: the learner, its weights by the bits that it has seen
        own = np.concatenate([(learner.weights * learner.mass).ravel(), learner.hits, learner.total, [learner.mass]])
        yield _part(salt, [-1], [[b""]] * 4, own.tolist())

    def add_some(key: tuple, parts: pa.Table) -> pa.Table:
        salt, page = (k.as_py() for k in key)
        if page >= 0:
            return pa.Table.from_batches([_packed(salt, _summed(parts), page)])
        return pa.Table.from_batches([_part(salt, [-1], [[b""]] * 4, np.sum(np.array(parts["learner"].to_pylist()), 0).tolist())])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        page = key[0].as_py()
        total = _summed(parts).astype(np.float32) if page >= 0 else np.sum(np.array(parts["learner"].to_pylist()), 0)
        return pa.table({"page": pa.array([page], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    learned = rows.select("text").mapInArrow(learn, _PARTS)
    if many:
        learned = learned.groupBy("salt", "page").applyInArrow(add_some, _PARTS)
    counts, fresh = np.zeros((SLOTS, 2), np.float32), Learner(np.zeros((1, 2), np.float32))
    weights, hits, total = fresh.weights, fresh.hits, fresh.total
    for row in learned.groupBy("page").applyInArrow(add, "page int, sums binary").toLocalIterator():  # SLOTS / PAGE pages and the learners' sums
        if row["page"] >= 0:
            counts[row["page"] * PAGE : (row["page"] + 1) * PAGE] = np.frombuffer(row["sums"], np.float32).reshape(-1, 2)
        else:
            weights, hits, total, mass = np.split(np.frombuffer(row["sums"]), np.cumsum([GATES * PREDICTORS, PLACES * LEVELS, PLACES * LEVELS]))
            weights = weights.reshape(GATES, PREDICTORS) / mass[0]
    return Mixer(code, counts, weights, hits, total)


def _hashed(words: DataFrame) -> DataFrame:
    """hash, c, and the word where it may come into the dictionary."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(_hashes(batch["word"].to_pylist()).view(np.int64))], names=["word", "c", "hash"])

    own = words.select("word", "c").mapInArrow(hashes, "word binary, c long, hash long")
    return own.select("hash", "c", F.when(F.col("c") >= LEAST_COUNT, F.col("word")).alias("word"))


def _most_frequent(types: DataFrame, most: int, least_count: int) -> tuple[DataFrame, Column]:
    """The types of at least this count, at most as many as asked for (whole bands of counts, from the top), and what tells them."""
    band = F.floor(F.log2("c") * 8).cast("int")
    some = types.where(F.col("c") >= least_count)
    least, seen = 1 << 30, 0
    for row in some.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():  # 512 bands at most
        seen += row["count"]
        if seen > most:
            break
        least = row["band"]
    return some.where(band >= least), (F.col("c") >= least_count) & (band >= least)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    rows = _prepared(docs)
    types = cut(_hashed(_word_counts(rows)), "lm-types")
    is_end = F.col("hash") == 0
    sizes = types.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum(F.when(is_end, F.col("c"))).alias("ends")).first()
    n, v, ends = (sizes[k] or 0 for k in ("n", "v", "ends"))

    chosen, _ = _most_frequent(types.where(~is_end), DICTIONARY, LEAST_COUNT)
    top = chosen.orderBy("word").toArrow()  # DICTIONARY rows at most
    held = top["c"].to_numpy()
    code = Code(top["word"].to_pylist(), top["hash"].to_numpy().view(np.uint64), held, ends, n - ends - int(held.sum()))
    mixer = _train(rows.where("not held_out"), code, n > MANY)

    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    valued = types.select("hash", "c", base.alias("base"))
    chosen, often = _most_frequent(valued, FREQUENT, 1)
    top = chosen.toArrow()  # FREQUENT rows at most
    order = np.argsort(top["hash"].to_numpy())
    own_values = np.log10((np.append(code.counts, ends) + 1) / (n + v + 1))  # the dictionary's and the end's
    sent = spark.sparkContext.broadcast((top["hash"].to_numpy()[order], top["base"].to_numpy()[order], own_values))
    model = spark.sparkContext.broadcast(mixer)
    del top, order, held, mixer, code

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, values, own_values), mixer = sent.value, model.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
                n = len(texts)
                scores, base, count, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                rest, rest_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for t in tokens(mixer.code, texts):
                    scores += mixer.score(t, n)
                    hashes = t.hashes.view(np.int64)
                    found = t.symbol <= len(mixer.code.hashes)
                    value = own_values[np.minimum(t.symbol, len(mixer.code.hashes))]
                    other = np.flatnonzero(~found)
                    place = np.minimum(np.searchsorted(keys, hashes[other]), max(0, len(keys) - 1))
                    there = keys[place] == hashes[other] if len(keys) else np.zeros(len(other), bool)
                    found[other], value[other[there]] = there, values[place[there]]
                    found &= ~t.end | (ends > 0)
                    base += np.bincount(t.owner[found], value[found], n)
                    known += np.bincount(t.owner[found], minlength=n)
                    count += np.bincount(t.owner, minlength=n)
                    rest.append(hashes[~found])
                    rest_of.append(t.owner[~found])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(rest_of), minlength=n))))
                others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rest)))
                columns = [part["doc_id"], part["held_out"], pa.array([len(t) for t in texts], pa.int64()), *[pa.array(x) for x in (count, known, base, scores)], others]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, rest array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = scored.select("row", F.explode("rest").alias("hash")).join(valued.where(~often), "hash")
    rare = rare.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.sum("base").alias("more_base"))
    whole = scored.drop("rest").join(rare, "row", "left")
    known_tokens = (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known")
    base_score = (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score")
    bits = (-F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")
    return whole.select("doc_id", "held_out", "n_tokens", known_tokens, F.lit(n).cast("long").alias("train_tokens"), base_score, "score", bits)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
