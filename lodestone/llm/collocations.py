"""Phrase collocation mining (operator 11): SPAM-style position bitmaps over shards of the corpus.

1. Each task packs its documents, by lang, into shards of SHARD_WORDS words: positions with a gap after each piece. A shard is a
   row of numbered words with its vocabulary and counts; no text is shuffled.
2. Shards send their words with counts, packed by hash ranges. A range sums them; words that occur LEAST times in their lang get a
   number of their own, which goes back to the shards that hold them. Others can't be in a candidate and become gaps.
3. In a shard each word has a compressed bitmap of its positions (blocks of 64 positions that aren't empty). A phrase's bitmap,
   shifted by one position, AND the bitmaps of the words in the same blocks gives the phrases with one word more; popcounts give
   how often they occur. Gaps hold the pieces apart. Branches are extended depth-first, CHUNK bitmap blocks at a time, so memory
   doesn't grow with the number of phrases; a branch's parts are counted apart.
4. Popcounts are summed over the shards, by ranges again: first of pairs of words; the frequent ones go back to the shards that
   hold them, which extend these alone to phrases of 3 to LONGEST words (a candidate's pairs are all frequent). Keys are numbers of
   words, not hashes, so that sums are exact.
5. Cuts, the drop of phrases within longer ones, and ranks are joins and windows over the candidates. Products are decimals of 38
   digits: exact for up to 1e17 words a lang.

Defined results: null text: empty; null lang: `und`. Every row counts, whatever its doc_id. Of a phrase, overlapping occurrences
count. Langs without candidates and empty tables give no rows. Columns other than text and lang are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, cut, groups_for, scratch, table
from lodestone.llm.shingles import mix

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a shard and, about, of those whose phrases a range sums; bitmap blocks that are extended at once.
SHARD_WORDS, RANGE_WORDS, CHUNK = 1 << 20, 1 << 21, 1 << 15
_FOLD = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
SHARDS = "shard long, lang string, words binary, vocabulary array<string>, counts array<long>"


def _pack(x: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane, so that compression drops the empty planes."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered words of a task's documents, 0 between pieces, in shards by lang."""
    open_: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
    size: dict[str, int] = {}
    task, made = TaskContext.get().partitionId() << 24, 0

    def row(lang: str) -> pa.RecordBatch:
        nonlocal made
        own, parts = open_.pop(lang)
        ids = np.concatenate(parts)
        made += 1
        counts = np.bincount(ids, minlength=len(own))[2:]
        columns = [pa.array([task + made]), pa.array([lang]), pa.array([_pack(np.maximum(ids - 1, 0))], pa.binary()), pa.array([[w.decode() for w in list(own)[2:]]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARDS.split(", ")])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            own, parts = open_.setdefault(lang, ({b"": 0, b"\n": 1}, []))
            tokens = (text.as_py().translate(_FOLD).replace(b"\n", b" \n ") + b" \n").split(b" ")
            ids = np.fromiter((own.setdefault(w, len(own)) for w in tokens), np.int32, len(tokens))
            parts.append(ids[ids > 0])
            size[lang] = size.get(lang, 0) + len(parts[-1])
            if size[lang] >= SHARD_WORDS:
                size[lang] = 0
                yield row(lang)
    for lang in list(open_):
        yield row(lang)


def _ranges(hashes: np.ndarray, ranges: int) -> list[np.ndarray]:
    """The places of each range's keys, in their order."""
    of = (mix(hashes) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, ranges)))


def _sent_words(ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, words, counts in zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("vocabulary"), batch.column("counts"), strict=True):
                hashes = np.fromiter((zlib.crc32(w.encode()) for w in words.values.to_pylist()), np.uint64, len(words.values))
                for r, place in enumerate(_ranges(hashes, ranges)):
                    if len(place):
                        at, ends = pa.array(place), pa.array([0, len(place)], pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(place.astype(np.int32)), words.values.take(at), counts.values.take(at))]
                        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([r]), pa.array([lang]), *lists], names=["shard", "range", "lang", "place", "words", "counts"])

    return send


def _numbered(ranges: int):
    def answer(key: tuple, sent: pa.Table) -> pa.Table:
        """For each shard the numbers of its frequent words; as shard -1 these words themselves."""
        total: Counter[tuple[str, str]] = Counter()
        rows = sent.select(["shard", "lang", "place", "words", "counts"]).to_pylist()
        for row in rows:
            for w, n in zip(row["words"], row["counts"], strict=True):
                total[row["lang"], w] += n
        often = sorted(k for k, n in total.items() if n >= LEAST)
        number = {k: 1 + at * ranges + key[0].as_py() for at, k in enumerate(often)}
        known = [[(p, number[row["lang"], w]) for p, w in zip(row["place"], row["words"], strict=True) if (row["lang"], w) in number] for row in rows]
        table = {"shard": [row["shard"] for row in rows] + [-1], "place": [[p for p, _ in k] for k in known] + [None], "ids": [[i for _, i in k] for k in known] + [[number[k] for k in often]], "langs": [None] * len(rows) + [[k[0] for k in often]], "words": [None] * len(rows) + [[k[1] for k in often]], "counts": [None] * len(rows) + [[total[k] for k in often]]}
        return pa.table(table, schema=pa.schema([("shard", pa.int64()), ("place", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    return answer


def _recode(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
    """Frequent words' numbers in place of a shard's own."""
    own = _unpack(shard["words"][0].as_py())
    number = np.zeros(int(own.max(initial=0)) + 1, np.int64)
    for place, ids in zip(answers["place"], answers["ids"], strict=True):
        number[np.array(place.values) + 1] = np.array(ids.values)
    return pa.table({"shard": shard["shard"], "codes": pa.array([_pack(number[own])], pa.binary())})


class Bitmaps:
    """Compressed position bitmaps of a shard's words, and their extension by one word."""

    def __init__(self, codes: np.ndarray) -> None:
        place = np.flatnonzero(codes)
        self.number, word = np.unique(codes[place], return_inverse=True)
        order = np.argsort(word, kind="stable")
        word, block, bit = word[order], place[order] >> 6, np.uint64(1) << (place[order] & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), bool), (np.diff(word) != 0) | (np.diff(block) != 0))))
        self.word, self.block = word[first], block[first]
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        by_block = np.argsort(self.block, kind="stable")
        self.word_at, self.bits_at = self.word[by_block], self.bits[by_block]
        self.begin = np.searchsorted(self.block[by_block], np.arange((len(codes) >> 6) + 3))

    def extend(self, phrases: np.ndarray, of: np.ndarray, block: np.ndarray, bits: np.ndarray, allowed: np.ndarray | None):
        """phrases: a row of words each; their bitmaps as (phrase, block, bits). The same of the phrases with one word more, and their counts."""
        carried = np.flatnonzero(bits >> np.uint64(63))
        of, block = np.concatenate((of, of[carried])), np.concatenate((block, block[carried] + 1))
        shifted = np.concatenate((bits << np.uint64(1), np.ones(len(carried), np.uint64)))
        many = self.begin[block + 1] - self.begin[block]
        row = np.repeat(np.arange(len(of)), many)
        entry = np.arange(len(row)) + np.repeat(self.begin[block] - np.cumsum(many) + many, many)
        both = shifted[row] & self.bits_at[entry]
        hit = np.flatnonzero(both)
        row, word, both = row[hit], self.word_at[entry[hit]], both[hit]
        of, block = of[row], block[row]
        if allowed is not None:
            keys = phrases[of, -1] * len(self.number) + word
            at = np.searchsorted(allowed, keys)
            known = np.flatnonzero(allowed[np.minimum(at, len(allowed) - 1)] == keys) if len(allowed) else at[:0]
            of, word, block, both = of[known], word[known], block[known], both[known]
        order = np.lexsort((word, of))
        of, word, block, both = of[order], word[order], block[order], both[order]
        new = np.concatenate((np.ones(min(1, len(of)), bool), (np.diff(of) != 0) | (np.diff(word) != 0)))
        first = np.flatnonzero(new)
        counts = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first) if len(first) else first
        return np.column_stack((phrases[of[first]], word[first])), np.cumsum(new) - 1, block, both, counts

    def phrases(self, longest: int, allowed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of two to `longest` words (their numbers) with counts, depth-first; a phrase may come in parts."""
        stack = [(np.arange(len(self.number))[:, None], self.word, self.block, self.bits)]
        while stack:
            words, of, block, bits = stack.pop()
            if len(of) > CHUNK:
                stack.append((words, of[CHUNK:], block[CHUNK:], bits[CHUNK:]))
                of, block, bits = of[:CHUNK], block[:CHUNK], bits[:CHUNK]
            longer, of, block, bits, counts = self.extend(words, of, block, bits, allowed)
            if len(counts):
                yield self.number[longer], counts
                if longer.shape[1] < longest:
                    stack.append((longer, of, block, bits))


def _packed(phrases: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Rows of words, sorted, as differences by column where the columns before are equal, and their counts."""
    order = np.lexsort(phrases.T[::-1])
    phrases, counts = phrases[order], counts[order]
    first = np.diff(phrases[:, 0].astype(np.int64), prepend=0)
    return b"".join([_pack(first), *[_pack(phrases[:, k]) for k in range(1, phrases.shape[1])]]), _pack(counts)


def _unpacked(size: int, phrases: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns = [_unpack(phrases[k * len(counts) : (k + 1) * len(counts)]) for k in range(size)]
    return np.column_stack([np.cumsum(columns[0]), *columns[1:]]).astype(np.uint32), _unpack(counts)


def _summed(phrases: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sums of their counts."""
    order = np.lexsort(phrases.T[::-1])
    phrases, counts = phrases[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (phrases[1:] != phrases[:-1]).any(axis=1))))
    return phrases[first], np.add.reduceat(counts, first) if len(first) else counts


def _sent(shard: int, size: int, parts: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    """A shard's phrases of one size, by ranges."""
    phrases, counts = _summed(np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]))
    hashes = np.zeros(len(phrases), np.uint64)
    for k in range(size):
        hashes = mix(hashes + phrases[:, k].astype(np.uint64))
    for r, place in enumerate(_ranges(hashes, ranges)):
        if len(place):
            rows, n = _packed(phrases[place], counts[place])
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([r]), pa.array([size]), pa.array([rows], pa.binary()), pa.array([n], pa.binary())], names=["shard", "range", "size", "phrases", "counts"])


SENT = "shard long, range long, size long, phrases binary, counts binary"


def _pairs(ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, codes in zip(batch.column("shard").to_pylist(), batch.column("codes"), strict=True):
                parts = list(Bitmaps(_unpack(codes.as_py())).phrases(2))
                if parts:
                    yield from _sent(shard, 2, parts, ranges)

    return send


def _longer(ranges: int):
    def send(key: tuple, coded: pa.Table, answers: pa.Table) -> pa.Table:
        maps = Bitmaps(_unpack(coded["codes"][0].as_py()))
        pairs = np.concatenate([np.empty((0, 2), np.int64), *[_unpacked(2, x, n)[0] for x, n in zip(answers["phrases"].to_pylist(), answers["counts"].to_pylist(), strict=True)]])
        local = np.searchsorted(maps.number, pairs)
        parts: dict[int, list] = {}
        for words, n in maps.phrases(LONGEST, np.sort(local[:, 0] * len(maps.number) + local[:, 1])):
            if words.shape[1] > 2:
                parts.setdefault(words.shape[1], []).append((words, n))
        out = [row for size, own in parts.items() for row in _sent(coded["shard"][0].as_py(), size, own, ranges)]
        kinds = pa.schema([("shard", pa.int64()), ("range", pa.int64()), ("size", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])
        return pa.Table.from_batches(out, kinds)

    return send


def _frequent(back: bool):
    def answer(key: tuple, sent: pa.Table) -> pa.Table:
        """The frequent phrases of a range (shard -1: as arrays with their counts) and, if they are to go back, those of each shard."""
        made: dict[str, list] = {"shard": [], "phrases": [], "counts": [], "found": [], "a": []}
        for size in sorted(set(sent["size"].to_pylist())):
            own = sent.filter(pc.equal(sent["size"], size))
            lists = [_unpacked(size, x, n) for x, n in zip(own["phrases"].to_pylist(), own["counts"].to_pylist(), strict=True)]
            phrases, counts = _summed(np.concatenate([p for p, _ in lists]), np.concatenate([n for _, n in lists]))
            keep = counts >= LEAST
            phrases, counts = phrases[keep], counts[keep]
            made["shard"].append(-1)
            made["phrases"].append(None)
            made["counts"].append(None)
            made["found"].append(phrases.tolist())
            made["a"].append(counts.tolist())
            if back:
                joined = lambda x: x[:, 0].astype(np.uint64) << np.uint64(32) | x[:, 1]
                known = joined(phrases)
                for shard, (rows, n) in zip(own["shard"].to_pylist(), lists, strict=True):
                    held = np.isin(joined(rows), known)
                    if held.any():
                        x, y = _packed(rows[held], n[held])
                        for name, value in zip(made, (shard, x, y, None, None), strict=True):
                            made[name].append(value)
        return pa.table(made, schema=pa.schema([("shard", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary()), ("found", pa.list_(pa.list_(pa.int64()))), ("a", pa.list_(pa.int64()))]))

    return answer


ANSWER = "shard long, phrases binary, counts binary, found array<array<long>>, a array<long>"


def phrase_counts(docs: DataFrame, own_cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (phrase: the words' numbers, a), frequent words (lang, word, n, id), words by lang (lang, n)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = own_cut(rows.mapInArrow(_shards, SHARDS), "shards")
    told = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n).alias("n"))
    totals = own_cut(told.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ranges = groups_for(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], RANGE_WORDS, 16)
    sent = shards.select("shard", "lang", "vocabulary", "counts").mapInArrow(_sent_words(ranges), "shard long, range long, lang string, place array<int>, words array<string>, counts array<long>")
    numbered = own_cut(sent.groupBy("range").applyInArrow(_numbered(ranges), "shard long, place array<int>, ids array<long>, langs array<string>, words array<string>, counts array<long>"), "numbered")
    words = numbered.where("shard < 0").select(F.explode(F.arrays_zip("langs", "words", "counts", "ids")).alias("w")).select(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.ids").alias("id"))
    words = own_cut(words, "words")
    answers = numbered.where("shard >= 0 AND size(ids) > 0").select(F.col("shard").alias("to"), "place", "ids")
    coded = own_cut(shards.select("shard", "words").join(answers.select(F.col("to").alias("shard")).distinct(), "shard", "left_semi").groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(_recode, "shard long, codes binary"), "coded")
    pairs = own_cut(coded.mapInArrow(_pairs(ranges), SENT).groupBy("range").applyInArrow(_frequent(True), ANSWER), "pairs")
    answers = pairs.where("shard >= 0").select(F.col("shard").alias("to"), "phrases", "counts")
    held = coded.join(answers.select(F.col("to").alias("shard")).distinct(), "shard", "left_semi")
    longer = held.groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(_longer(ranges), SENT)
    longer = own_cut(longer.groupBy("range").applyInArrow(_frequent(False), ANSWER), "longer")
    found = pairs.where("shard < 0").select("found", "a").union(longer.select("found", "a"))
    return own_cut(found.select(F.explode(F.arrays_zip("found", "a")).alias("p")).select(F.col("p.found").alias("phrase"), F.col("p.a").alias("a")), "candidates"), words, totals


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first `top` phrases."""
    with scratch(docs.sparkSession) as own_cut:
        found, words, totals = phrase_counts(docs, own_cut)
        every = found.union(words.select(F.array("id").alias("phrase"), F.col("n").alias("a")))
        size = F.size("phrase")
        within = found.where(size > 2).select("a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("phrase", i, k))))).alias("phrase"))
        held = within.groupBy("phrase").agg(F.max("a").alias("longer"))
        kept = found.join(held, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
        named = words.select(F.col("id").alias("head"), "lang")
        kept = kept.withColumn("head", F.get("phrase", F.lit(0))).join(named, "head").join(totals, "lang").select("lang", "phrase", "a", "n")
        cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        part = lambda name, count, at, length: (every.select(F.col("phrase").alias(name), F.col("a").alias(count)), F.slice("phrase", at, length).alias(name))
        (first, first_key), (rest, rest_key) = part("first", "l", F.lit(1), F.col("k")), part("rest", "r", F.col("k") + 1, size - F.col("k"))
        cuts = cuts.select("*", first_key, rest_key).join(first, "first").join(rest, "rest")
        score = F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(38,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
        best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        best = best.select("lang", "phrase", "a", "n", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
        order = [F.desc("score"), F.desc("a")]
        best = own_cut(best.withColumn("upper", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("upper") <= top).drop("upper"), "best")
        spelt = best.select("phrase", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
        spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("text"))
        named = best.join(spelt, "phrase").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text")).cast("long"))
        return cut(named.where(F.col("rank") <= top).select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score"), "collocations")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), told AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM told
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), found AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k >= 2 AND f >= 100
), inner_starts AS (
  SELECT lang, w, k, a, unnest(range(1, k)) AS i FROM found WHERE k > 2
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM inner_starts, (SELECT unnest(range(2, 5)) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT f.* FROM found f LEFT JOIN held h ON f.lang = h.lang AND f.phrase = h.phrase WHERE h.longer IS NULL OR 100 * h.longer < 100 * f.a
), cut_at AS (
  SELECT *, unnest(range(1, k)) AS c FROM kept
), cuts AS (
  SELECT p.lang, p.phrase, p.a, x.f AS l, y.f AS r, t.n, p.c, (1000::HUGEINT * p.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut_at p JOIN totals t ON t.lang = p.lang
  JOIN grams x ON x.lang = p.lang AND x.k = p.c AND x.phrase = array_to_string(p.w[1:p.c], ' ')
  JOIN grams y ON y.lang = p.lang AND y.k = p.k - p.c AND y.phrase = array_to_string(p.w[p.c + 1:p.k], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
