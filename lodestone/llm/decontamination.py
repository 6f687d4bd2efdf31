"""Benchmark decontamination (operator 1): spaced-seed hashing.

A mask selects 8 of 12 neighbouring tokens; two windows that agree there have the same hash whatever stands at the other
places. All windows of the documents are joined with those of the benchmark under each mask. A hit gives a diagonal (place
in the document less place in the item), along which the item is laid over the document: a matching token counts 1, another
one -1, and the best stretch must come to LEAST. So whole passages are found with single tokens replaced, and phrases of a
few words aren't. Items of SHORTEST to 11 words have no such window: they are found where all their words stand in a row,
by the hash of the whole item.

The benchmark's hashes are broadcast while its texts are within BROADCAST_BYTES; beyond that the same join is shuffled.
Equal texts are judged once. A text's hits are taken together by regions of REGION words, each with the words that the item
would cover and no others, so that neither a long text nor a repetitive one gathers more than a region's hits in one row.

Defined results: null texts, texts under SHORTEST words and items under SHORTEST words hit nothing; items that repeat give a
row each; rows of documents that repeat a doc_id count as one document, as do all rows without one (their doc_id is null in
the result); items without item_id are left out; an empty table on either side gives no rows. Other columns are ignored.
decontaminate() judges each row by its own text, whatever its doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, cut, free_name, scratch, table, text_bytes, words

MASKS = ("110101100111", "101110011011")
SPAN, LEAST, SHORTEST = 12, 10, 5
BROADCAST_BYTES = 32 << 20
REGION = 1 << 16


def _tokens() -> Column:
    return words(ascii_lower(F.col("text")))


def _key() -> Column:
    """Of a row's text: equal texts have equal keys."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _hashed(rows: DataFrame, key: str, short: list[int], items: bool) -> DataFrame:
    """key, hash, at, n (of tokens): one row per window and mask, with the window's place, and for the sizes short one per row of as many tokens.

    The places are exploded beside the token array, so that the hashes are compiled code and no array is copied.
    """
    least = min([SPAN, *short])
    tokens = rows.select(key, _tokens().alias("tokens")).where(F.size("tokens") >= least)
    n, at = F.size("tokens"), F.col("at")
    places = tokens.select(key, "tokens", F.explode(F.sequence(F.lit(0), n - least)).alias("at"))
    masked = [F.xxhash64(F.lit(k), *[F.get("tokens", at + j) for j, on in enumerate(mask) if on == "1"]) for k, mask in enumerate(MASKS)]
    if short:
        masked = [F.when(at + SPAN <= n, h) for h in masked]
        for size in short:  # an item's own size alone; a document's windows of that size
            masked.append(F.when((n == size) & (at == 0) if items else at + size <= n, F.xxhash64(F.lit(100 + size), *[F.get("tokens", at + j) for j in range(size)])))
    found = places.select(key, "at", n.alias("n"), F.stack(F.lit(len(masked)), *masked).alias("hash"))
    return found.where("hash is not null") if short else found


def _stretch(tokens: Column, item: Column, shift: Column) -> Column:
    """The best stretch of the item laid over the tokens: score, first and last place in the item, matches."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("first"), F.lit(0).alias("same"), F.lit(0).alias("best"), F.lit(0).alias("best_first"), F.lit(-1).alias("best_last"), F.lit(0).alias("best_same"))

    def step(s: Column, i: Column) -> Column:
        same = F.coalesce(F.when(i + shift >= 0, F.get(tokens, i + shift) == F.get(item, i)), F.lit(False)).cast("int")
        fresh = s["score"] <= 0
        score = F.when(fresh, 0).otherwise(s["score"]) + 2 * same - 1
        first, matches = F.when(fresh, i).otherwise(s["first"]), F.when(fresh, 0).otherwise(s["same"]) + same
        better = score > s["best"]
        pick = lambda new, old: F.when(better, new).otherwise(s[old])
        return F.struct(score.alias("score"), first.alias("first"), matches.alias("same"), pick(score, "best").alias("best"), pick(first, "best_first").alias("best_first"), pick(i, "best_last").alias("best_last"), pick(matches, "best_same").alias("best_same"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step)


def leaked_texts(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, text) -> key, item_id, matched, length, doc_start, for the keys whose text holds a passage of the benchmark."""
    spark = texts.sparkSession
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    small = text_bytes(items) <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda df: df
    told = items.select("item_id", _tokens().alias("item"))
    sizes = told.select(F.size("item").alias("n")).where(F.col("n").between(SHORTEST, SPAN - 1)).distinct().collect()  # 7 sizes at most
    short = sorted(r["n"] for r in sizes)
    with scratch(spark) as own_cut:
        seeds = _hashed(items, "item_id", short, True).withColumnsRenamed({"at": "item_at", "n": "item_n"})
        hits = _hashed(texts, "key", short, False).drop("n").join(sent(seeds), "hash")
        hits = own_cut(hits.select("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_n").distinct(), "seed-hits")
        # the words that each hit's item would cover, once for each text and region
        by_region = hits.groupBy("key", F.floor(F.col("shift") / REGION).alias("region")).agg(F.collect_list(F.struct("item_id", "shift", "item_n")).alias("hits"))
        held = texts.join(hits.select("key").distinct().hint("rebalance"), "key", "left_semi").dropDuplicates(["key"]).select("key", _tokens().alias("tokens"))
        from_ = lambda h: F.greatest(h["shift"], F.lit(0))
        covered = F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["shift"].alias("shift"), F.slice("tokens", from_(h) + 1, h["shift"] + h["item_n"] - from_(h)).alias("part")))
        laid = by_region.join(held, "key").select("key", F.inline(covered)).join(sent(told), "item_id")
        laid = laid.select("key", "item_id", "shift", F.size("item").alias("n"), _stretch(F.col("part"), F.col("item"), F.least("shift", F.lit(0))).alias("s"))
        laid = laid.where(F.col("s.best") >= F.least(F.lit(LEAST), F.col("n")))
        best = laid.groupBy("key", "item_id").agg(_best(F.col("s.best_same"), F.col("s.best_last") - F.col("s.best_first") + 1, F.col("shift") + F.col("s.best_first")))
        return cut(best.select("key", "item_id", "m.*"), "leaks")


def _best(matched: Column, length: Column, doc_start: Column) -> Column:
    """m: the stretch of the most matches, then the longest, then the first."""
    m = F.max(F.struct(matched.alias("matched"), length.alias("length"), (-doc_start).alias("before")))
    return F.struct(m["matched"].alias("matched"), m["length"].alias("length"), (-m["before"]).alias("doc_start")).alias("m")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (tokens), length (of the stretch), doc_start (its first word in the document)."""
    keyed = docs.select("doc_id", _key().alias("key"), F.col("text").cast("string").alias("text"))
    found = leaked_texts(keyed.select("key", "text"), benchmark)
    rows = keyed.select("doc_id", "key").join(found, "key")
    return rows.groupBy("doc_id", "item_id").agg(_best(F.col("matched"), F.col("length"), F.col("doc_start"))).select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a passage of the benchmark."""
    found = leaked_texts(docs.select(_key().alias("key"), F.col("text").cast("string").alias("text")), benchmark)
    key = free_name(docs, "key")
    leaked = found.select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, _key()).join(leaked, key, "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
