"""Mixing sources to target weights (operator 7): weighted fair queueing over shuffled documents.

Within its source each document has a place in a shuffle (md5 of the doc_id). Pass e over a source of S words with the
target T gives a document the virtual finish time (e * S + running words) / T. The mix is all passes' documents in order of
finish time, cut off where the running words reach the budget, the words of all documents.

Running sums don't need a source, or the mix, in one task: a source's shuffle is cut into slices by the leading bits of the
md5, finish times into bins; sums of slices and bins are added up first, then those within one slice or bin.

Defined results: null text has size 0, a document of size 0 is never taken but kept where its place is before the cut; the
source null is a source of its own, the last; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table, word_count

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Hexadecimal digits of the md5 that make a slice, and bins of finish time per unit: slices and bins for billions of documents.
SLICE_DIGITS, BINS = 3, 4096

UNTIL = (Window.unboundedPreceding, Window.currentRow)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, size) -> source_key, source_size, target, for as many rows as there are sources.

    target = min(3 * size, level * weight) with the level at which the targets add up to all sizes: what repeated
    resharing of the excess by weight comes to.
    """
    total = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, WEIGHTS))
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    rows = total.withColumn("weight", F.get(weights, rank % len(WEIGHTS)))
    # sources in the order in which a rising level fills them; before: what fuller ones take, and the weight of the rest
    rows = rows.withColumn("full", F.col("source_size") * MOST_PASSES / F.col("weight"))
    order = Window.orderBy("full", "source_key")
    taken = F.sum(F.col("source_size") * MOST_PASSES).over(order.rowsBetween(*UNTIL)) - F.col("source_size") * MOST_PASSES
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (every - taken) / open_weight)
    # the first source that its level does not fill sets it for all; later ones give lower levels
    level = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(Window.partitionBy())
    rows = rows.withColumn("at", level)
    target = F.least(F.col("source_size") * F.lit(float(MOST_PASSES)), F.col("at") * F.col("weight"))
    return rows.select("source_key", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    """A key that isn't null and sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns keep, so that none can clash), source_key, size, place and slice of each row, and its doc_id as id."""
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _key(F.col("source").cast("string")).alias("source_key"), word_count(F.col("text")).alias("size"), place.alias("place"), F.col("doc_id").alias("id"))
    return rows.withColumn("slice", F.substring("place", 1, SLICE_DIGITS))


def _placed(sized: DataFrame, slices: DataFrame) -> DataFrame:
    """Adds passes: for each pass the struct (finish, place, pass) by which the mix is ordered."""
    inner = Window.partitionBy("source_key", "slice").orderBy("place", "id", "size").rowsBetween(*UNTIL)
    rows = sized.withColumn("inside", F.sum("size").over(inner)).join(slices, ["source_key", "slice"])
    running, target = F.col("before") + F.col("inside"), F.col("target")
    finish = lambda e: F.when(target > 0, (F.lit(e) * F.col("source_size") + running) / target).otherwise(F.lit(2.0 * e))
    return rows.withColumn("passes", F.array(*[F.struct(finish(e).alias("finish"), F.col("place"), F.lit(e).alias("pass")) for e in range(MOST_PASSES)]))


def mix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of the columns keep of docs), size, source_size, target, and copies: how often the mix takes the row."""
    base = cut(_sized(docs, ["doc_id"]), "mix-sizes")
    targets = source_targets(base.select("source_key", "size"))
    slices = base.groupBy("source_key", "slice").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("source_key").orderBy("slice").rowsBetween(*UNTIL)  # as many slices as SLICE_DIGITS give
    slices = slices.withColumn("before", F.sum("words").over(by_source) - F.col("words")).join(targets, "source_key").drop("words")
    slices = cut(slices, "mix-slices")

    # the cut: first the bin in which the running words pass the budget, then the row in that bin
    budget = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    passes = _placed(base, slices).select("size", F.explode("passes").alias("at")).withColumn("bin", F.floor(F.least(F.col("at.finish"), F.lit(2.0)) * BINS))
    bins = passes.groupBy("bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("bin").rowsBetween(*UNTIL))
    found = bins.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("bin").first()
    first_left = None
    if found:
        inside = F.sum("size").over(Window.orderBy("at").rowsBetween(*UNTIL)) + (found["upto"] - found["words"])
        first_left = passes.where(F.col("bin") == found["bin"]).withColumn("upto", inside).where(F.col("upto") > budget).orderBy("at").first()
    rows = _placed(base if keep == ["doc_id"] else _sized(docs, keep), slices)
    if first_left:
        at = first_left["at"]
        end = F.struct(F.lit(at["finish"]).alias("finish"), F.lit(at["place"]).alias("place"), F.lit(at["pass"]).alias("pass"))
        copies = F.size(F.filter("passes", lambda p: p < end))
    else:
        copies = F.lit(MOST_PASSES)
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    rows = mix(docs, docs.columns).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
total AS (SELECT k, CAST(sum(size) AS BIGINT) AS s, list_value(5, 2, 1)[(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w FROM sized GROUP BY k),
filled AS (
  SELECT *, (CAST(sum(s) OVER () AS BIGINT) - CAST(sum(3 * s) OVER (ORDER BY 3 * s / w, k ROWS UNBOUNDED PRECEDING) - 3 * s AS BIGINT))
    / CAST(sum(w) OVER (ORDER BY 3 * s / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM total),
target AS (SELECT k, s, least(3.0::DOUBLE * s, (SELECT max(level) FROM filled WHERE level <= 3 * s / w) * w) AS t FROM filled),
running AS (
  SELECT doc_id, size, place, s, t, CAST(sum(size) OVER (PARTITION BY k ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r
  FROM sized JOIN target USING (k)),
passes AS (SELECT *, CASE WHEN t > 0 THEN (e * s + r) / t ELSE 2.0 * e END AS finish FROM running, (SELECT unnest([0, 1, 2]) AS e)),
mixed AS (SELECT *, sum(size) OVER (ORDER BY finish, place, e ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () / 3 AS budget FROM passes),
ranked AS (SELECT *, row_number() OVER (ORDER BY finish, place, e) AS n FROM mixed),
cut AS (SELECT coalesce(min(n), 9223372036854775807) AS n FROM ranked WHERE upto > budget)
SELECT doc_id, size, s AS source_size, t AS target, CAST(sum(CASE WHEN ranked.n < cut.n THEN size ELSE 0 END) AS BIGINT) AS taken
FROM ranked, cut GROUP BY doc_id, size, place, s, t
"""
