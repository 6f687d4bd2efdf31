"""Statistics of labelled documents, and the corpus labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.statistics import gini_splits, mann_whitney, two_by_two, two_sided, unpivot
from lodestone.plans.base import query
from lodestone.sources import bindings as b

LABELLED_SQL = r"SELECT l.doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS label, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_blanks, CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS n_stops FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
LONG_SQL = f"SELECT unnest(['n_blanks', 'n_chars', 'n_stops']) AS feature, unnest([n_blanks, n_chars, n_stops]) AS value, label FROM ({LABELLED_SQL})"
BINARY_SQL = f"SELECT unnest(['long', 'many_stops']) AS feature, unnest([CAST(n_chars > 1000 AS INTEGER), CAST(n_stops > 20 AS INTEGER)]) AS value, label FROM ({LABELLED_SQL})"


def labelled(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("n_blanks"), (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).alias("n_stops"))
    return b.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("label")).join(docs, "doc_id")


def features(spark, d):
    return unpivot(labelled(spark, d), ["n_chars", "n_blanks", "n_stops"], "label")


MW_SQL = f"""WITH v AS ({LONG_SQL}), c AS (SELECT feature, value, count(*) AS n, sum(label) AS n1 FROM v GROUP BY 1, 2),
  r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM c),
  s AS (SELECT feature, sum(rank * n1) AS r1, sum(n1) AS n1, sum(n - n1) AS n2 FROM r GROUP BY 1), u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u FROM s)"""


@query(MW_SQL + " SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(u AS DOUBLE) AS u, round(abs(u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z, round(1 - 2 * u / (n1 * n2), 6) AS effect FROM u", name="mann_whitney")
def mann_whitney_test(spark, d):
    rows = mann_whitney(features(spark, d))
    return rows.select("feature", "n1", "n2", "u", F.round("z", 6).alias("z"), F.round("effect", 6).alias("effect"))


@query()
def mann_whitney_p(spark, d):
    rows = mann_whitney(features(spark, d))
    return rows.select("feature", F.round(two_sided(F.col("z")), 8).alias("p"))


@query(f"""WITH t AS (SELECT feature, count(*) FILTER (value = 1 AND label = 1) AS a, count(*) FILTER (value = 0 AND label = 1) AS b, count(*) FILTER (value = 1 AND label = 0) AS c, count(*) FILTER (value = 0 AND label = 0) AS d FROM ({BINARY_SQL}) GROUP BY 1),
    e AS (SELECT *, (a + b) * (a + c) / (a + b + c + d) AS ea, (a + b) * (b + d) / (a + b + c + d) AS eb, (c + d) * (a + c) / (a + b + c + d) AS ec, (c + d) * (b + d) / (a + b + c + d) AS ed FROM t)
    SELECT feature, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(pow(abs(a - ea) - 0.5, 2) / ea + pow(abs(b - eb) - 0.5, 2) / eb + pow(abs(c - ec) - 0.5, 2) / ec + pow(abs(d - ed) - 0.5, 2) / ed, 6) AS chi2,
      CASE WHEN b * c = 0 THEN CASE WHEN a * d > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE round(a * d / (b * c), 2) END AS odds FROM e""")
def fisher_approx(spark, d):
    rows = labelled(spark, d).select("label", (F.col("n_chars") > 1000).cast("int").alias("long"), (F.col("n_stops") > 20).cast("int").alias("many_stops"))
    return two_by_two(unpivot(rows, ["long", "many_stops"], "label")).withColumn("chi2", F.round("chi2", 6))


@query(f"""WITH c AS (SELECT feature, value, count(*) AS n, sum(label) AS k FROM ({LONG_SQL}) GROUP BY 1, 2),
    w AS (SELECT feature, value, lead(value) OVER o AS nxt, sum(n) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS nl, sum(k) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS kl, sum(n) OVER (PARTITION BY feature) AS nt, sum(k) OVER (PARTITION BY feature) AS kt FROM c WINDOW o AS (PARTITION BY feature ORDER BY value)),
    g AS (SELECT feature, (value + nxt) / 2 AS threshold, round(2 * (kt / nt) * (1 - kt / nt) - nl / nt * (2 * (kl / nl) * (1 - kl / nl)) - (nt - nl) / nt * (2 * ((kt - kl) / (nt - nl)) * (1 - (kt - kl) / (nt - nl))), 10) AS gain FROM w WHERE nxt IS NOT NULL),
    b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1) SELECT feature, threshold, round(gain, 8) AS gain, round(gain / sum(gain) OVER (), 6) AS importance FROM b""")
def gini_split(spark, d):
    return gini_splits(features(spark, d)).withColumn("gain", F.round("gain", 8))


@query()
def random_forest(spark, d):
    """Stratified by hash: a forest trained on four fifths, its hits on the rest by label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled(spark, d).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    rows = VectorAssembler(inputCols=["n_chars", "n_blanks", "n_stops"], outputCol="features").transform(rows)
    balance = rows.groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    rows = rows.join(F.broadcast(balance), "label").withColumn("label", F.col("label").cast("double"))
    model = RandomForestClassifier(numTrees=100, maxDepth=10, minInstancesPerNode=5, seed=42, weightCol="weight").fit(rows.where("fold <> 0"))
    judged = model.transform(rows.where("fold = 0"))
    return judged.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("long")).alias("right"))
