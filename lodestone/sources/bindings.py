"""The catalogue-audit relations as views over the test tables.

artist = customer, release = order, songwriter = supplier, label = brand, playlist = supplier nation, scan = order month,
API call = event. Each function takes (spark, sf_dir); SQL holds the same views for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.rules import score_label


#: Rows of a task where values are told apart or each costs much.
DEALT = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, of: DataFrame, *keys: str, size: int = DEALT) -> DataFrame:
    """rows by a hash of keys (without: in turn) in one task for every `size` rows of a table: tasks dealt by bytes alone would hold more and more rows, which compress well."""
    return rows.repartition(max(1, -(-of.count() // size)), *keys)


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    fans = F.col("c_acctbal")
    threat = F.when(fans < 0, "confirmed_bad").when(fans < 500, "suspected").when(fans > 9500, "cleared").otherwise("unknown")
    verdict = F.when(fans < 0, "Likely Artificial").when(fans < 1000, "Suspicious").when(fans < 2500, "Inconclusive").when(fans < 7500, "Likely Authentic").otherwise("Verified Artist")
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("genre"), fans.alias("fans"), threat.alias("threat_status"), verdict.alias("latest_verdict"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "album").when(F.col("o_orderstatus") == "O", "single").otherwise("ep")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("artist_id"), F.col("o_orderdate").cast("date").alias("release_date"), kind.alias("rtype"), F.col("o_totalprice").alias("track_rank"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links: every line with its artist."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist_id"))
    return rows.join(orders, "l_orderkey")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a track of its own: artist_id, release_date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist_id"), F.col("o_orderdate").cast("date").alias("release_date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, "l_orderkey").select("artist_id", "release_date")


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("artist_id", F.col("l_suppkey").alias("songwriter_id"), F.col("l_returnflag").alias("role"))
    return dealt(rows, table(spark, sf_dir, "lineitem"), "artist_id", "songwriter_id", "role").distinct()


def songwriters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("songwriter_id"), F.col("s_name").alias("songwriter"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


def artist_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label"))
    rows = lines(spark, sf_dir).join(parts, "l_partkey").select("artist_id", "label")
    return dealt(rows, table(spark, sf_dir, "lineitem"), "artist_id", "label").distinct()


def playlist_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("playlist_id"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("playlist_id"), F.col("n_name").alias("playlist"), F.col("n_regionkey").isin(0, 1).alias("editorial"))
    return lines(spark, sf_dir).join(writers, "l_suppkey").join(nations, "playlist_id").select("playlist_id", "playlist", "editorial", "artist_id").distinct()


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    scan = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000))).cast("long")
    rows = rows.select(scan.alias("scan_id"), F.col("o_custkey").alias("artist_id"), score.alias("score"), F.col("o_orderkey").alias("release_id"))
    last = F.row_number().over(Window.partitionBy("scan_id", "artist_id").orderBy(F.desc("release_id")))
    return rows.withColumn("rn", last).where("rn = 1").drop("rn").withColumn("verdict", score_label(F.col("score")))


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", 500).when(k % 10 == 0, 404).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("api_name"), "ts", F.col("value").alias("ms"), status.alias("status_code"), F.when(k % 25 == 0, "timeout").otherwise("").alias("error_message"))


_LABEL_SQL = "CASE WHEN score >= 82 THEN 'Verified Artist' WHEN score >= 58 THEN 'Likely Authentic' WHEN score >= 38 THEN 'Inconclusive' WHEN score >= 18 THEN 'Suspicious' ELSE 'Likely Artificial' END"

SQL = {
    "b_artist": """SELECT c_custkey AS artist_id, c_name AS name, c_nationkey AS nation_id, c_mktsegment AS genre, c_acctbal AS fans,
      CASE WHEN c_acctbal < 0 THEN 'confirmed_bad' WHEN c_acctbal < 500 THEN 'suspected' WHEN c_acctbal > 9500 THEN 'cleared' ELSE 'unknown' END AS threat_status,
      CASE WHEN c_acctbal < 0 THEN 'Likely Artificial' WHEN c_acctbal < 1000 THEN 'Suspicious' WHEN c_acctbal < 2500 THEN 'Inconclusive' WHEN c_acctbal < 7500 THEN 'Likely Authentic' ELSE 'Verified Artist' END AS latest_verdict
      FROM customer""",
    "b_release": """SELECT o_orderkey AS release_id, o_custkey AS artist_id, CAST(o_orderdate AS DATE) AS release_date,
      CASE o_orderstatus WHEN 'F' THEN 'album' WHEN 'O' THEN 'single' ELSE 'ep' END AS rtype, o_totalprice AS track_rank FROM orders""",
    "b_track": "SELECT o_custkey AS artist_id, CAST(o_orderdate AS DATE) AS release_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "b_credit": "SELECT DISTINCT o_custkey AS artist_id, l_suppkey AS songwriter_id, l_returnflag AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "b_songwriter": "SELECT s_suppkey AS songwriter_id, s_name AS songwriter, s_nationkey AS nation_id, s_acctbal AS balance FROM supplier",
    "b_artist_label": "SELECT DISTINCT o_custkey AS artist_id, p_brand AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "b_playlist_track": """SELECT DISTINCT s_nationkey AS playlist_id, n_name AS playlist, n_regionkey IN (0, 1) AS editorial, o_custkey AS artist_id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "b_scan_result": f"""SELECT scan_id, artist_id, score, release_id, {_LABEL_SQL} AS verdict FROM (
      SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS scan_id, o_custkey AS artist_id, CAST(greatest(0, least(100, floor(o_totalprice / 5000))) AS BIGINT) AS score, o_orderkey AS release_id,
        row_number() OVER (PARTITION BY year(o_orderdate) * 100 + month(o_orderdate), o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "b_api_call": """SELECT event_id, event_type AS api_name, ts, value AS ms, CASE WHEN event_type = 'error' THEN 500 WHEN k % 10 = 0 THEN 404 ELSE 200 END AS status_code,
      CASE WHEN k % 25 = 0 THEN 'timeout' ELSE '' END AS error_message FROM (SELECT *, CAST(props ->> '$.k' AS INTEGER) AS k FROM events)""",
}


def oracle(body: str) -> str:
    """The SQL body, after the views that it names."""
    needed: list[str] = []
    seen: set[str] = set()  # a recursive view names itself

    def need(text: str) -> None:
        for name, view in SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in seen:
                seen.add(name)
                need(view)
                needed.append(name)

    need(body)
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in needed)
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH RECURSIVE {views}, {rest[5:]}" if views else rest
    return f"WITH RECURSIVE {views} {rest}" if views else rest
