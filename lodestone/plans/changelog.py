"""The scans as a change log of artists: one delta a scan, read as of a scan, after a replay and a snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.changelog import ChangeLog
from lodestone.operators.written import folder
from lodestone.plans.base import query
from lodestone.sources import bindings as b

POLICIES = {"verdict": "given", "first_scan": "kept", "last_good": "filled", "scans": "sum", "best": "most", "worst": "least"}
AS_OF, SNAPSHOT = 199806, 199703


def deltas(spark, d):
    rows = b.scan_results(spark, d)
    good = F.when(F.col("score") >= 58, F.col("verdict")).otherwise("")
    return rows.select(F.col("scan_id").alias("seq"), "artist_id", "verdict", F.col("scan_id").alias("first_scan"), good.alias("last_good"), F.lit(1).cast("long").alias("scans"), F.col("score").alias("best"), F.col("score").alias("worst"), (F.col("score") == 0).alias("gone"))


def scan_log(spark, d):
    """Every scan is appended, half of them twice; a snapshot lies between."""
    log = ChangeLog(spark, f"{folder(spark)}/scan-log-{uuid.uuid4().hex}", "artist_id", POLICIES)
    rows = deltas(spark, d)
    log.append(rows.where(F.col("seq") <= SNAPSHOT))
    log.compact()
    log.append(rows)
    return log


_STATE = """WITH s AS (SELECT *, scan_id AS seq FROM b_scan_result WHERE scan_id <= {0}), g AS (SELECT artist_id, max(seq) AS gone_at FROM s WHERE score = 0 GROUP BY 1)
    SELECT s.artist_id, arg_max(verdict, seq) AS verdict, min(seq) AS first_scan, arg_max(verdict, seq) FILTER (score >= 58) AS last_good, CAST(count(*) AS BIGINT) AS scans, max(score) AS best, min(score) AS worst
    FROM s LEFT JOIN g USING (artist_id) WHERE gone_at IS NULL OR seq > gone_at GROUP BY 1"""


@query(_STATE.format(AS_OF))
def artist_state_as_of(spark, d):
    return scan_log(spark, d).as_of(AS_OF)


@query(_STATE.format(999999))
def artist_state_latest(spark, d):
    return scan_log(spark, d).as_of()


@query(f"WITH x AS ({_STATE.format(AS_OF)}), y AS ({_STATE.format(999999)}) SELECT coalesce(x.artist_id, y.artist_id) AS artist_id, x.verdict AS before, y.verdict AS after FROM x FULL JOIN y ON x.artist_id = y.artist_id WHERE x.verdict IS DISTINCT FROM y.verdict")
def verdict_changes_since(spark, d):
    """Artists whose verdict has changed, come or gone since a scan."""
    log = scan_log(spark, d)
    before, after = log.as_of(AS_OF).select("artist_id", F.col("verdict").alias("before")), log.as_of().select("artist_id", F.col("verdict").alias("after"))
    return before.join(after, "artist_id", "full").where(~F.col("before").eqNullSafe(F.col("after")))
