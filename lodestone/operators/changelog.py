"""Entity tables as a log of sequence-numbered deltas with snapshots: replayable, idempotent, readable as of any sequence number."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a column of one key follows from the deltas in their order. Empty texts count as missing for filled and kept.
POLICIES = ("given", "filled", "kept", "sum", "most", "least")


class ChangeLog:
    """A table with a key below a folder that driver and executors share.

    A delta is a set of rows (key, columns and, if it deletes, `gone` = true) under a sequence number. It counts once its folder has
    been renamed into place, and never again: append() of a number that is there changes nothing, so that a batch may be replayed
    after a failure. State as of n is the fold of all deltas up to n in the order of their numbers, column by column:
    given (the last value, null included), filled (the last that isn't missing), kept (the first that isn't), sum, most, least.
    A delete takes the key away with all before it; a later delta starts it anew. Rows of one delta with the same key have no order:
    the greatest counts as the last, the least as the first; for sums all count. Rows without key are left out.

    compact(n) writes the state as of n as a snapshot, from which later states start; earlier ones still come from the deltas.
    The rename makes a delta atomic on file systems whose rename is; others need one writer a number.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, policies: dict[str, str]) -> None:
        wrong = {p for p in policies.values() if p not in POLICIES}
        if wrong:
            raise ValueError(f"unknown policies: {sorted(wrong)}")
        self.spark, self.path, self.key, self.policies = spark, path.rstrip("/"), key, policies
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        folder = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removeprefix("seq=")) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("seq="))

    def deltas(self) -> list[int]:
        return self._numbers("deltas")

    def _commit(self, rows: DataFrame, kind: str, numbers: list[int]) -> list[int]:
        """Writes rows (with seq) aside and renames the folders of these numbers; returns those that were new."""
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        rows.write.partitionBy("seq").parquet(aside)
        self._fs.mkdirs(self._path(f"{self.path}/{kind}"))
        done = []
        for n in numbers:
            source, target = self._path(f"{aside}/seq={n}"), self._path(f"{self.path}/{kind}/seq={n}")
            if self._fs.exists(source) and not self._fs.exists(target) and self._fs.rename(source, target):
                done.append(n)
        self._fs.delete(self._path(aside), True)
        return done

    def append(self, rows: DataFrame) -> list[int]:
        """Adds the deltas in rows (seq, key, columns, and perhaps gone), those whose number is new; returns these numbers."""
        known = self.deltas()
        if known:
            rows = rows.where(~F.col("seq").isin(known))
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
        rows = rows.where(F.col(self.key).isNotNull() & F.col("seq").isNotNull()).select(F.col("seq").cast("long").alias("seq"), self.key, *self.policies, gone.alias("gone"))
        new = sorted(r[0] for r in rows.select("seq").distinct().collect())  # a number a delta
        return self._commit(rows, "deltas", new) if new else []

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch: the epoch is the sequence number, so that a batch that comes again after a restart changes nothing."""
        self.append(batch.withColumn("seq", F.lit(epoch).cast("long")))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/seq={n}" for n in numbers]).withColumn("seq", F.col("seq").cast("long"))

    def _value(self, name: str) -> Column:
        policy, value, seq = self.policies[name], F.col(name), F.col("seq")
        some = value.isNotNull() & (value.cast("string") != "")
        if policy == "given":
            return F.max(F.struct("seq", name))[name]
        if policy == "filled":
            return F.max(F.when(some, F.struct(seq, value.alias(name))))[name]
        if policy == "kept":
            return F.min(F.when(some, F.struct(seq, value.alias(name))))[name]
        return {"sum": F.sum, "most": F.max, "least": F.min}[policy](value)

    def as_of(self, n: int | None = None) -> DataFrame:
        """key and columns after all deltas up to n (all there are); an empty log gives an error, an n before the first delta no rows."""
        numbers = self.deltas()
        if not numbers:
            raise ValueError("no delta yet")
        upto = [k for k in numbers if n is None or k <= n]
        base = max((k for k in self._numbers("snapshots") if n is None or k <= n), default=None)
        parts = [self._read("snapshots", [base] if base is not None else []), self._read("deltas", [k for k in upto if base is None or k > base])]
        parts = [p.select("seq", self.key, *self.policies, "gone") for p in parts if p is not None] or [self._read("deltas", numbers[:1]).limit(0)]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        last_gone = rows.where("gone").groupBy(self.key).agg(F.max("seq").alias("gone_at"))
        rows = rows.join(last_gone, self.key, "left").where(F.col("gone_at").isNull() | (F.col("seq") > F.col("gone_at")))
        return rows.groupBy(self.key).agg(*[self._value(name).alias(name) for name in self.policies])

    def compact(self, n: int | None = None) -> int:
        """Writes the state as of n (the last delta) as a snapshot; returns its number. Doing so again changes nothing."""
        numbers = [k for k in self.deltas() if n is None or k <= n]
        if not numbers:
            raise ValueError("no delta yet")
        self._commit(self.as_of(numbers[-1]).withColumns({"gone": F.lit(False), "seq": F.lit(numbers[-1]).cast("long")}), "snapshots", [numbers[-1]])
        return numbers[-1]

    def changes(self, after: int, upto: int) -> DataFrame:
        """What the deltas after one number up to another say, as they were given."""
        return self._read("deltas", [k for k in self.deltas() if after < k <= upto]) or self._read("deltas", self.deltas()[:1]).limit(0)
