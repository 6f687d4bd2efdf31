"""Sharding (operator 4): size-tiered compaction of immutable shards under versioned manifests.

append() writes a batch as a run: a folder of small shards, and commits a manifest that lists it after the earlier runs.
compact() takes runs of similar size (all up to LEAST_BYTES; above that, none over twice the smallest), FAN or more of them,
and merges them into one run of shards of about the target size, without a shuffle; runs of MOST_BYTES and more stay as
they are. read() reads the runs of the latest manifest, or of an earlier one while vacuum() hasn't dropped them.

A manifest lists runs, not files: as merged sizes grow by FAN, a store has a few runs of each size and one for each
MOST_BYTES, so commits stay small and the driver holds some thousand names at most.

A manifest is a Parquet folder that is written aside and renamed to its version's number. The rename fails if the version
exists, so commits are atomic. A writer whose version was taken puts its change on top of the latest manifest and tries
again: an append always can; a merge whose inputs another merge has replaced is dropped. Folders that no manifest lists
(lost jobs, dropped merges) go with vacuum() once they are older than its grace time. Shards are never changed.

Defined results: nulls, empty and long texts, repeated rows and extra columns are kept as they are; an empty batch adds no
rows; the schema is the store's; compacting where nothing is due commits nothing.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import drop_paths, fresh_path, table

TARGET_BYTES, FAN = 64 << 20, 4
LEAST_BYTES, MOST_BYTES = 4 << 20, 64 << 30
GRACE_SECONDS = 24 * 3600
MANIFEST = "run string, shards long, bytes long, rows long, inputs int, version int"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _listed(self, folder: str) -> dict[str, float]:
        """Names in a folder below the root, with the seconds of their last change."""
        path = self._hadoop.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self._conf)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._listed("manifests") if n.isdigit())

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The runs of a version, the latest by default."""
        version = self.latest() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}") if version else self.spark.createDataFrame([], MANIFEST)

    def _path(self, run: str) -> str:
        return f"{self.root}/shards/{run}"

    def _commit(self, runs: DataFrame, version: int) -> None:
        """Makes runs the manifest of this version, unless it exists."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        runs.coalesce(1).write.parquet(aside)  # a row for each run
        folder = self._hadoop.Path(f"{self.root}/manifests")
        folder.getFileSystem(self._conf).mkdirs(folder)
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(folder.toUri(), self._conf).rename(self._hadoop.Path(aside), self._hadoop.Path(f"{self.root}/manifests/{version}"), plain)
        except Py4JJavaError as e:
            drop_paths(self.spark, aside)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from e
            raise

    def _publish(self, made: DataFrame, replaced: list[str]) -> int | None:
        """Commits the latest manifest without the replaced runs and with the made one; None where one of these is gone."""
        while True:
            version = self.latest()
            old = self.manifest(version)
            gone = F.col("run").isin(replaced)
            if replaced and old.where(gone).count() < len(replaced):
                return None
            try:
                self._commit((old.where(~gone) if replaced else old).unionByName(made.withColumn("version", F.lit(version + 1))), version + 1)
                return version + 1
            except Conflict:
                continue

    def _described(self, run: str, inputs: int) -> DataFrame:
        """The manifest's row of a run that has been written; none where it has no rows."""
        rows = self.spark.read.schema(self.schema).parquet(self._path(run)).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
        shards = rows.groupBy("name").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
        whole = shards.agg(F.count("*").alias("shards"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows")).where("shards > 0")
        return whole.select(F.lit(run).alias("run"), "shards", "bytes", "rows", F.lit(inputs).alias("inputs"), F.lit(0).alias("version"))

    def append(self, rows: DataFrame) -> int:
        """Adds a batch; its version."""
        run = uuid.uuid4().hex
        rows.write.parquet(self._path(run))
        return self._publish(self._described(run, 1), [])

    def due(self, version: int | None = None) -> list[list[dict]]:
        """Groups of FAN or more runs of similar size."""
        open_ = [r.asDict() for r in self.manifest(version).where(F.col("bytes") < MOST_BYTES).orderBy("bytes", "run").collect()]  # runs, not files
        groups: list[list[dict]] = []
        for r in open_:
            if groups and r["bytes"] <= max(LEAST_BYTES, 2 * groups[-1][0]["bytes"]):
                groups[-1].append(r)
            else:
                groups.append([r])
        return [g for g in groups if len(g) >= FAN]

    def _merge(self, runs: list[dict], target: int) -> DataFrame:
        """Writes the rows of runs as one run of shards of about the target size; its manifest row."""
        run = uuid.uuid4().hex
        rows = self.spark.read.schema(self.schema).parquet(*[self._path(r["run"]) for r in runs])
        rows.coalesce(max(1, -(-sum(r["bytes"] for r in runs) // target))).write.parquet(self._path(run))
        made = self._described(run, len(runs))
        before, after = sum(r["rows"] for r in runs), made.select("rows").first()[0]
        if before != after:
            raise RuntimeError(f"{before} rows before the merge, {after} after")
        return made

    def compact(self, target: int = TARGET_BYTES) -> int | None:
        """Merges every group that is due, each in a commit of its own; the last version, if there was anything to do."""
        done = None
        for runs in self.due():
            done = self._publish(self._merge(runs, target), [r["run"] for r in runs]) or done
        return done

    def read(self, version: int | None = None, run: str | None = None) -> DataFrame:
        """All rows of a version; with run, each with the name of its run in a column of that name."""
        paths = [self._path(r["run"]) for r in self.manifest(version).select("run").collect()]
        if not paths:
            rows = self.spark.createDataFrame([], self.schema)
            return rows.withColumn(run, F.lit("")) if run else rows
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn(run, F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)) if run else rows

    def vacuum(self, keep: int = 1, grace: float = GRACE_SECONDS) -> int:
        """Drops all manifests but the last ones, and the folders older than grace that none of these lists; how many folders."""
        versions = self.versions()
        live = {r["run"] for v in versions[-keep:] for r in self.manifest(v).select("run").collect()}
        before = time.time() - grace
        gone = [f"{self.root}/{kind}/{n}" for kind in ("shards", "aside") for n, at in self._listed(kind).items() if n not in live and at < before]
        drop_paths(self.spark, *gone, *[f"{self.root}/manifests/{v}" for v in versions[:-keep]])
        return len(gone)


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in FAN small batches and three of FAN times their size, are compacted, and are read through the last manifest.

    The small ones are merged, and where the result is as large as the others, all of these; below LEAST_BYTES all are merged
    at once. merged says that a row's run was made by a merge.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, fresh_path(spark, "shards"), docs.schema)
    part = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1)
    for digits in ("0", "1", "2", "3", "4567", "89ab", "cdef"):
        mine = part.isin(*digits)
        store.append(docs.where(F.coalesce(mine, F.lit(True)) if digits == "0" else mine))
    while store.compact():
        pass
    merged = F.broadcast(store.manifest().select("run", (F.col("inputs") > 1).alias("merged")))  # a row for each run
    rows = store.read(run="run").join(merged, "run")
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "merged")


OP4_SQL = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5, true AS merged FROM documents"
