"""Size-tiered compaction of immutable shards under versioned manifests.

A store is a folder: data/ holds the shards of each run, manifests/ one table of files per version, commits/
one small file per version that names its manifest. Arrivals are appended as runs of small shards. Whenever
a size tier holds FANOUT files or more, they are merged into files of the target size, which belong to
a higher tier. A commit renames a whole file to its version's name only if nobody else has (file systems whose
rename refuses an existing name; on object stores this takes one writer at a time): readers see a
whole version or the one before, a writer that was beaten tries again on top, and a job that dies leaves files
that no manifest names, which vacuum() finds by their age. Every version
can be read until vacuum() forgets it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

FANOUT = 4
TARGET_BYTES = 256 << 20
MANIFEST = "path string, bytes long, rows long, tier int"


def tier_of(size: Column, base: int, fanout: int = FANOUT) -> Column:
    """0 for files below base bytes, one more for each factor of fanout above it."""
    return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / base) / F.log(F.lit(float(fanout)))) + 1).cast("int")


class ShardStore:
    """A table kept as shards below one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, base: int = 1 << 20, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.base, self.fanout = spark, root, target, base, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return 0
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, rows, tier of the files of a version (the last by default)."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._named(v))

    def _named(self, version: int) -> str:
        """The manifest that a version's commit names."""
        stream = self._fs.open(self._path(f"{self.root}/commits/{version:012d}"))
        try:
            return f"{self.root}/manifests/{stream.readUTF()}"
        finally:
            stream.close()

    def _commit(self, files: DataFrame, after: int) -> int:
        """Write a manifest and make it version after + 1, or fail if another writer has made that version."""
        name = uuid.uuid4().hex
        files.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        whole, final = self._path(f"{self.root}/commits/_{name}"), self._path(f"{self.root}/commits/{after + 1:012d}")
        stream = self._fs.create(whole, False)
        try:
            stream.writeUTF(name)
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # no overwriting
        try:
            hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(whole, final, none)
        except Exception:
            self._fs.delete(whole, False)
            raise
        return after + 1

    def _described(self, path: str, schema) -> DataFrame:
        """Manifest rows of the files that a run has just written."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        rows = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return rows.select("path", "bytes", "rows", tier_of(F.col("bytes"), self.base, self.fanout).alias("tier"))

    def append(self, arrivals: DataFrame, by: Column | None = None) -> int:
        """Add arrivals as one run of shards (one per value of ``by`` and task, if given). No rows: the version stays."""
        before, path = self.version(), f"{self.root}/data/{uuid.uuid4().hex}"
        if by is None:
            arrivals.write.parquet(path)
        else:
            name = unused("__arrival", arrivals)
            arrivals.withColumn(name, by).write.partitionBy(name).parquet(path)
        new = self._described(path, arrivals.schema)
        if not new.limit(1).count():
            return before
        return self._publish(lambda files: files.unionByName(new))

    def append_each(self, arrivals: DataFrame, by: Column) -> int:
        """Add arrivals as runs, one per value of ``by`` in ascending order, each under a commit of its own; rows are read and written once."""
        name, run = unused("__arrival", arrivals), uuid.uuid4().hex
        path, told = f"{self.root}/data/{run}", f"{self.root}/arrivals/{run}"
        arrivals.withColumn(name, by).write.partitionBy(name).parquet(path)
        self._described(path, arrivals.schema).withColumn("run", F.regexp_extract("path", f"/{name}=([^/]*)/", 1)).write.parquet(told)
        files = self.spark.read.schema(MANIFEST + ", run string").parquet(told)
        version = self.version()
        for (value,) in sorted(files.select("run").distinct().collect(), key=lambda r: (len(r[0]), r[0])):  # one row per run
            new = files.filter(F.col("run") == value).drop("run")
            version = self._publish(lambda old, new=new: old.unionByName(new))
        self._fs.delete(self._path(told), True)
        return version

    def _publish(self, change) -> int:
        """Commit what change makes of the last manifest; where another writer was first, make it anew on top of theirs."""
        while True:
            before = self.version()
            try:
                return self._commit(change(self.manifest(before)), before)
            except Exception:
                if self.version() == before:
                    raise

    def compact(self, schema) -> int:
        """Merge, lowest tier first, until no tier below the target holds fanout files or more. Returns the version."""
        while True:
            before = self.version()
            files = self.manifest(before)
            top = F.col("bytes") < self.target // 2
            full = files.filter(top).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).filter(F.col("n") >= self.fanout).orderBy("tier").limit(1).collect()
            if not full:
                return before
            merged = files.filter(top & (F.col("tier") == full[0]["tier"]))
            paths = [r["path"] for r in merged.select("path").orderBy("path").collect()]  # names of files, no data
            out = f"{self.root}/data/{uuid.uuid4().hex}"
            # Neighbouring small files are read by one task each until the target size is full: no shuffle.
            count = max(1, round(full[0]["bytes"] / self.target))
            if count >= full[0]["n"]:
                count = max(1, full[0]["n"] // self.fanout)
            self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths).coalesce(count).write.parquet(out)
            kept = files.join(merged.select("path"), "path", "left_anti").select(files.columns)
            new = self._described(out, schema)
            # A merge always rises, so that compaction ends even where files shrink.
            new = new.withColumn("tier", F.greatest("tier", F.lit(full[0]["tier"] + 1)))
            try:
                self._commit(kept.unionByName(new), before)
            except Exception:
                if self.version() == before:
                    raise  # else another writer was first: look again at what there is to merge

    def vacuum(self, keep: int = 1, dead_after: float = 86400.0) -> None:
        """Forget all versions but the last ``keep`` (at least one), with the shards that only they name; their readers must have ended.

        Runs and manifests that no kept version names and that are older than ``dead_after`` seconds are of dead or
        beaten writers and go too; younger ones may belong to a writer at work.
        """
        known = self._versions() if self.version() else []
        if not known:
            return
        old, kept = ([self._named(v) for v in part] for part in (known[: -max(1, keep)], known[-max(1, keep) :]))
        paths = lambda names: self.spark.read.schema(MANIFEST).parquet(*names).select("path").distinct()
        gone = [r["path"] for r in paths(old).join(paths(kept), "path", "left_anti").collect()] if old else []  # names of files, no data
        for p in [*(f"{self.root}/commits/{v:012d}" for v in known[: len(old)]), *old, *gone]:
            self._fs.delete(self._path(p), True)
        runs = paths(kept).select(F.regexp_extract("path", "/data/([0-9a-f]{32})/", 1)).distinct()
        used = {r[0] for r in runs.collect()} | {n.rpartition("/")[2] for n in kept}  # names of runs
        youngest = time.time() - dead_after
        for folder in ("data", "manifests", "arrivals"):
            at = self._path(f"{self.root}/{folder}")
            for status in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if status.getPath().getName() not in used and status.getModificationTime() / 1000 <= youngest:
                    self._fs.delete(status.getPath(), True)

    def read(self, schema, version: int | None = None, shard: bool = False) -> DataFrame:
        """Rows of a version; if asked, with the shard's path, bytes and tier as __shard (a struct; a column of that name is replaced)."""
        files = self.manifest(version)
        told = files.select("path", F.struct("path", "bytes", "tier").alias("__shard"))
        paths = [r["path"] for r in files.select("path").collect()]  # names of files, no data
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if not shard:
            return rows
        path = F.col("_metadata.file_path") if paths else F.lit("")
        return rows.select("*", path.alias("path")).join(told, "path").drop("path")
