"""Tables in buckets that one commit publishes together.

A change reads the commit before it and writes the buckets it touches into folders of its own; nothing is seen until
its record, which names the folder of every bucket of every table, is renamed into place. So a change that died
between two writes leaves the tables as they were, its repetition starts from the same rows, and a reader holds one
whole version. What a change writes follows the buckets it touches, not the size of the tables. The file system must
refuse to rename over an existing file, as HDFS and local ones do; there is one writer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """Commits and data below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        folder = self._of(f"{self.root}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def record(self, number: int | None) -> dict[str, dict[str, list[str]]]:
        """table -> bucket -> folders of a commit; None: before the first."""
        if number is None:
            return {}
        stream = self._fs.open(self._of(f"{self.root}/commits/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> int | None:
        return max(self.commits(), default=None)

    def read(self, table: str, schema: StructType, number: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a table as of a commit (the last by default), of all buckets or those given."""
        return self._rows(self.record(self.last() if number is None else number).get(table, {}), schema, buckets)

    def _rows(self, folders: dict[str, list[str]], schema: StructType, buckets: set[int] | None) -> DataFrame:
        paths = [f"{self.root}/data/{f}" for b, fs in sorted(folders.items()) if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self, number: int) -> Change | None:
        """A change that becomes commit ``number``; None if that is there already."""
        known = self.commits()
        return None if number in known else Change(self, number, max((n for n in known if n < number), default=None))

    def vacuum(self, keep: int = 2) -> None:
        """Delete all commits but the last ``keep``, and every folder that none of those names, those of dead changes included."""
        known = self.commits()
        for n in known[:-keep]:
            self._fs.delete(self._of(f"{self.root}/commits/{n:012d}"), False)
        used = {f for n in known[-keep:] for buckets in self.record(n).values() for fs in buckets.values() for f in fs}
        attempts = self._of(f"{self.root}/data")
        for attempt in self._fs.listStatus(attempts) if self._fs.exists(attempts) else []:
            tables = [(t, b) for t in self._fs.listStatus(attempt.getPath()) for b in self._fs.listStatus(t.getPath()) if b.isDirectory()]
            names = [f"{attempt.getPath().getName()}/{t.getPath().getName()}/{b.getPath().getName()}" for t, b in tables]
            if not used & set(names):
                self._fs.delete(attempt.getPath(), True)
                continue
            for name, (_, b) in zip(names, tables):
                if name not in used:
                    self._fs.delete(b.getPath(), True)


class Change:
    """Buckets written on top of a commit, unseen until commit()."""

    def __init__(self, store: Store, number: int, base: int | None):
        self.store, self.number, self.base = store, number, base
        self.record, self.attempt = store.record(base), uuid.uuid4().hex
        self.written: dict[str, dict[str, list[str]]] = {}

    def read(self, table: str, schema: StructType, buckets: set[int] | None = None) -> DataFrame:
        """Rows before the change."""
        return self.store._rows(self.record.get(table, {}), schema, buckets)

    def fresh(self, table: str, schema: StructType) -> DataFrame:
        """Rows of the buckets that the change has written."""
        return self.store._rows(self.written[table], schema, None)

    def hold(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows kept for the time of the change."""
        path = f"{self.store.root}/data/{self.attempt}/_{name}/held"
        rows.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def _put(self, table: str, rows: DataFrame, bucket: Column) -> dict[str, list[str]]:
        folder, spark = f"{self.attempt}/{table}", self.store.spark
        path = f"{self.store.root}/data/{folder}"
        rows.withColumn("__bucket", bucket.cast("long")).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(path)
        names = [s.getPath().getName() for s in self.store._fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if s.isDirectory()]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith("__bucket=")}

    def write(self, table: str, rows: DataFrame, bucket: Column, touched: set[int]) -> None:
        """rows in place of all rows of the touched buckets; a bucket without rows is gone."""
        self.written[table] = self._put(table, rows, bucket)
        kept = {b: f for b, f in self.record.get(table, {}).items() if int(b) not in touched}
        self.record = {**self.record, table: {**kept, **self.written[table]}}

    def append(self, table: str, rows: DataFrame) -> None:
        """rows beside those that the table has."""
        old, new = self.record.get(table, {}), self._put(table, rows, F.lit(0))
        self.record = {**self.record, table: {b: old.get(b, []) + new.get(b, []) for b in {*old, *new}}}

    def commit(self) -> None:
        """Publish all that was written, at once; fails if the commit is there already."""
        store, hadoop = self.store, self.store.spark._jvm.org.apache.hadoop.fs
        whole, final = (store._of(f"{store.root}/commits/{n}") for n in (f"_{self.attempt}", f"{self.number:012d}"))
        stream = store._fs.create(whole, False)
        try:
            stream.write(bytearray(json.dumps(self.record).encode()))
        finally:
            stream.close()
        never = store.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(final.toUri(), store.spark._jsc.hadoopConfiguration()).rename(whole, final, never)
        except Exception:
            store._fs.delete(whole, False)
            raise


def buckets_of(rows: DataFrame, bucket: Column) -> set[int]:
    """The bucket numbers that rows fall into; as many at most as there are buckets."""
    return {r[0] for r in rows.select(bucket.cast("long")).distinct().collect()}
