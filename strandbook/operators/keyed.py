"""Rows laid out by key, so that a lookup opens few files and reads few rows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .store import buckets_of

MANY = 1000  # keys that a list may hold; more come as a table


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


class KeyedRows:
    """df in buckets by the hash of ``keys``, each sorted by key, with Parquet statistics and bloom filters on the keys.

    A lookup reads the folders of its keys' buckets only; there the pushed filters skip row groups and pages by
    statistics and bloom filters. There are as many buckets as make about ``rows_a_bucket`` rows each, or ``buckets``. All
    rows of one key lie in one bucket, in several files where they are more than ``rows_a_file``.
    """

    def __init__(self, df: DataFrame, keys: list[str], rows_a_bucket: int = 1 << 20, buckets: int | None = None, rows_a_file: int = 1 << 22):
        self.spark: SparkSession = df.sparkSession
        self.keys, self.schema = keys, df.schema
        scratch = Scratch(self.spark)
        if buckets is None:
            df = scratch.keep(df, "rows")
            buckets = max(1, -(-df.count() // rows_a_bucket))
        self.buckets, self.path = buckets, f"{scratch.root}/keyed"
        spread = df.withColumn("__bucket", bucket_of(keys, buckets)).repartition("__bucket").sortWithinPartitions("__bucket", *keys)
        writer = spread.write.partitionBy("__bucket").option("maxRecordsPerFile", rows_a_file)
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(self.path)
        if "rows" in scratch.paths:
            scratch.drop("rows")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        listed = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(fs_path)
        names = (s.getPath().getName() for s in listed)
        self.present = {int(n.partition("=")[2]) for n in names if n.startswith("__bucket=")}

    def _of(self, buckets: set[int]) -> DataFrame:
        paths = [f"{self.path}/__bucket={b}" for b in sorted(buckets & self.present)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def get(self, *wanted: tuple) -> DataFrame:
        """Rows of the given keys, each a tuple of key values; nulls find nothing."""
        if len(wanted) > MANY:
            raise ValueError(f"more than {MANY} keys: give them as a table to matching()")
        shape = self.spark.createDataFrame([], self.schema).select(*self.keys).schema
        keys = self.spark.createDataFrame([w for w in wanted if None not in w], shape)
        met = self._of(buckets_of(keys, bucket_of(self.keys, self.buckets)))
        # Plain comparisons, so that they reach the scan; a pair of lists would not.
        for i, key in enumerate(self.keys):
            met = met.filter(F.col(key).isin([w[i] for w in wanted if None not in w]))
        return met if len(self.keys) == 1 else met.join(F.broadcast(keys), self.keys, "left_semi")

    def matching(self, wanted: DataFrame) -> DataFrame:
        """Rows whose key is in a table; the buckets that hold none of its keys are not opened."""
        keys = wanted.select(*self.keys).distinct()
        return self._of(buckets_of(keys, bucket_of(self.keys, self.buckets))).join(keys, self.keys, "left_semi")
