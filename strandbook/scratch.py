"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{scratch_dir(spark)}/strandbook-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back from there on."""
        self.paths[name] = path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self, *but: str) -> None:
        """Delete all tables but those named."""
        self.drop(*(name for name in list(self.paths) if name not in but))
