"""How results enter stored tables: keyed replacement, appends that can be repeated, refreshed views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new in place of those with the same key.

    Of rows of new that share a key, the one that is last by ``order`` and then by its other columns, so that reruns
    agree. Columns that new lacks are null; the dirty flag of block statistics is cleared by the new row's own value.
    """
    rest = [*order, *(c for c in new.columns if c not in keys and c not in order)]
    last = new.groupBy(*keys).agg(F.max(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("__last")) if rest else new.select(*keys).distinct()
    fresh = last.select(*(F.col(f"`{c}`") if c in keys else F.col("__last")[c].alias(c) for c in new.columns))
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


class KeyedTable:
    """A table as numbered versions in one folder; a version is a whole folder that its success marker completes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._of(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._of(self.path))]
        whole = lambda n: self._fs.exists(self._of(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and whole(n))

    def read(self, schema=None) -> DataFrame | None:
        found = self.versions()
        if found:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(f"{self.path}/v{found[-1]}")
        return None if schema is None else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, version: int) -> None:
        """Make a version; one that is whole already stays, so that a repeated batch changes nothing."""
        if version not in self.versions():
            rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def vacuum(self, keep: int = 2) -> None:
        for version in self.versions()[:-keep]:
            self._fs.delete(self._of(f"{self.path}/v{version}"), True)


def refresh_views(views: dict[str, Callable[[], DataFrame]], root: str) -> dict[str, str]:
    """Compute each view and write it to a folder of its own; returns the folder of each, for readers to switch to."""
    out = {}
    for name, make in views.items():
        out[name] = f"{root}/{name}/{uuid.uuid4().hex}"
        make().write.parquet(out[name])
    return out


def drop_keys(df: DataFrame, keys: DataFrame, key: str = "entity_key") -> DataFrame:
    """df without the rows of the keys: history deleted, entities dropped."""
    return df.join(keys.select(key).distinct(), key, "left_anti")
