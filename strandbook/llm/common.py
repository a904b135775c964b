"""What the training-data operators share: patterns, scratch tables, size-checked joins."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch  # noqa: F401 - the operators take it from here

# Functions of this subpackage travel to the executors by value: a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

SPACE = r"\x20\x09-\x0D"  # the white space of the word definition, inside a character class
WORD = f"[^{SPACE}]"

#: A side of a join is broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 32 << 20


def worker_memo(name: str, make):
    """An object that lives as long as the Python worker, so that its tasks share it."""
    key = f"_strandbook_{name}"
    if key not in sys.modules:
        sys.modules[key] = make()
    return sys.modules[key]


def words_of(text: Column) -> Column:
    """Words of a text as an array; null or white space only: empty array."""
    bare = F.regexp_replace(text, f"^[{SPACE}]++", "")
    parts = F.split(bare, f"[{SPACE}]++")
    return F.when(text.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    )


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's content, where an id may be null or repeated; equal rows have equal keys, others differ.

    Each value is preceded by its length, so that no two rows are written alike.
    """
    parts = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        parts += [F.coalesce(F.octet_length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.md5(F.concat(*parts)))


def unused(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores after it as make it differ from all columns of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checked_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is below BROADCAST_BYTES, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, label), label the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label
    (pointer jumping), until nothing changes; every round is written to the shared folder. Only the
    number of changed nodes reaches the driver. Rounds grow with the logarithm of the longest path in
    star-like graphs, and at most with its length.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Only labels that are no root any more lead further; most labels are roots soon.
        used = labels.filter("label <> node").select(F.col("node").alias("label"), F.col("label").alias("far"))
        turn += 1
        after = lower.join(used, "label", "left").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved"))
        after = scratch.keep(after, f"{name}-{turn}")
        moved = after.filter("moved").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = after.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels


def widened(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """df's schema with more fields at its end."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])
