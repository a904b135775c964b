"""Global ranks and prefix sums without one big partition, and pagination."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import Scratch

ROWS_A_PART = 33  # bits of a generated id that number the rows of a partition


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of a total order, written once: with __part, the number of a row's range, and __at, its place there.

    Spark samples the order to cut the ranges, as many as the size of the data asks for. As the order
    holds the tie columns, equal values are cut like any others.
    """
    numbered = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = Scratch(df.sparkSession).keep(numbered, "ranged")
    return kept.withColumn("__part", F.shiftright("__id", ROWS_A_PART)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << ROWS_A_PART) - 1))).drop("__id")


def _before(cut: DataFrame, total: Column) -> DataFrame:
    """(__part, __before): the total of the ranges before each; one row per range, a few thousand at most."""
    ahead = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    return cut.groupBy("__part").agg(total.alias("__n")).select("__part", F.coalesce(ahead, F.lit(0)).alias("__before"))


def ranked(df: DataFrame, by: str, ties: list[str], descending: bool = True, name: str = "rank") -> DataFrame:
    """df with row numbers in the order of ``by`` (nulls first if descending, else last), ties by ascending columns.

    Rows are sorted in ranges, and shifted by the rows of the ranges before: no task sees the whole table.
    """
    cut = _ranged(df, [F.desc_nulls_first(by) if descending else F.asc_nulls_last(by), *(F.asc(t) for t in ties)])
    numbered = cut.join(F.broadcast(_before(cut, F.count("*"))), "__part").withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("bigint"))
    return numbered.select(*df.columns, name)


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows up to this one in the order of a unique column: two levels, as in ``ranked``."""
    cut = _ranged(df, [F.asc(order)])
    inner = F.sum(value).over(W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, 0))
    summed = cut.join(F.broadcast(_before(cut, F.sum(value))), "__part").withColumn(name, (F.col("__before") + inner).cast("bigint"))
    return summed.select(*df.columns, name)


def followed(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the ``value`` of the row that follows in the order of all rows; null on the last.

    Within a range the next row tells it; the last row of a range takes the first value of the next range that has rows.
    """
    cut = _ranged(df, [F.asc(c) for c in order])
    firsts = cut.groupBy("__part").agg(F.min_by(F.struct(F.col(value).alias("v")), "__at").alias("__head"))
    heads = firsts.select("__part", F.lead("__head").over(W.orderBy("__part")).alias("__head"))  # one row a range
    inner = F.lead(F.struct(F.col(value).alias("v"))).over(W.partitionBy("__part").orderBy("__at"))
    led = cut.withColumn("__next", inner).join(F.broadcast(heads), "__part", "left")
    return led.withColumn(name, F.coalesce("__next", "__head")["v"]).select(*df.columns, name)


class Pages:
    """A table stored in the order of its pages: ranges of about ``rows_a_range`` rows in folders of their own, and how many rows lie before each.

    A page reads the ranges that it lies in, one or two, however deep it is. What reaches the driver is one number
    per range. ``order`` must be total, or pages of equal rows differ from one writing to the next.
    """

    def __init__(self, df: DataFrame, order: list[Column | str], rows_a_range: int = 1 << 20):
        scratch = Scratch(df.sparkSession)
        held = scratch.keep(df, "rows")
        parts = max(1, -(-held.count() // rows_a_range))
        ranged = held.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
        cut = ranged.withColumn("__part", F.shiftright("__id", ROWS_A_PART)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << ROWS_A_PART) - 1))).drop("__id")
        self.columns, self.path, self.schema = df.columns, f"{scratch.root}/pages", cut.schema
        cut.write.partitionBy("__part").parquet(self.path)
        scratch.drop("rows")
        self.spark, self.before, self.total = df.sparkSession, [], 0
        for part, n in sorted(tuple(r) for r in self._read().groupBy("__part").count().collect()):
            self.before.append((part, self.total, n))
            self.total += n

    def _read(self, *parts: int) -> DataFrame:
        paths = [f"{self.path}/__part={p}" for p in parts] or [self.path]
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)

    def page(self, page: int = 1, size: int = 100) -> DataFrame:
        """As ``paginate``: one page with total_items and total_pages."""
        page, size = max(1, page), min(max(1, size), 100)
        first, last = (page - 1) * size, page * size
        met = [(p, before) for p, before, n in self.before if before < last and before + n > first]
        if not met:
            rows = self.spark.createDataFrame([], self.schema)
        else:
            # Rows of each range that the page takes, by their places in it.
            inside = [(F.col("__part") == p) & F.col("__at").between(first - before, last - before - 1) for p, before in met]
            rows = self._read(*(p for p, _ in met)).filter(inside[0] if len(inside) == 1 else functools.reduce(Column.__or__, inside)).orderBy("__part", "__at")
        return rows.select(*self.columns, F.lit(self.total).cast("bigint").alias("total_items"), F.lit(-(-self.total // size)).cast("bigint").alias("total_pages"))


def paginate(df: DataFrame, order: list[Column | str], page: int = 1, size: int = 100) -> DataFrame:
    """One page (page at least 1, size 1 to 100) with total_items and total_pages."""
    page, size = max(1, page), min(max(1, size), 100)
    total = df.agg(F.count("*").alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / size).cast("bigint"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def paginate_with_next(df: DataFrame, order: list[Column | str], page: int = 1, size: int = 100) -> DataFrame:
    """As ``paginate``, with next_page (null on the last) and remaining, the rows that the next page will have."""
    page, size = max(1, page), min(max(1, size), 100)
    left = F.greatest(F.col("total_items") - page * size, F.lit(0))
    return paginate(df, order, page, size).withColumn("next_page", F.when(left > 0, page + 1).cast("bigint")).withColumn("remaining", F.least(left, F.lit(size)).cast("bigint"))
