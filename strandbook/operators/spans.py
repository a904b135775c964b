"""Joins of points with the spans that hold them.

A span of length n is kept at the level of n's bits, where it touches at most two cells of width 2 ** level; a
point looks into one cell of each level that there is. So the join is an equality on (level, cell): it shuffles
or broadcasts as any other, AQE splits cells that many points fall into, and of spans that do not overlap at most three share a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = (1 << 62) - 1  # where a span without an end ends
TOP_LEVEL = 62


def span_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of points with every span that has start <= at < end; columns of both, which must differ in name.

    ``at``, ``start`` and ``end`` are bigint, between -2**62 and 2**62 - 1. A null end is open. Spans without a
    start or with end <= start hold nothing; a point that is null or in no span comes with nulls if ``how`` is left.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if clash := set(points.columns) & set(spans.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    stop = F.coalesce(F.col(end), F.lit(END))
    # length(bin(n)) is the number of bits of n, so that 2 ** level >= n.
    level = F.least(F.length(F.bin(stop - F.col(start))), F.lit(TOP_LEVEL))
    cells = spans.withColumn("__stop", stop).filter(F.col(start) < F.col("__stop")).withColumn("__level", level)
    cell = lambda column: F.expr(f"shiftright({column}, __level)")
    cells = cells.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(f"`{start}`"), cell("(__stop - 1)")))))
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())  # at most 62
    if not levels:
        empty = points if how == "left" else points.limit(0)
        return empty.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in spans.schema))
    seen = points.filter(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*(F.lit(n) for n in levels)))).withColumn("__cell", cell(f"`{at}`"))
    if how == "inner":
        met = seen.join(cells, ["__level", "__cell"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col("__stop")))
        return met.select(*points.columns, *spans.columns)
    # Of the levels that a point looks into some may hold nothing: the pairs are joined to the distinct moments, and those to the points.
    moments = points.select(F.col(at).alias("__at")).filter("__at is not null").distinct()
    pairs = span_join(moments, spans, "__at", start, end)
    return points.join(pairs, F.col(at) == F.col("__at"), "left").select(*points.columns, *spans.columns)


def spans_of(followed: DataFrame, start: str, following: str) -> DataFrame:
    """Spans from rows with their follower's start: of rows that start together only the last has a length."""
    return followed.filter(F.col(following).isNull() | (F.col(start) < F.col(following)))
