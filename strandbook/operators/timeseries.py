"""Hourly views and charts. Times are epoch seconds; strings belong to the caller's last projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOUR, DAY, WEEK, MONTH = 3600, 86400, 7 * 86400, 30 * 86400


def _hour(column: str = "block_seconds"):
    return F.expr(f"{column} div {HOUR} * {HOUR}").alias("hour")


def _running(value: str):
    """Prefix sum over hours: one row per hour, few thousand a year."""
    return F.sum(value).over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0))


def data_usage(history: DataFrame, net: bool = False) -> DataFrame:
    """Hourly change and total of bytes. Deletes carry no data and so take nothing away, unless ``net`` uses what was there before."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    op = F.col("operation")
    removed = -size("prev_data") if net else -size("data")
    change = F.when(op == "create", size("data")).when(op == "update", size("data") - size("prev_data")).when(op == "delete", removed).otherwise(0)
    hourly = history.groupBy(_hour()).agg(F.sum(change).cast("bigint").alias("change"))
    return hourly.withColumn("data_usage", F.greatest(_running("change"), F.lit(0)))


def entity_count(history: DataFrame) -> DataFrame:
    op, expired = F.col("operation"), F.col("status") == "expired"
    hourly = history.groupBy(_hour()).agg(
        F.count_if(op == "create").alias("created"), F.count_if((op == "delete") & ~expired).alias("deleted"), F.count_if((op == "delete") & expired).alias("expired")
    ).withColumn("net", F.col("created") - F.col("deleted") - F.col("expired"))
    return hourly.withColumn("total", F.greatest(_running("net"), F.lit(0))).drop("net")


def operation_count(ops: DataFrame) -> DataFrame:
    return ops.groupBy(_hour(), "operation").agg(F.count("*").alias("n"))


def storage_forecast(history: DataFrame, now: int | None = None, current_only: bool = False) -> DataFrame:
    """Bytes still live at each future expiry hour, and the total at the hour of ``now`` (default: the last block's time).

    Every version with a btl that expires later counts, unless ``current_only``.
    """
    rows = history.filter("btl is not null and data is not null")
    if current_only:
        w = W.partitionBy("entity_key").orderBy(F.desc("block_number"), F.desc("tx_index"), F.desc("tx_hash"), F.desc("op_index"))
        rows = history.withColumn("__n", F.row_number().over(w)).filter("__n = 1 and status = 'active' and btl is not null and data is not null")
    rows = rows.select(F.expr(f"(block_seconds + btl * 2 + {HOUR}) div {HOUR} * {HOUR}").alias("hour"), F.octet_length("data").alias("bytes"))
    clock = history.agg((F.max("block_seconds") if now is None else F.lit(now).cast("bigint")).alias("now")).select(F.expr(f"now div {HOUR} * {HOUR}").alias("now"))
    later = rows.crossJoin(F.broadcast(clock)).filter("hour > now")
    hours = later.groupBy("hour").agg(F.sum("bytes").alias("bytes"))
    after = F.sum("bytes").over(W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")
    first = clock.select(F.col("now").alias("hour")).crossJoin(F.broadcast(hours.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("live"))))
    return hours.select("hour", after.cast("bigint").alias("live")).unionByName(first.select("hour", F.col("live").cast("bigint")))


def gap_fill(points: DataFrame, time: str, value: str, step: int, start: int | None = None, end: int | None = None, initial: int = 0) -> DataFrame:
    """Points at start, start + step, ... below end: the value there, else the last one seen, else ``initial``.

    start defaults to the first point (and is cut down to a whole step), end to one step after the last.
    """
    span = points.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    lo = F.col("lo") if start is None else F.lit(start - start % step).cast("bigint")
    hi = F.col("hi") if end is None else F.lit(end - 1).cast("bigint")
    frame = span.filter(lo.isNotNull() & hi.isNotNull() & (lo <= hi)).select(F.explode(F.sequence(lo, hi, F.lit(step).cast("bigint"))).alias(time))
    seen = frame.join(points.select(time, value), time, "left")
    if start is not None:  # the last value before the range
        before = points.filter(F.col(time) < start).agg(F.max_by(value, time).alias("__before"))
        seen = seen.crossJoin(F.broadcast(before))
    else:
        seen = seen.withColumn("__before", F.lit(None).cast("bigint"))
    carried = F.last(value, ignorenulls=True).over(W.orderBy(time).rowsBetween(W.unboundedPreceding, 0))
    return seen.select(time, F.coalesce(carried, F.col("__before"), F.lit(initial)).cast("bigint").alias(value))


def daily(view: DataFrame, value: str, how: str = "max") -> DataFrame:
    """Hourly rows to days, by the largest value or the sum."""
    agg = F.max(value) if how == "max" else F.sum(value)
    return view.groupBy(F.expr(f"hour div {DAY} * {DAY}").alias("day")).agg(agg.alias(value))


def forecast_periods(forecast: DataFrame, period: int, until: int | None = None) -> DataFrame:
    """Latest value within each period of so many seconds from the first row, carried over empty periods."""
    start = forecast.agg(F.min("hour").alias("start"))
    cut = forecast.crossJoin(F.broadcast(start)).withColumn("period", F.expr(f"start + (hour - start) div {period} * {period}"))
    points = cut.groupBy("period").agg(F.max_by("live", "hour").alias("live"))
    return gap_fill(points, "period", "live", period, end=until)


def block_transactions(transactions: DataFrame, limit: int = 300) -> DataFrame:
    """Transactions per consensus block, the latest ``limit`` blocks that have any, oldest first."""
    return transactions.filter("block_consensus").groupBy("block_number").agg(F.count("*").alias("n_txs")).orderBy(F.desc("block_number")).limit(limit).orderBy("block_number")


def block_operations(ops: DataFrame, limit: int = 100, kinds: tuple[str, ...] = ("create", "update", "extend", "changeowner", "delete")) -> DataFrame:
    """Operations by type for each of the last block numbers (1 to 500), empty blocks kept."""
    limit = min(max(1, limit), 500)
    head = ops.agg(F.max("block_number").alias("hi")).filter("hi is not null")
    frame = head.select(F.explode(F.sequence(F.greatest(F.col("hi") - limit + 1, F.lit(1)), F.greatest("hi", F.lit(1)))).alias("block_number"))
    recent = ops.crossJoin(F.broadcast(head)).filter(F.col("block_number") > F.col("hi") - limit)
    counts = recent.groupBy("block_number").agg(*(F.count_if(F.col("operation") == k).alias(f"n_{k}") for k in kinds))
    return frame.join(counts, "block_number", "left").select("block_number", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds))


def block_gas(blocks: DataFrame, limit: int = 1800) -> DataFrame:
    """Gas used, limit and percentage of the latest blocks."""
    last = blocks.select("block_number", "gas_used", "gas_limit").orderBy(F.desc("block_number")).limit(limit)
    percent = F.when(F.col("gas_limit") > 0, F.round(F.col("gas_used") / F.col("gas_limit") * 100, 2)).otherwise(0.0)
    return last.withColumn("gas_percent", percent).orderBy("block_number")
