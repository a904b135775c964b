"""The entity fold: from the operation log to history, snapshot and active attributes, by windows alone.

Operations that set the data of an entity start a segment; within it the data stay and extensions add to
the expiry. One shuffle by entity key serves all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window as W

from . import costs

POSITION = ["block_number", "tx_index", "tx_hash", "op_index"]
SETTERS = ("create", "update", "delete")


def history(ops: DataFrame) -> DataFrame:
    """One row per operation with the entity's state after it and before it; a content type is carried as the data are.

    Costs that are words of 32 bytes are summed in segments, to decimal text; bigint costs to bigint, which fails on overflow.
    """
    wide = isinstance(ops.schema["cost"].dataType, BinaryType)
    if wide:
        ops = total_cost_in_segments(ops)
    w = W.partitionBy("entity_key").orderBy(*POSITION)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    segment = W.partitionBy("entity_key", "segment").orderBy(*POSITION)
    so_far = segment.rowsBetween(W.unboundedPreceding, 0)
    op = F.col("operation")
    expired = (op == "delete") & F.col("to_system")
    df = ops.withColumn("segment", F.sum(F.when(op.isin(*SETTERS), 1).otherwise(0)).over(run))
    df = df.withColumn("status", F.when(expired, "expired").when(op == "delete", "deleted").otherwise("active"))
    owner = F.when(expired, None).when(op == "changeowner", F.col("new_owner")).otherwise(F.col("sender"))
    df = df.withColumn("owner", F.last(owner, ignorenulls=True).over(run))
    if not wide:
        df = df.withColumn("total_cost", F.sum(F.coalesce("cost", F.lit(0))).over(run))
    started = F.col("segment") > 0
    base = F.when(op == "delete", F.col("block_number")).when(op.isin("create", "update"), F.col("block_number") + F.col("btl"))
    longer = F.sum(F.when(op == "extend", F.col("btl")).otherwise(0)).over(so_far)
    df = df.withColumn("state_data", F.when(started, F.first("data").over(segment)))
    typed = ["content_type"] if "content_type" in ops.columns else []
    for column in typed:
        df = df.withColumn(column, F.when(started, F.first(F.when(op != "delete", F.col(column))).over(segment)))
    df = df.withColumn("expires_at_block", F.when(started, F.first(base).over(segment) + longer))
    for column in ("owner", "status", "expires_at_block", *typed):
        df = df.withColumn(f"prev_{column}", F.lag(column).over(w))
    df = df.withColumn("prev_data", F.lag("state_data").over(w))
    return df.drop("segment", "data").withColumnRenamed("state_data", "data")


def total_cost_wide(ops: DataFrame, cost_word: str = "cost_word") -> DataFrame:
    """entity_key, POSITION and total_cost as decimal text: running sums of 256-bit costs, as in ``total_cost_in_segments``."""
    return total_cost_in_segments(ops.select("entity_key", *POSITION, cost_word), cost_word).drop(cost_word)


def total_cost_in_segments(ops: DataFrame, cost: str = "cost", segments: int = 64, name: str = "total_cost") -> DataFrame:
    """ops with the running sum of 256-bit costs (words of 32 bytes, null: 0) as decimal text, saturated at 2**256 - 1.

    The blocks from the first to the last are cut into ``segments`` parts of one width. Sums run within an entity's
    segment; one total a segment is carried on to the later ones. So an entity with a third of all rows is summed by as
    many tasks as it has segments, and what one task sorts of it for the carry is a row a segment. Digits have base 2**32
    in decimals of 38: no sum of up to 10**18 rows overflows. Rows without a block number make the first segment.
    """
    ends = ops.agg(F.min("block_number").alias("__low"), F.max("block_number").alias("__high"))
    # The last segment ends after the last block; one row of two numbers is broadcast.
    segment = F.expr(f"if(block_number is null, -1L, least((block_number - __low) div greatest((__high - __low) div {segments} + 1, 1), {segments - 1}))")
    cut = ops.crossJoin(F.broadcast(ends)).withColumn("__segment", segment).drop("__low", "__high")
    names = [f"__digit{i}" for i in range(costs.DIGITS)]
    digits = costs.digits_of_word(F.coalesce(F.col(cost), F.lit(bytes(32))))
    cut = cut.select("*", *(d.alias(n) for d, n in zip(digits, names)))
    within = W.partitionBy("entity_key", "__segment").orderBy(*POSITION).rowsBetween(W.unboundedPreceding, 0)
    summed = cut.select(*ops.columns, "__segment", *(F.sum(n).over(within).alias(n) for n in names))
    totals = cut.groupBy("entity_key", "__segment").agg(*(F.sum(n).alias(n) for n in names))
    ahead = W.partitionBy("entity_key").orderBy("__segment").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("entity_key", "__segment", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(n) for n in names))
    joined = summed.alias("s").join(carried.alias("c"), F.col("s.entity_key").eqNullSafe(F.col("c.entity_key")) & (F.col("s.__segment") == F.col("c.__segment")))
    total = costs.text_of_digits([(F.col(f"s.{n}") + F.col(f"c.{n}")).cast("decimal(38,0)") for n in names])
    return joined.select(*(F.col(f"s.`{c}`") for c in ops.columns), total.alias(name))


def with_expiry_seconds(history: DataFrame, seconds_per_block: int = 2) -> DataFrame:
    """Expiry as a time: block time plus the distance; the saturating variant never lies before the block; null on overflow."""
    apart = F.try_multiply(F.try_subtract(F.col("expires_at_block"), F.col("block_number")), F.lit(seconds_per_block).cast("bigint"))
    return history.withColumn("expires_at_seconds", F.try_add("block_seconds", apart)).withColumn("expires_at_seconds_sat", F.try_add("block_seconds", F.when(apart < 0, F.lit(0).cast("bigint")).otherwise(apart)))


def latest(df: DataFrame, columns: list[str]) -> DataFrame:
    """The row at the last position of each entity."""
    return df.groupBy("entity_key").agg(F.max_by(F.struct(*columns), F.struct(*POSITION)).alias("x")).select("entity_key", "x.*")


def earliest(df: DataFrame, columns: list[str]) -> DataFrame:
    """The row at the first position of each entity."""
    return df.groupBy("entity_key").agg(F.min_by(F.struct(*columns), F.struct(*POSITION)).alias("x")).select("entity_key", "x.*")


def snapshot(history: DataFrame) -> DataFrame:
    """Current state per entity, with creator and creation transaction from its earliest create."""
    state = ["data", "status", "owner", "expires_at_block", F.col("tx_hash").alias("last_tx"), F.col("total_cost").alias("cost")]
    created = F.col("operation") == "create"
    at = F.struct(*POSITION)
    return history.groupBy("entity_key").agg(
        F.max_by(F.struct(*state), at).alias("x"),
        F.min_by(F.when(created, F.col("sender")), F.when(created, at)).alias("creator"),
        F.min_by(F.when(created, F.col("tx_hash")), F.when(created, at)).alias("created_tx"),
    ).select("entity_key", "x.*", "creator", "created_tx")


def active_attribute_source(ops: DataFrame, carry_on_owner_change: bool = False) -> DataFrame:
    """The operation whose attributes are active: the latest other than extend; none after a delete."""
    skipped = ["extend", "changeowner"] if carry_on_owner_change else ["extend"]
    last = latest(ops.filter(~F.col("operation").isin(*skipped)), ["operation", F.col("tx_hash").alias("source_tx"), F.col("op_index").alias("source_index")])
    return last.filter("operation <> 'delete'").drop("operation")


def activate_attributes(attributes: DataFrame, source: DataFrame) -> DataFrame:
    """Attributes (entity_key, tx_hash, op_index, key, value) with a computed ``active``."""
    marks = source.select("entity_key", F.col("source_tx").alias("tx_hash"), F.col("source_index").alias("op_index"), F.lit(True).alias("__on"))
    return attributes.join(marks, ["entity_key", "tx_hash", "op_index"], "left").withColumn("active", F.coalesce("__on", F.lit(False))).drop("__on")


def refold(ops: DataFrame, affected: DataFrame) -> DataFrame:
    """History of the affected entity keys only."""
    return history(ops.join(affected.select("entity_key").distinct(), "entity_key", "left_semi"))


def without_orphans(ops: DataFrame, orphaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving operations, keys that had operations in orphaned transactions)."""
    gone = orphaned.select("tx_hash").distinct()
    return ops.join(gone, "tx_hash", "left_anti"), ops.join(gone, "tx_hash", "left_semi").select("entity_key").distinct()


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """old without the rows of keys, and new: how a refold enters the history or the snapshot."""
    return old.join(keys.select("entity_key").distinct(), "entity_key", "left_anti").unionByName(new)


def backfill_content_type(entities: DataFrame) -> DataFrame:
    """Empty content type where an active entity has none."""
    return entities.withColumn("content_type", F.when((F.col("status") == "active") & F.col("content_type").isNull(), "").otherwise(F.col("content_type")))
