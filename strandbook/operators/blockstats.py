"""Statistics per block: counts, storage, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_sum

#: Seconds until an unsafe block is expected to be safe.
UNSAFE_DELAY = 1200


def storage_diff(history: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bytes added less bytes removed per block; 0 for blocks without history."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    diffs = history.groupBy("block_number").agg(F.sum(size("data") - size("prev_data")).alias("diff"))
    return blocks.select("block_number").join(diffs, "block_number", "left").select("block_number", F.coalesce("diff", F.lit(0)).cast("bigint").alias("diff"))


def storage_usage(diffs: DataFrame) -> DataFrame:
    """Total bytes stored at each block, never below 0."""
    return running_sum(diffs, "block_number", "diff", "total").select("block_number", F.greatest("total", F.lit(0)).alias("storage_usage"))


def recompute_usage(stored: DataFrame, diffs: DataFrame, first_dirty: int) -> DataFrame:
    """Usage rebuilt from the first dirty block on: earlier rows stay, the last clean total is the start."""
    clean = stored.filter(F.col("block_number") < first_dirty)
    start = clean.agg(F.coalesce(F.max_by("storage_usage", "block_number"), F.lit(0)).alias("start"))
    later = running_sum(diffs.filter(F.col("block_number") >= first_dirty), "block_number", "diff", "total")
    later = later.crossJoin(F.broadcast(start)).select("block_number", F.greatest(F.col("total") + F.col("start"), F.lit(0)).alias("storage_usage"))
    return clean.select("block_number", "storage_usage").unionByName(later)


def oldest_unprocessed(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """The lowest block without clean statistics."""
    clean = stats.filter("not is_dirty").select("block_number")
    return blocks.join(clean, "block_number", "left_anti").agg(F.min("block_number").alias("block_number"))


def mark_dirty(stats: DataFrame, first: int) -> DataFrame:
    return stats.withColumn("is_dirty", F.col("is_dirty") | (F.col("block_number") >= first))


def entity_counts(ops: DataFrame) -> DataFrame:
    op = F.col("operation")
    return ops.groupBy("block_number").agg(
        F.count_if(op == "create").alias("n_create"), F.count_if(op == "update").alias("n_update"), F.count_if(op == "extend").alias("n_extend"),
        F.count_if(op == "changeowner").alias("n_changeowner"), F.count_if((op == "delete") & ~F.col("to_system")).alias("n_deleted"), F.count_if((op == "delete") & F.col("to_system")).alias("n_expired"),
    )


def new_data(history: DataFrame) -> DataFrame:
    """Bytes of data that active creates and updates brought, per block."""
    rows = history.filter((F.col("status") == "active") & ~F.col("operation").isin("extend", "changeowner"))
    return rows.groupBy("block_number").agg(F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).alias("new_bytes"))


def consensus(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """Status of each block against one row of heads: finalized, safe, latest (block numbers) and safe_seconds."""
    b = F.col("block_number")
    status = F.when(b <= F.col("finalized"), "finalized").when(b <= F.col("safe"), "safe").when(b <= F.col("latest"), "unsafe").otherwise("unknown")
    df = blocks.select("block_number").crossJoin(F.broadcast(heads)).withColumn("consensus_status", status)
    return df.select("block_number", "consensus_status", F.when(F.col("consensus_status") == "unsafe", F.col("safe_seconds") + UNSAFE_DELAY).alias("expected_safe_seconds"))


def block_stats(ops: DataFrame, history: DataFrame, blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """Counts, new bytes, storage and consensus of every block."""
    out = entity_counts(ops).join(new_data(history), "block_number", "left").join(storage_usage(storage_diff(history, blocks)), "block_number")
    return out.join(consensus(blocks, heads), "block_number").withColumn("new_bytes", F.coalesce("new_bytes", F.lit(0)))


def gas_info(transactions: DataFrame, inbox: int) -> DataFrame:
    """Last and average gas of successful consensus transactions to the inbox, by integer division."""
    t = transactions.filter((F.col("to_address") == inbox) & (F.col("status") == 1) & F.col("block_consensus"))
    newest = F.struct("block_number", "tx_index")
    return t.agg(F.max_by(F.col("cumulative_gas_used") * F.col("gas_price"), newest).alias("last_fee"), F.expr("sum(cumulative_gas_used) div count(*)").alias("average_gas"))
