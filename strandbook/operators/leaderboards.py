"""Leaderboards, address statistics, averages and the size histogram."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ranked

BINS = 10


def biggest_spenders(transactions: DataFrame) -> DataFrame:
    t = transactions.filter((F.col("cumulative_gas_used") > 0) & (F.col("gas_price") > 0))
    spent = t.groupBy(F.col("from_address").alias("address")).agg(F.sum(F.col("cumulative_gas_used") * F.col("gas_price")).alias("total"))
    return ranked(spent, "total", ["address"])


def data_owned(entities: DataFrame) -> DataFrame:
    owned = entities.filter("status = 'active'").groupBy(F.col("owner").alias("address")).agg(F.sum("size").alias("data_size"))
    return ranked(owned, "data_size", ["address"])


def effectively_largest(entities: DataFrame) -> DataFrame:
    active = entities.filter("status = 'active'").select("entity_key", "size", F.coalesce(F.col("expires_at_block") - F.col("created_block"), F.lit(0)).alias("lifespan"))
    return ranked(active.withColumn("effective_size", F.col("size") * F.col("lifespan")), "effective_size", ["entity_key"])


def entities_created(ops: DataFrame) -> DataFrame:
    made = ops.filter("operation = 'create'").groupBy(F.col("sender").alias("address")).agg(F.count("*").alias("n_created"), F.min("tx_hash").alias("first_tx"))
    return ranked(made, "n_created", ["first_tx"])


def entities_owned(entities: DataFrame) -> DataFrame:
    owned = entities.filter("status = 'active'").groupBy(F.col("owner").alias("address")).agg(F.count("*").alias("n_owned"))
    return ranked(owned, "n_owned", ["address"])


def largest(entities: DataFrame) -> DataFrame:
    return ranked(entities.filter("status = 'active' and size is not null").select("entity_key", "size"), "size", ["entity_key"])


def top_accounts(addresses: DataFrame, transactions: DataFrame) -> DataFrame:
    """Addresses by balance, null balances first."""
    counts = transactions.groupBy(F.col("from_address").alias("hash")).agg(F.count("*").alias("tx_count"))
    return ranked(addresses, "balance", ["hash"]).join(counts, "hash", "left").select(F.col("hash").alias("address"), "balance", "rank", F.coalesce("tx_count", F.lit(0)).alias("tx_count"))


def by_expiry(snapshot: DataFrame, blocks: DataFrame) -> DataFrame:
    """Active entities by expiry, unknown expiry first, with the time told from the latest block."""
    head = blocks.agg(F.max("block_number").alias("head"), F.max_by("block_seconds", "block_number").alias("head_seconds"))
    active = ranked(snapshot.filter("status = 'active'").select("entity_key", "expires_at_block"), "expires_at_block", ["entity_key"])
    return active.crossJoin(F.broadcast(head)).select("entity_key", "expires_at_block", "rank", (F.col("head_seconds") + 2 * (F.col("expires_at_block") - F.col("head"))).alias("expires_at_seconds"))


def address_ranks(boards: dict[str, DataFrame]) -> DataFrame:
    """Rank of every address in each of the boards (address, rank); 0 where it is absent."""
    told = [b.select("address", F.col("rank").alias(f"rank_{n}")) for n, b in boards.items()]
    joined = reduce(lambda a, b: a.join(b, "address", "full"), told)
    return joined.select("address", *(F.coalesce(f"rank_{n}", F.lit(0)).cast("bigint").alias(f"rank_{n}") for n in boards))


def address_stats(snapshot: DataFrame, ops: DataFrame, transactions: DataFrame) -> DataFrame:
    """Entities created, owned and active with their bytes, transactions, and operations of every address."""
    created = snapshot.filter("creator is not null").groupBy(F.col("creator").alias("address")).agg(F.count("*").alias("n_created"))
    active = F.col("status") == "active"
    owned = snapshot.groupBy(F.col("owner").alias("address")).agg(
        F.count("*").alias("n_owned"), F.count_if(active).alias("n_active"), F.coalesce(F.sum(F.when(active, F.octet_length("data"))), F.lit(0)).alias("active_bytes")
    )
    txs = transactions.filter("block_consensus").groupBy(F.col("from_address").alias("address")).agg(F.count("*").alias("n_txs"), F.count_if(F.col("status") == 0).alias("n_failed"))
    done = ops.groupBy(F.col("sender").alias("address")).agg(F.count("*").alias("n_ops"))
    joined = reduce(lambda a, b: a.join(b, "address", "full"), [created, owned, txs, done])
    counts = ("n_created", "n_owned", "n_active", "active_bytes", "n_txs", "n_failed", "n_ops")
    return joined.filter("address is not null").select("address", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts))


def address_activity(transactions: DataFrame, internal: DataFrame) -> DataFrame:
    """First and last block of every address over transactions and internal transactions; top-level calls do not count."""
    inner = internal.filter(~((F.col("type") == "call") & (F.col("index") == 1)))
    span = (F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))
    sides = [df.groupBy(F.col(c).alias("address")).agg(*span) for df, c in ((inner, "from_address"), (inner, "to_address"), (transactions, "from_address"))]
    return reduce(DataFrame.unionByName, sides).groupBy("address").agg(F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"))


def averages(entities: DataFrame) -> DataFrame:
    """Average size and average blocks to live from the head (the last created block), rounded."""
    head = entities.agg(F.max("created_block").alias("head"))
    mean = entities.filter("status = 'active'").agg(F.avg("size").alias("s"), F.avg("expires_at_block").alias("e"))
    return mean.crossJoin(F.broadcast(head)).select(F.round("s").cast("bigint").alias("avg_size"), F.round(F.col("e") - F.col("head")).cast("bigint").alias("avg_btl"))


def size_histogram(entities: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width integer bins of active sizes: bin, low, high, n. Without entities: bins 0-1, 1-2, and so on, all 0."""
    sizes = entities.filter("status = 'active' and size is not null").select("size")
    span = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    step = F.when(F.col("lo").isNull(), 1).otherwise(F.ceil((F.col("hi") - F.col("lo") + 1) / bins)).cast("bigint")
    span = span.select(F.coalesce("lo", F.lit(0)).alias("lo"), "hi", step.alias("step"))
    counts = sizes.crossJoin(F.broadcast(span)).groupBy(F.expr(f"least((size - lo) div step + 1, {bins})").alias("bin")).agg(F.count("*").alias("n"))
    frame = span.select("lo", "hi", "step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"))
    low = F.col("lo") + (F.col("bin") - 1) * F.col("step")
    high = F.when(F.col("hi").isNull(), low + 1).when(F.col("bin") == bins, F.col("hi")).otherwise(low + F.col("step") - 1)
    return frame.select("bin", low.alias("low"), high.alias("high")).join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))
