"""Bridge reconciliation: deposits and withdrawals seen from both chains, and block ranges to index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_deposits(deposits: DataFrame, transactions: DataFrame, l3: DataFrame) -> DataFrame:
    """Deposits with their transaction and, where it has arrived, the other chain's side (by source hash)."""
    arrived = l3.select("source_hash", F.col("tx_hash").alias("l3_tx"), F.col("success").alias("l3_success"))
    return deposits.join(transactions.select(F.col("hash").alias("tx_hash"), "block_number", "tx_index"), "tx_hash").join(arrived, "source_hash", "left")


def list_withdrawals(withdrawals: DataFrame, proven: DataFrame, finalized: DataFrame) -> DataFrame:
    """Withdrawals with the proven and finalized sides; a side is a struct, null unless it is whole."""

    def side(df: DataFrame, name: str) -> DataFrame:
        whole = F.col("tx_hash").isNotNull() & F.col("block_number").isNotNull()
        return df.select("withdrawal_hash", F.when(whole, F.struct("tx_hash", "block_number")).alias(name))

    return withdrawals.join(side(proven, "proven"), "withdrawal_hash", "left").join(side(finalized, "finalized"), "withdrawal_hash", "left")


def plan_block_range(chains: DataFrame, strict: bool = False) -> DataFrame:
    """Next blocks of each enabled chain: from last + 1 to min(latest, last + 1 + batch), null when last + 1 >= latest.

    ``strict`` makes a batch exactly ``batch`` blocks and takes a single missing block as work.
    """
    first = F.col("last_indexed") + 1
    last = F.least(F.col("latest"), first + F.col("batch") - (1 if strict else 0))
    due = first <= F.col("latest") if strict else first < F.col("latest")
    return chains.filter("enabled").select("chain_id", F.when(due, first).alias("from_block"), F.when(due, last).alias("to_block"))


def extract_l3_deposits(blocks: DataFrame, housekeeping: bytes, deposit_type: int = 126) -> DataFrame:
    """Deposit transactions of blocks(chain_id, number, hash, seconds, transactions, receipts), zipped with their receipts.

    Housekeeping senders are dropped; contract creations have no recipient and are kept with a null ``to``.
    """
    pairs = blocks.select("chain_id", "number", "hash", "seconds", F.inline(F.arrays_zip(F.col("transactions").alias("tx"), F.col("receipts").alias("receipt"))))
    kept = pairs.filter((F.col("tx.type") == deposit_type) & (F.col("tx.from") != F.lit(housekeeping)))
    return kept.select(
        "chain_id", F.col("tx.from").alias("from"), F.col("tx.to").alias("to"), F.col("number").alias("block_number"), F.col("hash").alias("block_hash"),
        F.col("tx.hash").alias("tx_hash"), F.col("tx.source_hash").alias("source_hash"), (F.col("receipt.status") == 1).alias("success"), F.col("seconds").alias("block_seconds"),
    )


def extract_l3_withdrawals(blocks: DataFrame, passed_topic: bytes) -> DataFrame:
    """The first message-passed log of each receipt: nonce, sender, target by topics, the rest by its data words."""
    receipts = blocks.select("chain_id", "number", "hash", "seconds", F.explode("receipts").alias("receipt"))
    logs = F.filter("receipt.logs", lambda x: F.get(x["topics"], F.lit(0)) == F.lit(passed_topic))
    log = receipts.withColumn("log", F.get(logs, F.lit(0))).filter("log is not null")
    word = lambda i: F.substring("log.data", 1 + 32 * i, 32)
    topic = lambda i: F.get("log.topics", F.lit(i))
    return log.select(
        "chain_id", F.col("number").alias("block_number"), F.col("hash").alias("block_hash"), F.col("receipt.tx_hash").alias("tx_hash"), topic(1).alias("nonce"),
        F.substring(topic(2), 13, 20).alias("sender"), F.substring(topic(3), 13, 20).alias("target"), word(0).alias("value"), word(1).alias("gas_limit"), word(3).alias("withdrawal_hash"),
        F.col("seconds").alias("block_seconds"),
    )
