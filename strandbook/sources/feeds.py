"""Queues of work as table jobs: what a batch or stream of chain rows asks to be processed.

Each feed is a plain filter or join, so that the same function serves a batch read (the backfill of a queue)
and ``readStream``. Queues are keyed; ``new_rows`` makes inserts idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_transactions(transactions: DataFrame, storage) -> DataFrame:
    """Successful transactions to the storage address that are in a block and carry input."""
    t = transactions.filter((F.col("to_address") == F.lit(storage)) & (F.col("status") == 1) & F.col("block_number").isNotNull() & (F.octet_length("input") > 0))
    return t.select(F.col("tx_hash"), "block_number", "tx_index").dropDuplicates(["tx_hash"])


def delete_logs(logs: DataFrame, transactions: DataFrame, topic, system) -> DataFrame:
    """Logs of the delete event whose transaction went to the system address."""
    sent = transactions.filter(F.col("to_address") == F.lit(system)).select("tx_hash")
    return logs.filter(F.col("first_topic") == F.lit(topic)).join(sent, "tx_hash", "left_semi").select("tx_hash", "block_hash", "index")


def topic_logs(logs: DataFrame, topics: list) -> DataFrame:
    """Logs with one of the topics: the feed of cost events and of bridge events."""
    return logs.filter(F.col("first_topic").isin(topics)).select("tx_hash", "block_hash", "index", "first_topic")


def pending_bridge_logs(logs: DataFrame, topics: list, done: DataFrame) -> DataFrame:
    """Logs with one of the bridge's topics whose (tx_hash, index) is not done, with their position; ``route_bridge_logs`` takes them in any order."""
    return logs.filter(F.col("first_topic").isin(topics)).join(done.select("tx_hash", "index").distinct(), ["tx_hash", "index"], "left_anti")


def orphaned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Transactions that were in a block and are in none any more."""
    return before.filter("block_hash is not null").select("tx_hash").join(after.filter("block_hash is null").select("tx_hash"), "tx_hash", "left_semi")


def new_rows(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the target does not have yet, one of each key (insert or ignore)."""
    return rows.dropDuplicates(key).join(target.select(*key).distinct(), key, "left_anti")


def waiting(queue: DataFrame, transactions: DataFrame, cleanups: DataFrame, batch: int = 100) -> DataFrame:
    """The next ``batch`` queued rows in order of position, of successful transactions that await no cleanup."""
    ready = transactions.filter("status = 1 and block_number is not null").select("tx_hash", "block_number", "tx_index")
    order = ["block_number", "tx_index", *(["index"] if "index" in queue.columns else [])]
    kept = queue.select(*(c for c in queue.columns if c not in ("block_number", "tx_index"))).join(ready, "tx_hash").join(cleanups.select("tx_hash").distinct(), "tx_hash", "left_anti")
    return kept.orderBy(*order, "tx_hash").limit(batch)


def depths(queues: dict[str, DataFrame]) -> DataFrame:
    """queue, pending: how many rows each queue holds."""
    found = None
    for name, rows in queues.items():
        one = rows.agg(F.count("*").alias("pending")).select(F.lit(name).alias("queue"), "pending")
        found = one if found is None else found.unionByName(one)
    return found
