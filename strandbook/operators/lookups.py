"""Lookups, filters and related counts. Point lookups are filters on these bulk forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .fold import POSITION, earliest, latest

DEPOSITS, STORAGE, HOUSEKEEPING = 2, 1, 0


def list_entities(entities: DataFrame, status: str | None = None, owner: str | None = None, strings: DataFrame | None = None, string: tuple[str, str] | None = None,
                  numbers: DataFrame | None = None, number: tuple[str, int] | None = None, active_only: bool = True) -> DataFrame:
    """Entities that meet all filters; attribute filters are semi joins, so that no entity comes twice."""
    out = entities
    for column, value in (("status", status), ("owner", owner)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    for attributes, pair in ((strings, string), (numbers, number)):
        if pair is not None:
            match = attributes.filter((F.col("key") == pair[0]) & (F.col("value") == pair[1]))
            out = out.join(match.filter("active") if active_only else match, "entity_key", "left_semi")
    return out


def list_operations(ops: DataFrame, blocks: DataFrame, condition: Column | None = None) -> DataFrame:
    """Operations with their block's time and expiry (block + btl)."""
    kept = ops if condition is None else ops.filter(condition)
    joined = kept.drop("block_seconds").join(blocks.select("block_number", "block_seconds"), "block_number")
    return joined.withColumn("expires_at_block", F.try_add("block_number", F.coalesce("btl", F.lit(0))))


def count_by_type(ops: DataFrame, kinds: tuple[str, ...] = ("create", "update", "extend", "changeowner", "delete")) -> DataFrame:
    return ops.agg(*(F.count_if(F.col("operation") == k).alias(f"n_{k}") for k in kinds))


def neighbours_in_history(history: DataFrame) -> DataFrame:
    """For each history row, the transactions of the nearest rows before and after it."""
    w = W.partitionBy("entity_key").orderBy(*POSITION)
    return history.select("entity_key", "tx_hash", F.lag("tx_hash").over(w).alias("before_tx"), F.lead("tx_hash").over(w).alias("after_tx"))


def latest_operation(ops: DataFrame) -> DataFrame:
    return latest(ops, ["operation", "tx_hash", "block_number"])


def latest_update(ops: DataFrame) -> DataFrame:
    return latest(ops.filter(F.col("operation").isin("create", "update")), ["operation", "tx_hash", "op_index"])


def create_operation(ops: DataFrame) -> DataFrame:
    return earliest(ops.filter(F.col("operation") == "create"), ["tx_hash", "sender", "block_number"])


def delete_operation(ops: DataFrame) -> DataFrame:
    return earliest(ops.filter(F.col("operation") == "delete"), ["tx_hash", "sender", "block_number"])


def entities_by_tx(snapshot: DataFrame, ops: DataFrame, transactions: Column) -> DataFrame:
    """Entities with an operation in one of the transactions."""
    return snapshot.join(ops.filter(transactions).select("entity_key"), "entity_key", "left_semi")


def tx_logs(logs: DataFrame, topic: bytes | None = None) -> DataFrame:
    return (logs if topic is None else logs.filter(F.col("first_topic") == F.lit(topic))).orderBy("transaction_hash", "index")


def custom_contract_transactions(transactions: DataFrame) -> DataFrame:
    """Transactions to neither storage nor deposits and not from housekeeping; a null recipient is left out."""
    to, sender = F.col("to_address"), F.col("from_address")
    return transactions.filter((to != STORAGE) & (to != DEPOSITS) & (sender != HOUSEKEEPING))


def attributes_with_relations(attributes: DataFrame) -> DataFrame:
    """Active attributes with the number of active rows that share key and value: counted first, then joined."""
    active = attributes.filter("active")
    counts = active.groupBy("key", "value").agg(F.count("*").alias("related"))
    return active.groupBy("entity_key", "key", "value").agg(F.count("*").alias("n_own")).join(counts, ["key", "value"]).select("entity_key", "key", "value", (F.col("n_own") * F.col("related")).alias("related"))


def full_entity(snapshot: DataFrame, ops: DataFrame, blocks: DataFrame) -> DataFrame:
    """Snapshot with creation, latest operation and the expiry time told from the latest block."""
    head = blocks.agg(F.max("block_number").alias("head"), F.max_by("block_seconds", "block_number").alias("head_seconds"))
    created = create_operation(ops).select("entity_key", F.col("block_number").alias("created_block"))
    last = latest_operation(ops).select("entity_key", F.col("operation").alias("last_operation"), F.col("block_number").alias("last_block"))
    out = snapshot.join(created, "entity_key", "left").join(last, "entity_key", "left").crossJoin(F.broadcast(head))
    return out.withColumn("expires_at_seconds", F.col("head_seconds") + 2 * (F.col("expires_at_block") - F.col("head"))).drop("head", "head_seconds")
