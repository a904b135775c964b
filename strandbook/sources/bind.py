"""Ledger tables derived from the given tables: plain projections that read the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MICROS = 1704067200000000  # block 0 starts here
SECONDS_PER_BLOCK = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less time, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log: one operation per event."""
    return operations_of(table(spark, sf_dir, "events"))


def operations_of(e: DataFrame) -> DataFrame:
    """Operations of a table or stream of events."""
    kind = F.col("event_type")
    operation = F.when(kind == "signup", "create").when(kind == "purchase", "update").when(kind == "view", "extend").when(kind == "click", "changeowner").otherwise("delete")
    amount = F.round(F.col("value") * 100).cast("bigint")
    us = micros(F.col("ts"))
    e = e.withColumn("us", us)
    return e.select(
        F.col("user_id").alias("entity_key"),
        F.col("event_id").alias("tx_hash"),
        F.lit(0).cast("bigint").alias("tx_index"),
        F.lit(0).cast("bigint").alias("op_index"),
        operation.alias("operation"),
        F.expr(f"(us - {EPOCH_MICROS}) div {SECONDS_PER_BLOCK * 1000000}").alias("block_number"),
        F.expr("us div 1000000").alias("block_seconds"),
        ((F.col("user_id") * 31 + F.col("event_id")) % 97).alias("sender"),
        (F.col("event_id") % 3 == 0).alias("to_system"),
        F.when(operation.isin("create", "update"), F.col("props")).alias("data"),
        F.when(operation.isin("create", "update", "extend"), amount).alias("btl"),
        F.when(operation == "changeowner", F.col("event_id") % 97).alias("new_owner"),
        amount.alias("cost"),
    )


def blocks(ops: DataFrame) -> DataFrame:
    return ops.groupBy("block_number").agg(
        F.min("block_seconds").alias("block_seconds"), F.sum("cost").alias("gas_used"), (F.count("*") * 1000).alias("gas_limit")
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tenth = F.col("doc_id") % 10
    return d.select(
        F.col("doc_id").alias("entity_key"), F.col("source").alias("owner"), F.col("lang").alias("content_type"),
        F.octet_length("text").cast("bigint").alias("size"), F.col("doc_id").alias("created_block"), (F.col("doc_id") + F.col("n_chars")).alias("expires_at_block"),
        F.when(tenth == 0, "deleted").when(tenth == 1, "expired").otherwise("active").alias("status"),
    )


def string_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pairs = F.inline(F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("key"), F.col("source").alias("value"))))
    return d.select(F.col("doc_id").alias("entity_key"), (F.col("doc_id") % 10 > 1).alias("active"), pairs)


def numeric_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entity_key"), (F.col("doc_id") % 10 > 1).alias("active"), F.lit("kchars").alias("key"), F.expr("n_chars div 1000").alias("value"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("from_address"), (F.col("o_orderkey") % 7).alias("to_address"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("block_number"), F.col("o_orderkey").alias("tx_index"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("status"), (F.col("o_orderstatus") != "P").alias("block_consensus"),
        F.round("o_totalprice").cast("bigint").alias("gas_price"), (F.col("o_orderkey") % 1000).alias("cumulative_gas_used"),
    )


def internal_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("from_address"), F.col("l_partkey").alias("to_address"), F.when(F.col("l_returnflag") == "A", "call").otherwise("create").alias("type"),
        F.col("l_linenumber").cast("bigint").alias("index"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("block_number"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("hash"), F.when(F.col("c_custkey") % 50 != 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("balance"))
