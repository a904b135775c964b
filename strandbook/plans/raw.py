"""Queries on the chain's side of the ledger: payloads, logs and queues made from the given tables, and what decoding gives.

Payloads are encoded from the tables with expressions, decoded by the operators, and held against SQL on the
tables themselves. A second binding of the operation log has many operations in a block and a transaction, so
that every part of their order counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rlp, texts
from ..functions.hashing import word
from ..operators import blockstats, charts, decode, fold, lookups, sinks, timeseries
from ..scratch import Scratch
from ..sources import bind, feeds
from ..streaming.tick import Ledger as Stored
from . import sql
from .catalog import HISTORY, SNAPSHOT, Ledger

GROUP = 5  # events of one transaction
STORAGE, SYSTEM, DEPOSITED, PROVEN, FINALIZED = 1, 2, b"\x01" * 32, b"\x02" * 32, b"\x03" * 32
AMOUNT = "cast(round(value * 100) as bigint)"
KINDS = ("create", "delete", "update", "extend", "changeowner")


def _events(x: Ledger) -> DataFrame:
    return bind.table(x.spark, x.dir, "events").withColumn("amount", F.expr(AMOUNT))


def payloads(x: Ledger) -> DataFrame:
    """(tx_hash, tx_no, largest, input): one transaction for each GROUP events, encoded as the payload that holds them."""
    strings = rlp.rlp_list(rlp.rlp_list(rlp.rlp_text(F.lit("kind")), rlp.rlp_text(F.col("event_type"))))
    numbers = rlp.rlp_list(rlp.rlp_list(rlp.rlp_text(F.lit("amount")), rlp.rlp_number(F.col("amount"))))
    key, btl, kind, body = rlp.rlp_bytes(word("user_id")), rlp.rlp_number(F.col("amount")), rlp.rlp_text(F.lit("text/plain")), rlp.rlp_text(F.col("props"))
    address = F.unhex(F.lpad(F.hex(F.col("event_id") % 97), 40, "0"))
    items = {
        "create": ("signup", rlp.rlp_list(btl, kind, body, strings, numbers)), "delete": ("error", key), "update": ("purchase", rlp.rlp_list(key, kind, btl, body, strings, numbers)),
        "extend": ("view", rlp.rlp_list(key, btl)), "changeowner": ("click", rlp.rlp_list(key, rlp.rlp_bytes(address))),
    }

    def joined(event: str, item: Column) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("event_type") == event, F.struct("event_id", item.alias("item")))))  # GROUP items at most
        return F.aggregate(held, F.lit(b""), lambda acc, i: F.concat(acc, i["item"]))

    lists = _events(x).groupBy(F.expr(f"event_id div {GROUP}").alias("tx_no")).agg(F.max("amount").alias("largest"), *(joined(*items[k]).alias(k) for k in KINDS))
    whole = rlp.rlp_list(*(rlp.rlp_list(F.col(k)) for k in ("create", "update", "delete", "extend", "changeowner")))
    return lists.select(word("tx_no").alias("tx_hash"), "tx_no", "largest", whole.alias("input"))


def packed(rows: DataFrame, codec: str = "brotli") -> DataFrame:
    """rows with compressed inputs, as they are sent."""

    def run(batches):
        for batch in batches:
            inputs = [v if v is None else pa.compress(v, codec=codec, asbytes=True) for v in batch.column("input").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("input"), "input", pa.array(inputs, pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def operations(x: Ledger) -> DataFrame:
    return decode.explode_operations(decode.decode_storage_tx(packed(payloads(x))))


def _number(data: Column | str) -> Column:
    """The last eight bytes of a word as a bigint."""
    return F.conv(F.hex(F.expr(f"substring({data}, -8, 8)")), 16, 10).cast("bigint")


def _operations(x: Ledger) -> DataFrame:
    made = F.col("operation") == "create"
    return operations(x).select(
        "tx_no", "op_index", "operation", F.when(~made, _number("entity_key")).alias("entity"), F.octet_length("entity_key").alias("key_bytes"), F.col("btl").cast("bigint").alias("btl"),
        "content_type", F.decode("data", "utf-8").alias("data"), _number("new_owner").alias("new_owner"),
    )


def _attributes(x: Ledger) -> DataFrame:
    return decode.explode_attributes(operations(x), None).select(_number("tx_hash").alias("tx_no"), "op_index", "key", "value")


def _quarantine(x: Ledger) -> DataFrame:
    """Payloads, of which those with an amount above 10000 have lost their last byte."""
    cut = F.when(F.col("largest") > 10000, F.expr("substring(input, 1, octet_length(input) - 1)")).otherwise(F.col("input"))
    return decode.quarantined(decode.decode_storage_tx(payloads(x).withColumn("input", cut), compression=None)).select(_number("tx_hash").alias("tx_no"))


def bridge_logs(x: Ledger) -> DataFrame:
    """One log of each order: deposited, proven or unknown by its status."""
    o = bind.table(x.spark, x.dir, "orders")
    status, topic = F.col("o_orderstatus"), lambda b: F.lit(b)
    calldata = F.encode("o_orderpriority", "utf-8")
    gas = F.unhex(F.lpad(F.hex(F.col("o_orderkey")), 16, "0"))
    inner = F.concat(word(F.expr("cast(round(o_totalprice) as bigint)")), word("o_custkey"), gas, F.unhex(F.lpad(F.hex((F.col("o_custkey") % 2).cast("bigint")), 2, "0")), calldata)
    data = F.concat(word(F.lit(32).cast("bigint")), word(F.octet_length(inner).cast("bigint")), inner)
    flag = word((F.col("o_custkey") % 3).cast("bigint"))
    return o.select(
        word("o_orderkey").alias("tx_hash"), word("o_custkey").alias("block_hash"), F.col("o_orderkey").alias("index"),
        F.when(status == "F", topic(DEPOSITED)).when(status == "O", topic(PROVEN)).otherwise(topic(FINALIZED)).alias("first_topic"),
        word("o_custkey").alias("second_topic"), word("o_orderkey").alias("third_topic"),
        F.when(status == "F", topic(bytes(32))).otherwise(word("o_custkey")).alias("fourth_topic"), F.when(status == "F", data).otherwise(flag).alias("data"),
    )


def _routed(x: Ledger, kind: str) -> DataFrame:
    return decode.route_bridge_logs(bridge_logs(x), DEPOSITED, PROVEN, FINALIZED)[kind]


def _deposits(x: Ledger) -> DataFrame:
    return decode.decode_deposits(_routed(x, "deposited")).select(
        "index", _number("`from`").alias("from_no"), _number("`to`").alias("to_no"), F.octet_length("source_hash").alias("hash_bytes"), _number("mint").alias("mint"), _number("value").alias("value"),
        F.col("gas_limit").cast("bigint").alias("gas_limit"), "is_creation", F.decode("calldata", "utf-8").alias("calldata"), "error",
    )


def chain_transactions(x: Ledger) -> DataFrame:
    """Storage transactions of the events: one each, in the block of its hour; errors go to the system."""
    hour = F.expr(f"(us - {bind.EPOCH_MICROS}) div 3600000000")
    e = _events(x).withColumn("us", bind.micros(F.col("ts")))
    to = F.when(F.col("event_type") == "error", SYSTEM).otherwise(STORAGE)
    return e.select(
        F.col("event_id").alias("tx_hash"), hour.alias("block_number"), F.when(F.col("amount") % 11 != 0, hour).alias("block_hash"), (F.col("event_id") % 10).alias("tx_index"), to.alias("to_address"),
        F.when(F.col("amount") % 13 == 0, 0).otherwise(1).alias("status"), F.encode("props", "utf-8").alias("input"), F.col("user_id").alias("from_address"), F.expr("us div 1000000").alias("block_seconds"),
    )


def chain_logs(x: Ledger) -> DataFrame:
    return _events(x).select(F.col("event_id").alias("tx_hash"), F.col("user_id").alias("block_hash"), (F.col("event_id") * 3).alias("index"), F.col("event_type").alias("first_topic"), F.when(F.col("amount") % 5 != 0, F.col("user_id")).alias("second_topic"))


def _waiting(x: Ledger) -> DataFrame:
    t = chain_transactions(x)
    queue, cleanups = feeds.pending_transactions(t, STORAGE), t.filter("block_hash is null").select("tx_hash")
    return feeds.waiting(queue, t, cleanups)


def _depths(x: Ledger) -> DataFrame:
    t, logs = chain_transactions(x), chain_logs(x)
    done = t.filter("block_hash is null").select("tx_hash")
    return feeds.depths({
        "transactions": feeds.new_rows(feeds.pending_transactions(t, STORAGE), done, ["tx_hash"]), "deletes": feeds.delete_logs(logs, t, "error", SYSTEM),
        "costs": feeds.topic_logs(logs, ["signup", "purchase", "view"]), "cleanups": feeds.orphaned(t.withColumn("block_hash", F.col("block_number")), t),
    })


def _consensus(x: Ledger) -> DataFrame:
    t = chain_transactions(x)
    blocks = t.groupBy(F.col("block_number").alias("hash")).agg(F.min("block_seconds").alias("seconds")).select("hash", F.col("hash").alias("number"), "seconds", (F.col("hash") % 4 != 0).alias("consensus"))
    return decode.consensus_transactions(t, blocks).select("tx_hash", "block_number", "block_seconds", "tx_index")


def dense(x: Ledger) -> DataFrame:
    """The operation log with an hour's events in one block, ten transaction places, and the place of an operation within."""
    ops = x.ops
    return ops.select(
        "entity_key", F.expr("tx_hash div 3").alias("tx_hash"), F.expr("(tx_hash div 3) * 7 % 10").alias("tx_index"), (2 - F.col("tx_hash") % 3).alias("op_index"), "operation",
        F.expr("block_number div 1800").alias("block_number"), "block_seconds", "sender", "to_system", "data", "btl", "new_owner", "cost", F.when(F.col("data").isNotNull(), F.concat(F.lit("text/"), F.col("tx_hash") % 4)).alias("content_type"),
        F.col("tx_hash").alias("event_id"),
    )


def _wide(x: Ledger) -> DataFrame:
    """Costs of about 10**31: the amount fourteen bytes up in the word."""
    shifted = F.unhex(F.concat(F.lpad(F.hex("cost"), 64 - 22, "0"), F.lit("0" * 22)))
    return fold.total_cost_wide(x.ops.withColumn("cost_word", shifted)).select("entity_key", "tx_hash", "total_cost")


def _streamed(x: Ledger) -> DataFrame:
    """The snapshot after all operations have come as a stream."""
    scratch = Scratch(x.spark)
    e = bind.table(x.spark, x.dir, "events")
    stored = Stored(x.spark, f"{scratch.root}/ledger", x.ops.schema)
    source = x.spark.readStream.schema(e.schema).parquet(f"{x.dir}/event[s].parquet")  # a pattern, as the source takes a folder or files that fit one
    query = stored.run(bind.operations_of(source), f"{scratch.root}/offsets")
    query.awaitTermination()
    return stored.snapshot.read().select(*SNAPSHOT)


def _recomputed(x: Ledger) -> DataFrame:
    """Storage usage where all blocks from the middle on were dirty."""
    diffs = x.diffs
    stored = blockstats.storage_usage(diffs)
    stats = stored.withColumn("is_dirty", F.lit(False))
    middle = x.ops.agg(F.expr("percentile_approx(block_number, 0.5)").alias("m")).first()["m"]
    dirty = blockstats.mark_dirty(stats, middle)
    first = blockstats.oldest_unprocessed(x.blocks, dirty).first()["block_number"]
    return blockstats.recompute_usage(stored, diffs, first)


def _upserted(x: Ledger) -> DataFrame:
    t = x.txs.select("hash", "gas_price", F.lit(True).alias("is_dirty"))
    return sinks.upsert(t, t.filter("gas_price % 2 = 0").select("hash", (F.col("gas_price") * 2).alias("gas_price"), F.lit(False).alias("is_dirty")), ["hash"])


def _activated(x: Ledger) -> DataFrame:
    attributes = x.ops.filter("data is not null").select("entity_key", "tx_hash", "op_index", F.lit("data").alias("key"), F.col("data").alias("value"))
    return fold.activate_attributes(attributes, fold.active_attribute_source(x.ops)).select("entity_key", "tx_hash", "active")


def _day(x: Ledger, after: int) -> int:
    return bind.EPOCH_MICROS // 1000000 + after * 86400


TYPED = [*HISTORY, "tx_index", "op_index", "content_type", "prev_content_type"]

FORMS = {
    "decode_storage_tx": _operations,
    "explode_attributes": _attributes,
    "quarantined_payloads": _quarantine,
    "decode_deposits": _deposits,
    "decode_withdrawals_proven": lambda x: decode.decode_proven(_routed(x, "proven")).select("index", _number("withdrawal_hash").alias("withdrawal"), _number("`from`").alias("from_no"), _number("`to`").alias("to_no")),
    "decode_withdrawals_finalized": lambda x: decode.decode_finalized(_routed(x, "finalized")).select("index", _number("withdrawal_hash").alias("withdrawal"), "success"),
    "delete_log_operations": lambda x: decode.delete_log_operations(chain_logs(x).filter("first_topic = 'error'"), chain_transactions(x)),
    "decode_extend_log": lambda x: _events(x).select("event_id", decode.extended_expiry(F.concat(word("user_id"), word("amount"))).cast("bigint").alias("expires_at_block")),
    "consensus_transactions": _consensus,
    "feed_pending_transactions": lambda x: feeds.pending_transactions(chain_transactions(x), STORAGE),
    "feed_delete_logs": lambda x: feeds.delete_logs(chain_logs(x), chain_transactions(x), "error", SYSTEM),
    "feed_cost_events": lambda x: feeds.topic_logs(chain_logs(x), ["signup", "purchase", "view"]),
    "feed_reorg_cleanups": lambda x: feeds.orphaned(chain_transactions(x).withColumn("block_hash", F.col("block_number")), chain_transactions(x)),
    "stream_unprocessed_txs": _waiting,
    "pending_counts": _depths,
    "upsert_block_stats": _upserted,
    "drop_entities": lambda x: sinks.drop_keys(x.snapshot, x.events("event_type = 'error'")).select(*SNAPSHOT),
    "stream_entity_snapshot": _streamed,
    "history_fold_dense": lambda x: fold.history(dense(x)).select(*TYPED),
    "entity_snapshot_dense": lambda x: fold.snapshot(fold.history(dense(x))).select(*SNAPSHOT),
    "fold_total_cost_wide": _wide,
    "active_attribute_source_carried": lambda x: fold.active_attribute_source(x.ops, carry_on_owner_change=True),
    "activate_attributes": _activated,
    "storage_usage_recomputed": _recomputed,
    "consensus_gas_info": lambda x: blockstats.gas_info(x.txs, 1),
    "get_full_entity": lambda x: lookups.full_entity(x.snapshot, x.ops, x.blocks).select("entity_key", "status", "created_block", "last_operation", "last_block", "expires_at_seconds"),
    "delete_operation": lambda x: lookups.delete_operation(x.ops),
    "list_entity_keys": lambda x: x.snapshot.select("entity_key"),
    "numeric_attributes_with_relations": lambda x: lookups.attributes_with_relations(x.numbers),
    "list_operations": lambda x: lookups.list_operations(x.ops, x.blocks).select("entity_key", "tx_hash", "op_index", "operation", "block_number", "block_seconds", "expires_at_block"),
    "tx_logs": lambda x: lookups.tx_logs(chain_logs(x).withColumnRenamed("tx_hash", "transaction_hash")).select("transaction_hash", "index", "first_topic"),
    "view_data_usage_net": lambda x: timeseries.data_usage(x.history, net=True),
    "view_storage_forecast_current": lambda x: timeseries.storage_forecast(x.history, current_only=True),
    "chart_data_usage_hourly": lambda x: charts.data_usage(x.history, "HOUR"),
    "chart_data_usage_range": lambda x: charts.data_usage(x.history, "DAY", _day(x, 5), _day(x, 12)),
    "chart_entity_count_hourly": lambda x: charts.entity_count(x.history, "HOUR"),
    "chart_operation_count_updates": lambda x: charts.operation_count(x.ops, "DAY", operation="update"),
    "chart_operation_count_hourly": lambda x: charts.operation_count(x.ops, "HOUR"),
    "chart_storage_forecast_daily": lambda x: charts.storage_forecast(x.forecast, "DAY"),
    "chart_storage_forecast_monthly": lambda x: charts.storage_forecast(x.forecast, "MONTH"),
    "hex_texts": lambda x: _events(x).select("event_id", texts.hex_text(F.encode("props", "utf-8")).alias("props_hex"), F.decode(texts.from_hex(texts.hex_text(F.encode("props", "utf-8"))), "utf-8").alias("props"), F.lower(F.hex(texts.selector(F.encode("props", "utf-8")))).alias("selector")),
}


def _registered(form):
    return lambda spark, sf_dir: form(Ledger(spark, sf_dir))


QUERIES = {name: _registered(form) for name, form in FORMS.items()}

# SQL for DuckDB on the given tables; parts of it come from ``sql``.
EV = "ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS amount FROM events)"
RAW = """raw AS (SELECT event_id // 5 AS tx_no, row_number() OVER (PARTITION BY event_id // 5 ORDER BY CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE 5 END, event_id) - 1 AS op_index,
  event_type, event_id, user_id, amount, props FROM ev)"""
CHAIN = """chain AS (SELECT event_id AS tx_hash, (epoch_us(ts) - 1704067200000000) // 3600000000 AS block_number, CASE WHEN amount % 11 <> 0 THEN (epoch_us(ts) - 1704067200000000) // 3600000000 END AS block_hash, event_id % 10 AS tx_index,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS to_address, CASE WHEN amount % 13 = 0 THEN 0 ELSE 1 END AS status, props, user_id AS from_address, epoch_us(ts) // 1000000 AS block_seconds FROM ev),
queue AS (SELECT tx_hash, block_number, tx_index FROM chain WHERE to_address = 1 AND status = 1 AND octet_length(encode(props)) > 0)"""
DENSE = sql.OPS.replace("event_id AS tx_hash, CAST(0 AS BIGINT) AS tx_index, CAST(0 AS BIGINT) AS op_index", "event_id // 3 AS tx_hash, (event_id // 3) * 7 % 10 AS tx_index, 2 - event_id % 3 AS op_index").replace("// 2000000 AS BIGINT) AS block_number", "// 2000000 // 1800 AS BIGINT) AS block_number").replace("FROM events", ", CASE WHEN event_type IN ('signup', 'purchase') THEN 'text/' || CAST(event_id % 4 AS VARCHAR) END AS content_type FROM events")
TYPES = """typed AS (SELECT n.*, (SELECT max(s.rn) FROM nth s WHERE s.entity_key = n.entity_key AND s.rn <= n.rn AND s.operation IN ('create', 'update', 'delete')) AS since FROM nth n),
kind AS (SELECT t.entity_key, t.rn, s.content_type FROM typed t LEFT JOIN nth s ON s.entity_key = t.entity_key AND s.rn = t.since)"""
HOURLY = "SELECT hour, {value} FROM {view}"


def _range_sql(view: str, value: str, low: int, high: int) -> str:
    return (
        f"SELECT g.t AS moment, CAST(coalesce((SELECT v.{value} FROM ({view}) v WHERE v.moment <= g.t AND v.moment <= {high} ORDER BY v.moment DESC LIMIT 1), 0) AS BIGINT) AS {value} FROM (SELECT unnest(range({low}, {high}, 86400)) AS t) g"
    )


def _filled(view: str, value: str, step: int) -> str:
    return sql._filled(view, "moment", value, step)


START = bind.EPOCH_MICROS // 1000000
DAY_USAGE = "SELECT hour // 86400 * 86400 AS moment, max(data_usage) AS data_usage FROM usage_v GROUP BY 1"
PERIOD = "SELECT (SELECT min(hour) FROM fc) + (hour - (SELECT min(hour) FROM fc)) // {p} * {p} AS period, arg_max(live, hour) AS live FROM fc GROUP BY 1"

ORACLES = {
    "decode_storage_tx": sql.query("""SELECT tx_no, op_index, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'view' THEN 'extend' WHEN 'click' THEN 'changeowner' ELSE 'delete' END AS operation,
      CASE WHEN event_type <> 'signup' THEN user_id END AS entity, 32 AS key_bytes, CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN amount END AS btl, CASE WHEN event_type IN ('signup', 'purchase') THEN 'text/plain' END AS content_type,
      CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS data, CASE WHEN event_type = 'click' THEN event_id % 97 END AS new_owner FROM raw""", EV, RAW),
    "explode_attributes": sql.query("SELECT tx_no, op_index, 'kind' AS key, event_type AS value FROM raw WHERE event_type IN ('signup', 'purchase') UNION ALL SELECT tx_no, op_index, 'amount', CAST(amount AS VARCHAR) FROM raw WHERE event_type IN ('signup', 'purchase')", EV, RAW),
    "quarantined_payloads": sql.query("SELECT event_id // 5 AS tx_no FROM ev GROUP BY 1 HAVING max(amount) > 10000", EV),
    "decode_deposits": "SELECT o_orderkey AS index, o_custkey AS from_no, o_orderkey AS to_no, 32 AS hash_bytes, CAST(round(o_totalprice) AS BIGINT) AS mint, o_custkey AS value, o_orderkey AS gas_limit, o_custkey % 2 <> 0 AS is_creation, o_orderpriority AS calldata, CAST(NULL AS VARCHAR) AS error FROM orders WHERE o_orderstatus = 'F'",
    "decode_withdrawals_proven": "SELECT o_orderkey AS index, o_custkey AS withdrawal, o_orderkey AS from_no, o_custkey AS to_no FROM orders WHERE o_orderstatus = 'O'",
    "decode_withdrawals_finalized": "SELECT o_orderkey AS index, o_custkey AS withdrawal, o_custkey % 3 <> 0 AS success FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "delete_log_operations": sql.query("SELECT e.event_id AS tx_hash, e.user_id AS entity_key, e.event_id * 3 AS op_index, block_number, block_seconds, tx_index, from_address AS sender, to_address AS recipient, 'delete' AS operation FROM ev e JOIN chain c ON c.tx_hash = e.event_id WHERE event_type = 'error' AND amount % 5 <> 0", EV, CHAIN),
    "decode_extend_log": sql.query("SELECT event_id, amount AS expires_at_block FROM ev", EV),
    "consensus_transactions": sql.query("SELECT tx_hash, c.block_number, b.block_seconds, tx_index FROM chain c JOIN (SELECT block_number, min(block_seconds) AS block_seconds FROM chain GROUP BY 1) b ON b.block_number = c.block_hash WHERE c.block_hash % 4 <> 0", EV, CHAIN),
    "feed_pending_transactions": sql.query("SELECT * FROM queue", EV, CHAIN),
    "feed_delete_logs": "SELECT event_id AS tx_hash, user_id AS block_hash, event_id * 3 AS index FROM events WHERE event_type = 'error'",
    "feed_cost_events": "SELECT event_id AS tx_hash, user_id AS block_hash, event_id * 3 AS index, event_type AS first_topic FROM events WHERE event_type IN ('signup', 'purchase', 'view')",
    "feed_reorg_cleanups": sql.query("SELECT tx_hash FROM chain WHERE block_hash IS NULL", EV, CHAIN),
    "stream_unprocessed_txs": sql.query("SELECT tx_hash, block_number, tx_index FROM queue WHERE tx_hash NOT IN (SELECT tx_hash FROM chain WHERE block_hash IS NULL) ORDER BY block_number, tx_index, tx_hash LIMIT 100", EV, CHAIN),
    "pending_counts": sql.query("""SELECT 'transactions' AS queue, count(*) AS pending FROM queue WHERE tx_hash NOT IN (SELECT tx_hash FROM chain WHERE block_hash IS NULL) UNION ALL SELECT 'deletes', count(*) FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'costs', count(*) FROM events WHERE event_type IN ('signup', 'purchase', 'view') UNION ALL SELECT 'cleanups', count(*) FROM chain WHERE block_hash IS NULL""", EV, CHAIN),
    "upsert_block_stats": sql.query("SELECT hash, CASE WHEN gas_price % 2 = 0 THEN gas_price * 2 ELSE gas_price END AS gas_price, gas_price % 2 <> 0 AS is_dirty FROM tx", sql.TX),
    "drop_entities": sql.query(f"SELECT {sql.SNAP_COLUMNS} FROM snap WHERE entity_key NOT IN (SELECT user_id FROM events WHERE event_type = 'error')", *sql.SNAP),
    "stream_entity_snapshot": sql.query(f"SELECT {sql.SNAP_COLUMNS} FROM snap", *sql.SNAP),
    "history_fold_dense": sql.query("SELECT " + ", ".join(f"h.{c.strip()}" for c in sql.HIST_COLUMNS.split(",")) + ", h.tx_index, h.op_index, k.content_type, p.content_type AS prev_content_type FROM hist h JOIN kind k USING (entity_key, rn) LEFT JOIN kind p ON p.entity_key = h.entity_key AND p.rn = h.rn - 1", DENSE, sql.HIST, TYPES),
    "entity_snapshot_dense": sql.query(f"SELECT {sql.SNAP_COLUMNS} FROM snap", DENSE, sql.HIST, sql.LAST),
    "fold_total_cost_wide": sql.query("SELECT entity_key, tx_hash, CAST(sum(CAST(cost AS HUGEINT) * 309485009821345068724781056) OVER (PARTITION BY entity_key ORDER BY rn) AS VARCHAR) AS total_cost FROM nth", *sql.FOLD),
    "active_attribute_source_carried": sql.query("SELECT entity_key, tx_hash AS source_tx, op_index AS source_index FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY block_number DESC, tx_hash DESC) AS n FROM ops WHERE operation NOT IN ('extend', 'changeowner')) WHERE n = 1 AND operation <> 'delete'", sql.OPS),
    "activate_attributes": sql.query("SELECT o.entity_key, o.tx_hash, coalesce(s.operation <> 'delete' AND s.tx_hash = o.tx_hash, false) AS active FROM ops o LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY block_number DESC, tx_hash DESC) AS n FROM ops WHERE operation <> 'extend') s ON s.entity_key = o.entity_key AND s.n = 1 WHERE o.data IS NOT NULL", sql.OPS),
    "storage_usage_recomputed": sql.query("SELECT block_number, storage_usage FROM usage", *sql.FOLD, sql.BLOCKS, sql.DIFFS),
    "consensus_gas_info": sql.query("SELECT (SELECT cumulative_gas_used * gas_price FROM tx WHERE to_address = 1 AND status = 1 AND block_consensus ORDER BY block_number DESC, tx_index DESC LIMIT 1) AS last_fee, CAST(sum(cumulative_gas_used) // count(*) AS BIGINT) AS average_gas FROM tx WHERE to_address = 1 AND status = 1 AND block_consensus", sql.TX),
    "get_full_entity": sql.query("""SELECT s.entity_key, s.status, c.block_number AS created_block, l.operation AS last_operation, l.block_number AS last_block, (SELECT arg_max(block_seconds, block_number) FROM blocks) + 2 * (s.expires_at_block - (SELECT max(block_number) FROM blocks)) AS expires_at_seconds
      FROM snap s JOIN last_row l USING (entity_key) LEFT JOIN hist c ON c.entity_key = s.entity_key AND c.tx_hash = s.created_tx""", *sql.SNAP, sql.BLOCKS),
    "delete_operation": sql.query("SELECT entity_key, tx_hash, sender, block_number FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY rn) AS k FROM nth WHERE operation = 'delete') WHERE k = 1", *sql.FOLD),
    "list_entity_keys": "SELECT DISTINCT user_id AS entity_key FROM events",
    "numeric_attributes_with_relations": "WITH n AS (SELECT doc_id AS entity_key, 'kchars' AS key, n_chars // 1000 AS value FROM documents WHERE doc_id % 10 > 1) SELECT a.entity_key, key, value, count(*) AS related FROM n a JOIN n b USING (key, value) GROUP BY a.entity_key, key, value",
    "list_operations": sql.query("SELECT o.entity_key, o.tx_hash, o.op_index, o.operation, o.block_number, b.block_seconds, o.block_number + coalesce(btl, 0) AS expires_at_block FROM ops o JOIN blocks b USING (block_number)", sql.OPS, sql.BLOCKS),
    "tx_logs": "SELECT event_id AS transaction_hash, event_id * 3 AS index, event_type AS first_topic FROM events",
    "view_data_usage_net": sql.query("""SELECT hour, change, greatest(CAST(sum(change) OVER (ORDER BY hour) AS BIGINT), 0) AS data_usage FROM (SELECT block_seconds // 3600 * 3600 AS hour, CAST(sum(CASE operation WHEN 'create' THEN coalesce(octet_length(encode(data)), 0)
      WHEN 'update' THEN coalesce(octet_length(encode(data)), 0) - coalesce(octet_length(encode(prev_data)), 0) WHEN 'delete' THEN -coalesce(octet_length(encode(prev_data)), 0) ELSE 0 END) AS BIGINT) AS change FROM hist GROUP BY 1)""", *sql.FOLD),
    "view_storage_forecast_current": sql.query("SELECT * FROM fc", *sql.FOLD, sql.LAST, sql.FORECAST.replace("FROM hist WHERE btl", "FROM last_row WHERE status = 'active' AND btl")),
    "chart_data_usage_hourly": sql.query(_filled("SELECT hour AS moment, data_usage FROM usage_v", "data_usage", 3600), *sql.FOLD, sql.HOURS),
    "chart_data_usage_range": sql.query(_range_sql(DAY_USAGE, "data_usage", START + 5 * 86400, START + 12 * 86400), *sql.FOLD, sql.HOURS),
    "chart_entity_count_hourly": sql.query(_filled("SELECT hour AS moment, total FROM count_v", "total", 3600), *sql.FOLD, sql.HOURS),
    "chart_operation_count_updates": sql.query(_filled("SELECT hour // 86400 * 86400 AS moment, max(n) AS n FROM (SELECT block_seconds // 3600 * 3600 AS hour, count(*) AS n FROM ops WHERE operation = 'update' GROUP BY 1) GROUP BY 1", "n", 86400), sql.OPS),
    "chart_operation_count_hourly": sql.query(_filled("SELECT block_seconds // 3600 * 3600 AS moment, count(*) AS n FROM ops GROUP BY 1", "n", 3600), sql.OPS),
    "chart_storage_forecast_daily": sql.query(sql._filled(PERIOD.format(p=86400), "period", "live", 86400), *sql.FOLD, sql.FORECAST),
    "chart_storage_forecast_monthly": sql.query(sql._filled(PERIOD.format(p=30 * 86400), "period", "live", 30 * 86400), *sql.FOLD, sql.FORECAST),
    "hex_texts": "SELECT event_id, '0x' || lower(hex(encode(props))) AS props_hex, props, lower(hex(encode(props)))[1:8] AS selector FROM events",
}
