"""Queries over stored layouts, spans of time and blocks of other chains, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import word
from ..operators import bridge, fold, keyed, ordering, spans
from ..sources import bind, feeds
from . import sql
from .catalog import HISTORY, SNAPSHOT, Ledger
from .raw import DEPOSITED, FINALIZED, PROVEN, _number, bridge_logs

HOUSE, PASSED = b"\xde" * 20, b"\x04" * 32
WIDE_BYTES = 11  # how far the amounts of wide costs are up in their words


def l3_blocks(x: Ledger) -> DataFrame:
    """Blocks of three chains: sixteen neighbouring orders each, deposits and other transactions with their receipts."""
    o = bind.table(x.spark, x.dir, "orders").withColumn("amount", F.expr("cast(round(o_totalprice) as bigint)"))
    address = lambda n: F.substring(word(n), 13, 20)
    custkey, key = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("t"), key)
    deposit = F.col("o_orderstatus") != "O"
    tx = F.struct(
        F.when(deposit, 126).otherwise(2).alias("type"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(HOUSE)).otherwise(address(custkey)).alias("from"),
        F.when(custkey % 4 != 0, address(custkey + 1)).alias("to"), name.alias("hash"), F.when(deposit, F.concat(F.lit("s"), key)).alias("source_hash"),
    )
    other = F.struct(F.array(word(key)).alias("topics"), word(custkey).alias("data"))
    passed = F.struct(
        F.array(F.lit(PASSED), word(key), word(custkey), word(custkey + 1)).alias("topics"),
        F.concat(word("amount"), word(key), word(custkey), word(key + 7)).alias("data"),
    )
    logs = F.when(deposit, F.array_repeat(other, 0)).when(custkey % 5 == 0, F.array(other)).otherwise(F.array(other, passed))
    receipt = F.struct((F.col("amount") % 2).cast("int").alias("status"), name.alias("tx_hash"), logs.alias("logs"))
    rows = o.select(F.expr("o_orderkey div 16 % 3").alias("chain_id"), F.expr("o_orderkey div 48").alias("number"), F.struct(key.alias("at"), tx.alias("tx"), receipt.alias("receipt")).alias("row"))
    blocks = rows.groupBy("chain_id", "number").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # sixteen at most
    return blocks.select(
        "chain_id", "number", F.concat(F.lit("h"), "number").alias("hash"), (F.col("number") * 12).alias("seconds"),
        F.transform("rows", lambda r: r["tx"]).alias("transactions"), F.transform("rows", lambda r: r["receipt"]).alias("receipts"),
    )


def deposits_of(blocks: DataFrame) -> DataFrame:
    d = bridge.extract_l3_deposits(blocks, HOUSE)
    return d.select("chain_id", "block_number", "block_hash", "tx_hash", "source_hash", _number("`from`").alias("from_no"), _number("`to`").alias("to_no"), "success", "block_seconds")


def withdrawals_of(blocks: DataFrame) -> DataFrame:
    numbers = [_number(c).alias(f"{c}_no") for c in ("nonce", "sender", "target", "value", "gas_limit", "withdrawal_hash")]
    return bridge.extract_l3_withdrawals(blocks, PASSED).select("chain_id", "block_number", "tx_hash", *numbers, "block_seconds")


def _pending_bridge(x: Ledger) -> DataFrame:
    logs = bridge_logs(x)
    done = logs.filter(F.substring("second_topic", -1, 1) < F.lit(b"\x40")).select("tx_hash", "index")
    pending = feeds.pending_bridge_logs(logs, [DEPOSITED, PROVEN, FINALIZED], done)
    return pending.select("index", _number("block_hash").alias("block_no"), F.hex(F.substring("first_topic", 1, 1)).alias("topic"))


def _with_errors(x: Ledger) -> DataFrame:
    return x.events("event_type = 'error'")


def _dear(x: Ledger) -> DataFrame:
    return x.events("value > 100").select("tx_hash", F.lit(0).cast("bigint").alias("op_index"))


def _running_blocks(x: Ledger) -> DataFrame:
    """The block in force when each version of an entity expires: blocks come at uneven times, as only those with operations count."""
    blocks = ordering.followed(x.blocks.select(F.col("block_number").alias("running_block"), F.col("block_seconds").alias("from_seconds")), ["running_block"], "from_seconds", "to_seconds")
    points = fold.with_expiry_seconds(x.history).select("entity_key", "tx_hash", "expires_at_seconds")
    met = spans.span_join(points, spans.spans_of(blocks, "from_seconds", "to_seconds"), "expires_at_seconds", "from_seconds", "to_seconds", how="left")
    return met.select("entity_key", "tx_hash", "expires_at_seconds", "running_block")


def _deep_page(x: Ledger) -> DataFrame:
    lines = bind.table(x.spark, x.dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    # Order and line number repeat: only with the other columns is the order total, up to equal rows.
    return ordering.Pages(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]).page(50)


def _wide_history(x: Ledger) -> DataFrame:
    shifted = F.unhex(F.concat(F.lpad(F.hex("cost"), 64 - 2 * WIDE_BYTES, "0"), F.lit("00" * WIDE_BYTES)))
    return fold.history(x.ops.withColumn("cost", shifted)).select(*HISTORY)


FORMS = {
    "extract_l3_deposits": lambda x: deposits_of(l3_blocks(x)),
    "extract_l3_withdrawals": lambda x: withdrawals_of(l3_blocks(x)),
    "stream_bridge_logs": _pending_bridge,
    "get_entity": lambda x: keyed.KeyedRows(x.snapshot.select(*SNAPSHOT), ["entity_key"]).matching(_with_errors(x)),
    "get_entity_history": lambda x: keyed.KeyedRows(x.history.select(*HISTORY), ["entity_key"]).matching(_with_errors(x)),
    "get_operation": lambda x: keyed.KeyedRows(x.ops, ["tx_hash", "op_index"]).matching(_dear(x)).select("tx_hash", "op_index", "entity_key", "operation", "block_number", "sender", "data", "btl"),
    "get_entity_operation": lambda x: keyed.KeyedRows(x.history.select("op_index", *HISTORY), ["tx_hash", "op_index"]).matching(_dear(x)),
    "running_block_at_expiry": _running_blocks,
    "paginate_stored": _deep_page,
    "history_fold_wide": _wide_history,
}


def _registered(form):
    return lambda spark, sf_dir: form(Ledger(spark, sf_dir))


QUERIES = {name: _registered(form) for name, form in FORMS.items()}

_BROKEN = "(SELECT user_id FROM events WHERE event_type = 'error')"
_DEAR = "(SELECT event_id FROM events WHERE value > 100)"
_L3 = "(SELECT *, o_orderkey // 16 % 3 AS chain_id, o_orderkey // 48 AS block_number, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders)"
_WIDE_COLUMNS = sql.HIST_COLUMNS.replace("total_cost", f"CAST(sum(CAST(coalesce(cost, 0) AS HUGEINT) * {256**WIDE_BYTES}) OVER (PARTITION BY entity_key ORDER BY rn) AS VARCHAR) AS total_cost")

ORACLES = {
    "extract_l3_deposits": f"SELECT chain_id, block_number, 'h' || block_number AS block_hash, 't' || o_orderkey AS tx_hash, 's' || o_orderkey AS source_hash, o_custkey AS from_no, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey + 1 END AS to_no, amount % 2 = 1 AS success, block_number * 12 AS block_seconds FROM {_L3} WHERE o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT'",
    "extract_l3_withdrawals": f"SELECT chain_id, block_number, 't' || o_orderkey AS tx_hash, o_orderkey AS nonce_no, o_custkey AS sender_no, o_custkey + 1 AS target_no, amount AS value_no, o_orderkey AS gas_limit_no, o_orderkey + 7 AS withdrawal_hash_no, block_number * 12 AS block_seconds FROM {_L3} WHERE o_orderstatus = 'O' AND o_custkey % 5 <> 0",
    "stream_bridge_logs": "SELECT o_orderkey AS index, o_custkey AS block_no, CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '02' ELSE '03' END AS topic FROM orders WHERE o_custkey % 256 >= 64",
    "get_entity": sql.query(f"SELECT {sql.SNAP_COLUMNS} FROM snap WHERE entity_key IN {_BROKEN}", *sql.SNAP),
    "get_entity_history": sql.query(f"SELECT {sql.HIST_COLUMNS} FROM hist WHERE entity_key IN {_BROKEN}", *sql.FOLD),
    "get_operation": sql.query(f"SELECT tx_hash, op_index, entity_key, operation, block_number, sender, data, btl FROM ops WHERE tx_hash IN {_DEAR}", sql.OPS),
    "get_entity_operation": sql.query(f"SELECT op_index, {sql.HIST_COLUMNS} FROM hist WHERE tx_hash IN {_DEAR}", *sql.FOLD),
    "running_block_at_expiry": sql.query(
        "SELECT e.entity_key, e.tx_hash, e.expires_at_seconds, b.block_number AS running_block FROM (SELECT entity_key, tx_hash, block_seconds + (expires_at_block - block_number) * 2 AS expires_at_seconds FROM hist) e ASOF LEFT JOIN blocks b ON e.expires_at_seconds >= b.block_seconds",
        *sql.FOLD, sql.BLOCKS,
    ),
    "paginate_stored": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (SELECT count(*) FROM lineitem) AS total_items, CAST(ceil((SELECT count(*) FROM lineitem) / 100) AS BIGINT) AS total_pages FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 100 OFFSET 4900",
    "history_fold_wide": sql.query(f"SELECT {_WIDE_COLUMNS} FROM hist", *sql.FOLD),
}
