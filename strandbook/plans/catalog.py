"""Every registered query of the ledger: binding, operator, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blockstats, bridge, costs, fold, leaderboards, lookups, ordering, timeseries
from ..sources import bind

HISTORY = ["entity_key", "tx_hash", "operation", "block_number", "status", "owner", "prev_owner", "prev_status", "data", "prev_data", "expires_at_block", "prev_expires_at_block", "total_cost"]
SNAPSHOT = ["entity_key", "data", "status", "owner", "expires_at_block", "last_tx", "cost", "creator", "created_tx"]


class Ledger:
    """The bound tables of one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    ops = property(lambda self: bind.operations(self.spark, self.dir))
    blocks = property(lambda self: bind.blocks(self.ops))
    history = property(lambda self: fold.history(self.ops))
    snapshot = property(lambda self: fold.snapshot(self.history))
    entities = property(lambda self: bind.entities(self.spark, self.dir))
    strings = property(lambda self: bind.string_attributes(self.spark, self.dir))
    numbers = property(lambda self: bind.numeric_attributes(self.spark, self.dir))
    txs = property(lambda self: bind.transactions(self.spark, self.dir))
    internal = property(lambda self: bind.internal_transactions(self.spark, self.dir))
    addresses = property(lambda self: bind.addresses(self.spark, self.dir))
    diffs = property(lambda self: blockstats.storage_diff(self.history, self.blocks))
    forecast = property(lambda self: timeseries.storage_forecast(self.history))

    @property
    def heads(self) -> DataFrame:
        top = F.max("block_number")
        return self.blocks.agg((top - 1000).alias("finalized"), (top - 100).alias("safe"), (top - 10).alias("latest"), F.max("block_seconds").alias("safe_seconds"))

    def events(self, condition: str) -> DataFrame:
        return bind.table(self.spark, self.dir, "events").filter(condition).select(F.col("user_id").alias("entity_key"), F.col("event_id").alias("tx_hash"))


def _reorg(x: Ledger) -> DataFrame:
    surviving, affected = fold.without_orphans(x.ops, x.events("value > 100"))
    return fold.snapshot(fold.refold(surviving, affected)).select(*SNAPSHOT)


def _entity_histories(x: Ledger) -> DataFrame:
    return x.history.orderBy("entity_key", *fold.POSITION).select("entity_key", "tx_hash", "operation", "status", "owner", "expires_at_block")


def _first_entity(x: Ledger) -> DataFrame:
    first = x.ops.agg(F.min("entity_key").alias("entity_key"))
    return fold.history(x.ops.join(F.broadcast(first), "entity_key", "left_semi")).select("entity_key", "tx_hash", "operation", "status", "owner", "expires_at_block")


def _operations_page(x: Ledger) -> DataFrame:
    listed = lookups.list_operations(x.ops, x.blocks).select("entity_key", "tx_hash", "operation", "block_number", "block_seconds", "expires_at_block")
    return ordering.paginate(listed, ["block_number", "tx_hash"], page=2)


def _listed(x: Ledger) -> DataFrame:
    return lookups.list_entities(x.entities, status="active", strings=x.strings, string=("lang", "en"), numbers=x.numbers, number=("kchars", 2))


def _deposits(x: Ledger) -> DataFrame:
    key = F.col("hash")
    deposits = x.txs.select(key.alias("tx_hash"), key.alias("source_hash"))
    l3 = x.txs.filter(key % 3 == 0).select(key.alias("source_hash"), (key + 1000000).alias("tx_hash"), (key % 2 == 0).alias("success"))
    return bridge.list_deposits(deposits, x.txs, l3)


def _withdrawals(x: Ledger) -> DataFrame:
    side = lambda n: x.txs.filter(F.col("hash") % n == 0).select(F.col("hash").alias("withdrawal_hash"), F.col("hash").alias("tx_hash"), "block_number")
    out = bridge.list_withdrawals(x.txs.select(F.col("hash").alias("withdrawal_hash")), side(2), side(4))
    return out.select(
        "withdrawal_hash", F.col("proven.tx_hash").alias("proven_tx"), F.col("proven.block_number").alias("proven_block"), F.col("finalized.tx_hash").alias("finalized_tx"), F.col("finalized.block_number").alias("finalized_block")
    )


def _ranks(x: Ledger) -> DataFrame:
    snapshot = x.snapshot.withColumn("size", F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint"))
    return leaderboards.address_ranks({
        "spent": leaderboards.biggest_spenders(x.txs), "top": leaderboards.top_accounts(x.addresses, x.txs), "created": leaderboards.entities_created(x.ops),
        "owned": leaderboards.entities_owned(snapshot), "bytes": leaderboards.data_owned(snapshot),
    })


def _costs(x: Ledger) -> DataFrame:
    logs = bind.table(x.spark, x.dir, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("index"), (F.col("event_type") != "error").alias("queued"), F.round(F.col("value") * 100).cast("bigint").alias("cost"))
    return costs.align(logs, "group", "index").filter("queued").select(F.col("group").alias("entity_key"), F.col("index").alias("log_index"), "op_index", "cost")


def _chains(x: Ledger) -> DataFrame:
    k = F.col("s_suppkey")
    s = bind.table(x.spark, x.dir, "supplier")
    return s.select(k.alias("chain_id"), (k * 7 % 1000).alias("last_indexed"), (k * 13 % 1000).alias("latest"), F.lit(100).alias("batch"), (k % 5 != 0).alias("enabled"))


FORMS = {
    "history_fold": lambda x: x.history.select(*HISTORY),
    "entity_snapshot": lambda x: x.snapshot.select(*SNAPSHOT),
    "fold_expiry": lambda x: fold.with_expiry_seconds(x.history).select("entity_key", "tx_hash", "expires_at_block", "expires_at_seconds", "expires_at_seconds_sat"),
    "fold_total_cost": lambda x: x.history.select("entity_key", "tx_hash", "total_cost"),
    "active_attribute_source": lambda x: fold.active_attribute_source(x.ops),
    "refold_affected": lambda x: fold.refold(x.ops, x.events("event_type = 'error'")).select(*HISTORY),
    "reorg_cleanup": _reorg,
    "storage_diff_by_block": lambda x: x.diffs,
    "storage_usage_running": lambda x: blockstats.storage_usage(x.diffs),
    "block_entity_counts": lambda x: blockstats.entity_counts(x.ops),
    "new_data_by_block": lambda x: blockstats.new_data(x.history),
    "block_consensus_status": lambda x: blockstats.consensus(x.blocks, x.heads),
    "block_stats": lambda x: blockstats.block_stats(x.ops, x.history, x.blocks, x.heads),
    "list_entities_by_attribute": _listed,
    "count_entities": lambda x: lookups.list_entities(x.entities, status="active", owner="src1").agg(F.count("*").alias("n")),
    "list_operations_page": _operations_page,
    "count_operations_by_type": lambda x: lookups.count_by_type(x.ops),
    "entity_histories": _entity_histories,
    "entity_history": _first_entity,
    "history_before": lambda x: lookups.neighbours_in_history(x.ops),
    "latest_operation": lambda x: lookups.latest_operation(x.ops),
    "latest_update": lambda x: lookups.latest_update(x.ops),
    "create_operation": lambda x: lookups.create_operation(x.ops),
    "entities_by_tx": lambda x: lookups.entities_by_tx(x.snapshot, x.ops, F.col("operation") == "create").select(*SNAPSHOT),
    "custom_contract_transactions": lambda x: lookups.custom_contract_transactions(x.txs),
    "attributes_with_relations": lambda x: lookups.attributes_with_relations(x.strings),
    "list_deposits": _deposits,
    "list_withdrawals": _withdrawals,
    "leaderboard_biggest_spenders": lambda x: leaderboards.biggest_spenders(x.txs),
    "leaderboard_data_owned": lambda x: leaderboards.data_owned(x.entities),
    "leaderboard_effectively_largest_entities": lambda x: leaderboards.effectively_largest(x.entities),
    "leaderboard_entities_created": lambda x: leaderboards.entities_created(x.ops),
    "leaderboard_entities_owned": lambda x: leaderboards.entities_owned(x.entities),
    "leaderboard_largest_entities": lambda x: leaderboards.largest(x.entities),
    "leaderboard_top_accounts": lambda x: leaderboards.top_accounts(x.addresses, x.txs),
    "leaderboard_entities_by_btl": lambda x: leaderboards.by_expiry(x.snapshot, x.blocks),
    "address_leaderboard_ranks": _ranks,
    "address_stats": lambda x: leaderboards.address_stats(x.snapshot, x.ops, x.txs),
    "address_activity": lambda x: leaderboards.address_activity(x.txs, x.internal),
    "entities_averages": lambda x: leaderboards.averages(x.entities),
    "entity_data_size_histogram": lambda x: leaderboards.size_histogram(x.entities),
    "view_data_usage": lambda x: timeseries.data_usage(x.history),
    "view_entity_count": lambda x: timeseries.entity_count(x.history),
    "view_operation_count": lambda x: timeseries.operation_count(x.ops),
    "view_storage_forecast": lambda x: x.forecast,
    "chart_data_usage_daily": lambda x: timeseries.gap_fill(timeseries.daily(timeseries.data_usage(x.history), "data_usage"), "day", "data_usage", timeseries.DAY),
    "chart_entity_count": lambda x: timeseries.gap_fill(timeseries.daily(timeseries.entity_count(x.history), "total"), "day", "total", timeseries.DAY),
    "chart_operation_count": lambda x: timeseries.gap_fill(timeseries.daily(timeseries.operation_count(x.ops), "n", "sum"), "day", "n", timeseries.DAY),
    "chart_storage_forecast_weekly": lambda x: timeseries.forecast_periods(x.forecast, timeseries.WEEK),
    "chart_block_transactions": lambda x: timeseries.block_transactions(x.txs),
    "chart_block_operations": lambda x: timeseries.block_operations(x.ops),
    "chart_block_gas_usage_limit": lambda x: timeseries.block_gas(x.blocks),
    "align_cost_events": _costs,
    "plan_block_range": lambda x: bridge.plan_block_range(_chains(x)),
    "paginate": lambda x: ordering.paginate(x.txs, ["hash"], page=3, size=50),
    "paginate_with_next": lambda x: ordering.paginate_with_next(x.txs, ["hash"], page=2, size=50),
}


def _registered(form):
    return lambda spark, sf_dir: form(Ledger(spark, sf_dir))


QUERIES = {name: _registered(form) for name, form in FORMS.items()}
