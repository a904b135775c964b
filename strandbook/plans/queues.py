"""Queries on what queues and reorganisations do to stored tables, on bindings in which every condition splits the rows.

``scattered`` spreads the events over entities of one or two operations, so that a reorganisation leaves some without
any; statistics use the binding with an hour in a block, so that late operations fall into blocks that have statistics;
the forecast uses lifetimes of up to months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import word
from ..operators import blockstats, charts, costs, fold, sinks, timeseries
from ..sources import feeds
from . import sql
from .catalog import SNAPSHOT, Ledger
from .raw import DENSE, STORAGE, SYSTEM, _events, chain_logs, chain_transactions, dense

LONGER = 50  # by which lifetimes are multiplied
CREATED, UPDATED, EXTENDED = b"\x0a" * 32, b"\x0b" * 32, b"\x0c" * 32


def scattered(x: Ledger) -> DataFrame:
    return x.ops.withColumn("entity_key", F.col("entity_key") * 100 + F.col("tx_hash") % 100)


def _before(x: Ledger) -> DataFrame:
    """Transactions as they were: all but some in a block."""
    return chain_transactions(x).join(_events(x).select(F.col("event_id").alias("tx_hash"), "amount"), "tx_hash").withColumn("block_hash", F.when(F.col("amount") % 7 != 0, F.col("block_number")))


def _cleanups(x: Ledger) -> DataFrame:
    return feeds.orphaned(_before(x), _before(x).withColumn("block_hash", F.when(F.col("amount") % 3 != 0, F.col("block_number"))))


def _reorganised(x: Ledger) -> DataFrame:
    """The stored snapshot after a reorganisation: affected entities folded again, those left without operations dropped."""
    ops = scattered(x)
    surviving, affected = fold.without_orphans(ops, _cleanups(x))
    emptied = affected.join(surviving.select("entity_key").distinct(), "entity_key", "left_anti")
    kept = sinks.drop_keys(fold.snapshot(fold.history(ops)).select(*SNAPSHOT), emptied)
    return sinks.upsert(kept, fold.snapshot(fold.refold(surviving, affected)).select(*SNAPSHOT), ["entity_key"])


def _delete_feed(x: Ledger) -> DataFrame:
    """Delete logs where a fourth of their transactions went to another address."""
    elsewhere = chain_transactions(x).withColumn("to_address", F.when(F.col("tx_hash") % 4 == 0, STORAGE).otherwise(F.col("to_address")))
    return feeds.delete_logs(chain_logs(x), elsewhere, "error", SYSTEM)


def _statistics(ops: DataFrame, history: DataFrame) -> DataFrame:
    rows = blockstats.entity_counts(ops).join(blockstats.new_data(history), "block_number", "left")
    return rows.withColumn("new_bytes", F.coalesce("new_bytes", F.lit(0)).cast("bigint")).withColumn("is_dirty", F.lit(False))


def _late_statistics(x: Ledger) -> DataFrame:
    """Stored block statistics after late operations: their blocks are dirty, computed again, and replaced."""
    ops = dense(x)
    late = F.coalesce(F.col("cost") % 11 == 0, F.lit(False))
    early = ops.filter(~late)
    dirty = ops.filter(late).select("block_number").distinct()
    stored = _statistics(early, fold.history(early))
    again = _statistics(ops.join(dirty, "block_number", "left_semi"), fold.history(ops).join(dirty, "block_number", "left_semi"))
    return sinks.upsert(stored.join(dirty.withColumn("__late", F.lit(True)), "block_number", "left").withColumn("is_dirty", F.col("__late").isNotNull()).drop("__late"), again, ["block_number"])


def cost_logs(x: Ledger) -> DataFrame:
    """A log for each operation that has a cost event, its cost in the second or third word; some are cut short."""
    kind, none = F.col("event_type"), F.lit(bytes(32))
    topic = F.when(kind == "signup", F.lit(CREATED)).when(kind == "purchase", F.lit(UPDATED)).when(kind == "view", F.lit(EXTENDED))
    data = F.when(kind == "signup", F.concat(none, word("amount"))).when((kind == "view") & (F.col("amount") % 5 == 0), F.concat(none, none)).otherwise(F.concat(none, none, word("amount")))
    logs = _events(x).filter(topic.isNotNull()).select(F.col("event_id").alias("tx_hash"), F.lit(0).cast("bigint").alias("index"), topic.alias("topic"), data.alias("data"))
    return costs.align(logs, "tx_hash").withColumn("op_index", F.col("op_index").cast("bigint"))


def _priced(x: Ledger) -> DataFrame:
    """Operations priced by cost events, with what has to be folded and counted again; half of the costs were known."""
    logs = cost_logs(x).select("tx_hash", "op_index", costs.event_cost(F.col("topic"), F.col("data"), CREATED, UPDATED, EXTENDED).alias("cost"))
    known = scattered(x).withColumn("cost", F.when(F.col("cost") % 2 == 0, word("cost")))
    ops, keys, blocks = costs.repriced(known, logs)
    marked = ops.join(keys.withColumn("__key", F.lit(True)), "entity_key", "left").join(blocks.withColumn("__block", F.lit(True)), "block_number", "left")
    return marked.select("tx_hash", "entity_key", F.hex("cost").alias("cost_hex"), F.col("__key").isNotNull().alias("refold"), F.col("__block").isNotNull().alias("dirty"))


def _long_forecast(x: Ledger) -> DataFrame:
    return timeseries.storage_forecast(fold.history(x.ops.withColumn("btl", F.col("btl") * LONGER)))


FORMS = {
    "reorg_drop_entities": _reorganised,
    "feed_delete_logs_routed": _delete_feed,
    "feed_reorg_cleanups_mixed": _cleanups,
    "upsert_late_block_stats": _late_statistics,
    "apply_cost_events": _priced,
    "view_storage_forecast_long": _long_forecast,
    "chart_storage_forecast_long_hourly": lambda x: charts.storage_forecast(_long_forecast(x), "HOUR"),
    "chart_storage_forecast_long_daily": lambda x: charts.storage_forecast(_long_forecast(x), "DAY"),
    "chart_storage_forecast_long_weekly": lambda x: charts.storage_forecast(_long_forecast(x), "WEEK"),
    "chart_storage_forecast_long_monthly": lambda x: charts.storage_forecast(_long_forecast(x), "MONTH"),
}


def _registered(form):
    return lambda spark, sf_dir: form(Ledger(spark, sf_dir))


QUERIES = {name: _registered(form) for name, form in FORMS.items()}

SCATTERED = sql.OPS.replace("user_id AS entity_key", "user_id * 100 + event_id % 100 AS entity_key")
LONG_OPS = sql.OPS.replace("CAST(round(value * 100) AS BIGINT) END AS btl", f"CAST(round(value * 100) AS BIGINT) * {LONGER} END AS btl")
CLEANED = "CAST(round(value * 100) AS BIGINT) % 3 = 0 AND CAST(round(value * 100) AS BIGINT) % 7 <> 0"
#: Bytes by hour of their end, summed from the last hour back: the forecast of ``sql`` compares all pairs of hours.
LONG = """clock AS (SELECT max(block_seconds) // 3600 * 3600 AS now FROM hist),
ends AS (SELECT (block_seconds + btl * 2 + 3600) // 3600 * 3600 AS hour, sum(octet_length(encode(data))) AS bytes FROM hist WHERE btl IS NOT NULL AND data IS NOT NULL GROUP BY 1),
live AS (SELECT hour, CAST(coalesce(sum(bytes) OVER (ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS live FROM ends, clock WHERE hour > now),
fc AS (SELECT hour, live FROM live UNION ALL SELECT now, CAST((SELECT coalesce(sum(bytes), 0) FROM ends WHERE hour > now) AS BIGINT) FROM clock)"""


def _periods(step: int) -> tuple[str, str]:
    """The last value of each period, carried over periods without one."""
    points = f"SELECT (SELECT min(hour) FROM fc) + (hour - (SELECT min(hour) FROM fc)) // {step} * {step} AS period, arg_max(live, hour) AS live FROM fc GROUP BY 1"
    return f"SELECT g.t AS period, p.live FROM (SELECT unnest(range((SELECT min(period) FROM points), (SELECT max(period) FROM points) + 1, {step})) AS t) g ASOF JOIN points p ON g.t >= p.period", f"points AS ({points})"


def _chart_sql(step: int) -> str:
    body, points = _periods(step)
    return sql.query(body, LONG_OPS, sql.HIST, LONG, points)


ORACLES = {
    "reorg_drop_entities": sql.query(f"SELECT {sql.SNAP_COLUMNS} FROM snap", SCATTERED, sql.HIST, sql.LAST, where=f"WHERE NOT coalesce({CLEANED}, false)"),
    "feed_delete_logs_routed": "SELECT event_id AS tx_hash, user_id AS block_hash, event_id * 3 AS index FROM events WHERE event_type = 'error' AND event_id % 4 <> 0",
    "feed_reorg_cleanups_mixed": f"SELECT event_id AS tx_hash FROM events WHERE {CLEANED}",
    "upsert_late_block_stats": sql.query("SELECT c.*, coalesce(new_bytes, 0) AS new_bytes, false AS is_dirty FROM counts c LEFT JOIN fresh USING (block_number)", DENSE, sql.HIST, sql.COUNTS, sql.FRESH),
    "apply_cost_events": sql.query(
        """SELECT tx_hash, entity_key, lpad(hex(coalesce(told, known)), 64, '0') AS cost_hex, coalesce(bool_or(new) OVER (PARTITION BY entity_key), false) AS refold, coalesce(bool_or(new) OVER (PARTITION BY block_number), false) AS dirty
      FROM (SELECT *, told IS NOT NULL AND told IS DISTINCT FROM known AS new FROM (SELECT *, CASE WHEN cost % 2 = 0 THEN cost END AS known,
        CASE WHEN operation IN ('create', 'update') OR (operation = 'extend' AND cost % 5 <> 0) THEN cost END AS told FROM ops))""",
        SCATTERED,
    ),
    "view_storage_forecast_long": sql.query("SELECT hour, live FROM fc", LONG_OPS, sql.HIST, LONG),
    "chart_storage_forecast_long_hourly": _chart_sql(3600),
    "chart_storage_forecast_long_daily": _chart_sql(86400),
    "chart_storage_forecast_long_weekly": _chart_sql(7 * 86400),
    "chart_storage_forecast_long_monthly": _chart_sql(30 * 86400),
}
