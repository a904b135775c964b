"""Chain rows arrive as a stream; each micro-batch goes through six stages and is published by one commit.

The stages, in order: cleanups take back transactions, transactions and delete logs bring operations, cost events
price them, the entities touched are folded anew from their whole logs, statistics follow by signed differences. What
a stage does not admit, and costs whose operation is not there yet, waits in a stored queue. There is no watermark:
an operation that comes late refolds its entity.

All tables live in one Store. A batch reads the commit before it, so that a batch that died between any two
writes is repeated from the same rows, and one that was committed is skipped. Tables are in buckets by the hash of
entity or transaction, by range of blocks and by span of hours; a batch reads and writes the buckets it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..operators import fold
from ..operators.store import Store, buckets_of
from ..operators.timeseries import HOUR

KEY = ["tx_hash", "op_index"]
STAGES = ("cleanup", "transaction", "delete", "cost")
BLOCKS_A_RANGE = 4096
HOURS_A_SPAN = 24 * 28
USAGE = "block_number bigint, diff bigint, n bigint, within bigint"
TOTALS = "range bigint, total bigint"
HOURLY = "hour bigint, operation string, expired boolean, n bigint, change bigint, net_change bigint"


def measured(history: DataFrame) -> DataFrame:
    """Hourly counts and bytes of history rows, as the views need them."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    op = F.col("operation")
    change = lambda gone: F.when(op == "create", size("data")).when(op == "update", size("data") - size("prev_data")).when(op == "delete", -gone).otherwise(0)
    hour, expired = F.expr(f"block_seconds div {HOUR} * {HOUR}").alias("hour"), (F.col("status") == "expired").alias("expired")
    return history.groupBy(hour, "operation", expired).agg(F.count("*").alias("n"), F.sum(change(size("data"))).alias("change"), F.sum(change(size("prev_data"))).alias("net_change"))


def block_diffs(history: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    return history.groupBy("block_number").agg(F.sum(size("data") - size("prev_data")).alias("diff"), F.count("*").alias("n"))


def merged(stored: DataFrame, added: DataFrame, taken: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """stored plus the rows of added, less those of taken, per key; keys that count nothing any more are gone."""
    minus = taken.select(*keys, *((-F.col(v)).alias(v) for v in values))
    rows = stored.select(*keys, *values).unionByName(added.select(*keys, *values)).unionByName(minus)
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values)).filter("n <> 0")


class Table:
    """One table of the ledger as of the last commit."""

    def __init__(self, ledger: Ledger, name: str, schema: StructType):
        self.ledger, self.name, self.schema = ledger, name, schema

    def read(self, number: int | None = None) -> DataFrame:
        return self.ledger.store.read(self.name, self.schema, number)


class Ledger:
    """Operations, history, snapshot, statistics, views, queue and quarantine below one folder.

    ``schema`` is that of operations. ``limit``: transactions that a stage admits in a batch (None: all).
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, buckets: int = 64, limit: int | None = None):
        self.spark, self.schema, self.buckets, self.limit = spark, schema, buckets, limit
        self.store = Store(spark, root)
        none = spark.createDataFrame([], schema)
        history = fold.history(none)
        of = lambda ddl: spark.createDataFrame([], ddl).schema
        shapes = {
            "log": schema, "by_tx": none.select(*KEY, "entity_key").schema, "history": history.schema, "snapshot": fold.snapshot(history).schema, "queue": self._tagged(none).schema, "bad": self._tagged(none).schema,
            "usage": of(USAGE), "totals": of(TOTALS), "hourly": of(HOURLY),
        }
        self.tables = {name: Table(self, name, shape) for name, shape in shapes.items()}
        self.log, self.history, self.snapshot, self.bad, self.queue = (self.tables[n] for n in ("log", "history", "snapshot", "bad", "queue"))

    def _tagged(self, batch: DataFrame) -> DataFrame:
        """Columns of operations and ``stage``: cleanup where ``orphaned`` is true, transaction where nothing is said."""
        orphaned = F.coalesce("orphaned", F.lit(False)) if "orphaned" in batch.columns else F.lit(False)
        stage = F.col("stage") if "stage" in batch.columns else F.lit(None).cast("string")
        return batch.withColumn("stage", F.coalesce(F.when(orphaned, "cleanup"), stage, F.lit("transaction"))).select(*self.schema.names, "stage")

    def _admitted(self, waiting: DataFrame) -> DataFrame:
        """Of each stage, the rows of the first transactions in order of position."""
        if self.limit is None:
            return waiting
        first = waiting.groupBy("stage", "tx_hash").agg(F.min(F.struct(F.col("block_number"), F.col("tx_index"))).alias("at"))
        picked = None
        for stage in STAGES:
            some = first.filter(F.col("stage") == stage).orderBy(F.asc_nulls_first("at"), "tx_hash").limit(self.limit).select("stage", "tx_hash")
            picked = some if picked is None else picked.unionByName(some)
        return waiting.join(F.broadcast(picked), ["stage", "tx_hash"], "left_semi")  # limit rows a stage

    def tick(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of operations, orphaned transactions, delete logs (as operations) and costs, told apart by ``stage``.

        Rows without key, kind, block or position go to quarantine, as do costs without amount and cleanups without
        transaction. A cleanup takes back what earlier batches brought; operations that come with it are of
        the new block. Of rows of one batch with one position, the least by key, kind and data counts; a position
        that is known already stays.
        """
        change = self.store.begin(number)
        if change is None:
            return
        of = {name: table.schema for name, table in self.tables.items()}
        by = lambda column: F.pmod(F.xxhash64(column), F.lit(self.buckets))
        rows = self._tagged(batch)
        known = lambda *names: sum((F.col(n).isNull().cast("int") for n in names), F.lit(0)) == 0
        stage = F.col("stage")
        whole = F.when(stage == "cleanup", known("tx_hash")).when(stage == "cost", known(*KEY, "cost")).when(stage.isin("transaction", "delete"), known(*KEY, "entity_key", "operation", "block_number")).otherwise(False)
        rows = change.hold("rows", rows.withColumn("__whole", whole))
        change.append("bad", rows.filter("not __whole").drop("__whole"))
        arrived, queued = rows.filter("__whole").drop("__whole"), change.read("queue", of["queue"])
        gone_now = arrived.unionByName(queued).filter("stage = 'cleanup'").select("tx_hash").distinct()
        # What waits of a transaction that is taken back goes with it.
        queued = queued.join(gone_now, "tx_hash", "left_anti").unionByName(queued.filter("stage = 'cleanup'"))
        waiting = change.hold("waiting", arrived.unionByName(queued))
        admitted = change.hold("admitted", self._admitted(waiting))

        gone = admitted.filter("stage = 'cleanup'").select("tx_hash").distinct()
        pick = F.min(F.struct("entity_key", "operation", "data", F.struct(*self.schema.names).alias("row"))).alias("x")
        ops = admitted.filter("stage in ('transaction', 'delete')").groupBy(*KEY).agg(pick).select("x.row.*")
        # A transaction whose cleanup has not been admitted yet must wait for it.
        held_back = waiting.filter("stage = 'cleanup'").select("tx_hash").distinct().join(gone, "tx_hash", "left_anti")
        ops = change.hold("ops", ops.join(held_back, "tx_hash", "left_anti"))
        costs = admitted.filter("stage = 'cost'").groupBy(*KEY).agg(F.max("cost").alias("__cost"))
        touched_tx = change.hold("transactions", gone.union(ops.select("tx_hash")).union(costs.select("tx_hash")).distinct())
        tx_buckets = buckets_of(touched_tx, by("tx_hash"))
        places = change.read("by_tx", of["by_tx"], tx_buckets).join(touched_tx, "tx_hash", "left_semi")
        kept_places = places.join(gone, "tx_hash", "left_anti")
        added = ops.join(kept_places.select(*KEY), KEY, "left_anti")
        priced = costs.join(kept_places.select(*KEY).unionByName(added.select(*KEY)), KEY, "left_semi")
        keys = added.select("entity_key").union(places.join(gone, "tx_hash", "left_semi").select("entity_key")).union(places.join(priced.select("tx_hash"), "tx_hash", "left_semi").select("entity_key"))
        keys = change.hold("keys", keys.distinct())
        key_buckets = buckets_of(keys, by("entity_key"))

        log = change.read("log", of["log"], key_buckets).join(gone, "tx_hash", "left_anti").unionByName(added.select(*self.schema.names))
        log = log.join(priced, KEY, "left").withColumn("cost", F.coalesce(F.col("__cost").cast(self.schema["cost"].dataType), F.col("cost")))
        change.write("log", log.select(*self.schema.names), by("entity_key"), key_buckets)
        old_places = change.read("by_tx", of["by_tx"], tx_buckets).join(gone, "tx_hash", "left_anti")
        change.write("by_tx", old_places.unionByName(added.select(*KEY, "entity_key")), by("tx_hash"), tx_buckets)

        before = change.read("history", of["history"], key_buckets)
        folded = fold.refold(change.fresh("log", of["log"]), keys)
        taken = before.join(keys, "entity_key", "left_semi")
        change.write("history", fold.replace_by_key(before, folded, keys), by("entity_key"), key_buckets)
        after = change.fresh("history", of["history"]).join(keys, "entity_key", "left_semi")
        state = change.read("snapshot", of["snapshot"], key_buckets)
        change.write("snapshot", fold.replace_by_key(state, fold.snapshot(after), keys), by("entity_key"), key_buckets)

        self._statistics(change, of, block_diffs(taken), block_diffs(after))
        span = F.expr(f"hour div {HOUR * HOURS_A_SPAN}")
        minus, plus = change.hold("hours-taken", measured(taken)), change.hold("hours-added", measured(after))
        spans = buckets_of(minus.unionByName(plus), span)
        values = ["n", "change", "net_change"]
        change.write("hourly", merged(change.read("hourly", of["hourly"], spans), plus, minus, ["hour", "operation", "expired"], values).select(*of["hourly"].names), span, spans)

        left = waiting.join(admitted.select("stage", *KEY).distinct(), (waiting["stage"] == admitted["stage"]) & (waiting["tx_hash"] == admitted["tx_hash"]) & waiting["op_index"].eqNullSafe(admitted["op_index"]), "left_anti")
        early = admitted.filter("stage = 'cost'").join(priced.select(*KEY), KEY, "left_anti")
        early = early.unionByName(admitted.filter("stage in ('transaction', 'delete')").join(held_back, "tx_hash", "left_semi"))
        change.write("queue", left.unionByName(early).dropDuplicates(["stage", *KEY]), F.lit(0), {0})
        change.commit()
        self.store.vacuum()

    def _statistics(self, change, of, taken: DataFrame, added: DataFrame) -> None:
        """Bytes per block with prefix sums within ranges of blocks; a late block redoes its range and shifts the totals after it."""
        in_range = F.expr(f"block_number div {BLOCKS_A_RANGE}")
        taken, added = change.hold("blocks-taken", taken), change.hold("blocks-added", added)
        ranges = buckets_of(taken.unionByName(added), in_range)
        rows = merged(change.read("usage", of["usage"], ranges), added, taken, ["block_number"], ["diff", "n"])
        within = F.sum("diff").over(W.partitionBy(in_range).orderBy("block_number").rowsBetween(W.unboundedPreceding, 0))
        change.write("usage", rows.withColumn("within", within).select(*of["usage"].names), in_range, ranges)
        totals = change.fresh("usage", of["usage"]).groupBy(in_range.alias("range")).agg(F.sum("diff").alias("total"))
        stale = self.spark.createDataFrame([(r,) for r in ranges], "range bigint")
        change.write("totals", change.read("totals", of["totals"]).join(stale, "range", "left_anti").unionByName(totals), F.lit(0), {0})

    def storage_usage(self, number: int | None = None) -> DataFrame:
        """block_number, storage_usage: as if summed over all history; one row per range is added up, the rest is stored."""
        at = self.store.last() if number is None else number
        ahead = F.coalesce(F.sum("total").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
        totals = self.tables["totals"].read(at).select("range", ahead)
        rows = self.tables["usage"].read(at).withColumn("range", F.expr(f"block_number div {BLOCKS_A_RANGE}")).join(totals, "range")
        return rows.select("block_number", F.greatest(F.col("ahead") + F.col("within"), F.lit(0)).cast("bigint").alias("storage_usage"))

    def data_usage(self, number: int | None = None, net: bool = False) -> DataFrame:
        """The view of hourly bytes, from the stored hours."""
        hours = self.tables["hourly"].read(number).groupBy("hour").agg(F.sum("net_change" if net else "change").alias("change"))
        return hours.withColumn("data_usage", F.greatest(F.sum("change").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))

    def operation_count(self, number: int | None = None) -> DataFrame:
        """The view of hourly operations by kind, from the stored hours."""
        return self.tables["hourly"].read(number).groupBy("hour", "operation").agg(F.sum("n").alias("n"))

    def _at(self, name: str, keys: DataFrame, column: str, number: int | None) -> DataFrame:
        """Rows of a table whose ``column`` is among keys, from the buckets of those keys."""
        buckets = buckets_of(keys, F.pmod(F.xxhash64(column), F.lit(self.buckets)))
        table = self.tables[name]
        return self.store.read(name, table.schema, number, buckets).join(keys.select(column).distinct(), column, "left_semi")

    def get_entity(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The snapshot rows of keys (entity_key), as of a commit."""
        return self._at("snapshot", keys, "entity_key", number)

    def get_entity_history(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The history rows of keys (entity_key), in order."""
        return self._at("history", keys, "entity_key", number).orderBy("entity_key", *fold.POSITION)

    def _by_position(self, name: str, positions: DataFrame, number: int | None) -> DataFrame:
        number = self.store.last() if number is None else number  # both tables as of one commit
        places = self._at("by_tx", positions, "tx_hash", number).join(positions.select(*KEY).distinct(), KEY, "left_semi")
        return self._at(name, places, "entity_key", number).join(places, [*KEY, "entity_key"], "left_semi")

    def get_operation(self, positions: DataFrame, number: int | None = None) -> DataFrame:
        """Operations at positions (tx_hash, op_index): the buckets of their transactions tell those of their entities."""
        return self._by_position("log", positions, number)

    def get_entity_operation(self, positions: DataFrame, number: int | None = None) -> DataFrame:
        """History rows at positions (tx_hash, op_index)."""
        return self._by_position("history", positions, number)

    def run(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """Start the stream; without ``every`` (an interval) it takes what is there and ends."""
        writer = stream.writeStream.foreachBatch(self.tick).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
