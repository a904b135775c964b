"""Queues, reorganisations and late operations: every condition splits the rows, and repeated rows have one result."""

from pyspark.sql import functions as F

from strandbook.operators import costs, fold, sinks
from strandbook.plans import queues
from strandbook.plans.catalog import Ledger

DIR = "/root/testdata/sf0.001"


def test_reorganisation_drops_some_entities_and_keeps_others(spark):
    x = Ledger(spark, DIR)
    before = {r[0] for r in fold.snapshot(fold.history(queues.scattered(x))).select("entity_key").collect()}
    after = {r["entity_key"] for r in queues.QUERIES["reorg_drop_entities"](spark, DIR).collect()}
    assert after < before and 0.05 * len(before) < len(before - after) < 0.6 * len(before)


def test_feeds_leave_rows_out(spark):
    x = Ledger(spark, DIR)
    errors = x.events("event_type = 'error'").count()
    assert 0 < queues.QUERIES["feed_delete_logs_routed"](spark, DIR).count() < errors
    third = queues._events(x).filter("amount % 3 = 0").count()
    assert 0 < queues.QUERIES["feed_reorg_cleanups_mixed"](spark, DIR).count() < third


def test_costs_mark_what_they_change_and_nothing_else(spark):
    seen = {(r["refold"], r["dirty"]) for r in queues.QUERIES["apply_cost_events"](spark, DIR).collect()}
    assert {(True, True), (True, False), (False, False)} <= seen
    ops = spark.createDataFrame([("e", "t", 0, 1, 5), ("e", "u", 0, 2, None), ("f", "v", 0, 3, 7), ("g", "w", 0, 3, None)], "entity_key string, tx_hash string, op_index int, block_number int, cost int")
    told = spark.createDataFrame([("t", 0, 5), ("u", 0, 3), ("u", 0, 9), ("u", 0, 9), ("v", 0, None), ("nobody", 0, 1)], "tx_hash string, op_index int, cost int")
    priced, keys, blocks = costs.repriced(ops, told)
    assert {(r["tx_hash"], r["cost"]) for r in priced.collect()} == {("t", 5), ("u", 9), ("v", 7), ("w", None)} and priced.count() == 4
    assert [r[0] for r in keys.collect()] == ["e"] and [r[0] for r in blocks.collect()] == [2]
    again = costs.repriced(priced, told)
    assert again[1].count() == 0 and again[2].count() == 0
    assert costs.repriced(ops, told.limit(0))[1].count() == 0


def test_cost_words_add_up_in_the_fold(spark):
    x = Ledger(spark, DIR)
    logs = queues.cost_logs(x).select("tx_hash", "op_index", costs.event_cost(F.col("topic"), F.col("data"), queues.CREATED, queues.UPDATED, queues.EXTENDED).alias("cost"))
    assert logs.filter("cost is null").count() > 0
    ops, keys, _ = costs.repriced(queues.scattered(x).withColumn("cost", F.lit(None).cast("binary")), logs)
    got = {r["entity_key"]: int(r["total"]) for r in fold.refold(ops, keys).groupBy("entity_key").agg(F.max(F.col("total_cost").cast("decimal(38,0)")).alias("total")).collect()}
    plain = queues.scattered(x).join(logs.filter("cost is not null").select("tx_hash"), "tx_hash").groupBy("entity_key").agg(F.sum("cost").alias("total"))
    assert got == {r["entity_key"]: r["total"] for r in plain.collect()}


def test_upsert_takes_the_last_by_order_wherever_rows_lie(spark):
    old = spark.createDataFrame([("a", 1, "x", True), ("b", 2, "y", True)], "k string, version int, v string, is_dirty boolean")
    new = spark.createDataFrame([("a", 5, "p"), ("a", 7, "q"), ("a", 7, "r"), ("c", None, None), ("c", None, None), (None, 1, "n")], "k string, version int, v string")
    want = {("a", 7, "r", None), ("b", 2, "y", True), ("c", None, None, None), (None, 1, "n", None)}
    for parts in (1, 7):
        assert {tuple(r) for r in sinks.upsert(old, new.repartition(parts), ["k"], ("version",)).collect()} == want
    assert sinks.upsert(old, new.limit(0), ["k"]).count() == 2
    assert sinks.upsert(old.select("k"), new.select("k"), ["k"]).count() == 4


def test_long_forecast_has_many_periods(spark):
    assert queues.QUERIES["chart_storage_forecast_long_daily"](spark, DIR).count() > 10
    rows = [r["live"] for r in queues.QUERIES["chart_storage_forecast_long_hourly"](spark, DIR).orderBy("period").collect()]
    assert rows == sorted(rows, reverse=True) and rows[0] > rows[-1]
