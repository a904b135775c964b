"""The tick: one commit for all tables, retractions on replay, bounded writes, stages, statistics and views."""

import os

import pytest
from pyspark.sql import functions as F

from strandbook.operators import blockstats, fold, timeseries
from strandbook.operators import store as stores
from strandbook.streaming import tick as ticks
from strandbook.streaming.tick import Ledger

OPS = "entity_key string, tx_hash bigint, tx_index bigint, op_index bigint, operation string, block_number bigint, block_seconds bigint, sender bigint, to_system boolean, data string, btl bigint, new_owner bigint, cost bigint"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Ticks of a few rows are many small jobs."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def op(entity, tx, kind, block, data=None, btl=None, index=0, stage="transaction"):
    return (entity, tx, 0, index, kind, block, block * 900, 7, False, data, btl, None, 1, stage)


def gone(tx):
    return (None, tx, *[None] * 11, "cleanup")


def cost(tx, amount, index=0):
    return (None, tx, None, index, *[None] * 8, amount, "cost")


def ledger(spark, path, **how):
    return Ledger(spark, f"file://{path}", spark.createDataFrame([], OPS).schema, **how)


def feed(spark, stored, number, *rows):
    stored.tick(spark.createDataFrame(list(rows), OPS + ", stage string"), number)


def state(stored):
    tables = {n: sorted(map(repr, t.read().collect())) for n, t in stored.tables.items() if n != "bad"}
    return tables


TICKS = [
    [op("a", 1, "create", 1, "xxx", 9), op("b", 2, "create", 5000, "yy", 9)],
    [op("a", 3, "update", 9000, "x" * 50, 9), op("c", 4, "create", 9000, "cc", 3), cost(1, 40)],
    [gone(3), gone(4), op("b", 5, "delete", 4, stage="delete")],
]


def test_a_tick_that_died_is_repeated_from_the_same_rows(spark, tmp_path, monkeypatch):
    clean = ledger(spark, tmp_path / "clean", buckets=4)
    for number, rows in enumerate(TICKS):
        feed(spark, clean, number, *rows)
    want = state(clean)
    assert {(r.entity_key, r.data, r.cost) for r in clean.snapshot.read().collect()} == {("a", "xxx", 40), ("b", "yy", 2)}  # b's late delete lies before its create
    stored = ledger(spark, tmp_path / "dying", buckets=4)
    for number, rows in enumerate(TICKS[:2]):
        feed(spark, stored, number, *rows)
    put, deaths = stores.Change._put, 0
    while True:
        calls = iter(range(100))  # every second of its nine writes, the last included

        def dying(change, *args, calls=calls, last=deaths):
            if next(calls) == last:
                raise KeyboardInterrupt
            return put(change, *args)

        seen = state(stored)
        monkeypatch.setattr(stores.Change, "_put", dying)
        try:
            feed(spark, stored, 2, *TICKS[2])
        except KeyboardInterrupt:
            deaths += 2
            monkeypatch.setattr(stores.Change, "_put", put)
            assert state(stored) == seen  # a reader sees the version before, whole
            continue
        break
    monkeypatch.setattr(stores.Change, "_put", put)
    assert deaths == 10 and state(stored) == want
    feed(spark, stored, 2, *TICKS[2])  # and once more after the commit
    assert state(stored) == want
    names = {p for p in os.listdir(tmp_path / "dying" / "data")}
    used = {f.split("/")[0] for n in stored.store.commits() for b in stored.store.record(n).values() for fs in b.values() for f in fs}
    assert names == used  # nothing of the dead attempts is left


def test_writes_follow_the_touched_keys(spark, tmp_path):
    stored = ledger(spark, tmp_path, buckets=100)
    feed(spark, stored, 0, *(op(f"k{i}", i, "create", 1 + i % 5, f"data {i}", 9) for i in range(400)))
    before = stored.store.record(0)
    feed(spark, stored, 1, op("k7", 1000, "update", 3, "new", 9))
    after = stored.store.record(1)
    for table in ("log", "history", "snapshot", "by_tx"):
        assert len(before[table]) > 90
        assert sum(after[table][b] != before[table].get(b) for b in after[table]) == 1
    assert stored.snapshot.read().filter("entity_key = 'k7' and data = 'new'").count() == 1 and stored.snapshot.read().count() == 400


def test_statistics_and_views_equal_recomputing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ticks, "BLOCKS_A_RANGE", 3)
    monkeypatch.setattr(ticks, "HOURS_A_SPAN", 2)
    stored = ledger(spark, tmp_path, buckets=3)
    batches = [
        [op("a", 1, "create", 1, "x" * 9, 9), op("b", 2, "create", 8, "y" * 20, 9), op("c", 3, "create", 14, "z", 9)],
        [op("a", 4, "update", 5, "x" * 30, 9), op("b", 5, "delete", 9, stage="delete")],  # late: between stored blocks
        [gone(2), op("c", 6, "update", 20, "zz" * 40, 2), op("a", 7, "changeowner", 6)],
        [gone(1), gone(4), op("d", 8, "create", 2, "w", 1)],
        [gone(8), gone(3), gone(6), gone(5), gone(7)],  # nothing is left
    ]
    for number, rows in enumerate(batches):
        feed(spark, stored, number, *rows)
        history = fold.history(stored.log.read())
        blocks = history.select("block_number").distinct()
        want = blockstats.storage_usage(blockstats.storage_diff(history, blocks))
        assert sorted(stored.storage_usage().collect()) == sorted(want.collect())
        for net in (False, True):
            assert sorted(stored.data_usage(net=net).collect()) == sorted(timeseries.data_usage(history, net=net).collect())
        assert sorted(stored.operation_count().collect()) == sorted(timeseries.operation_count(stored.log.read()).collect())
        assert sorted(map(repr, history.collect())) == sorted(map(repr, stored.history.read().collect()))
    # A reader that holds the version before sees it whole.
    assert stored.log.read().count() == 0 and stored.storage_usage(3).count() == 5 == stored.history.read(3).select("block_number").distinct().count()


def test_stages_admit_so_many_and_queues_are_cleaned(spark, tmp_path):
    stored = ledger(spark, tmp_path, buckets=2, limit=2)
    depth = lambda: {r.stage: r["count"] for r in stored.queue.read().groupBy("stage").count().collect()}
    feed(spark, stored, 0, op("a", 1, "create", 1, "x", 9), op("a", 1, "extend", 1, btl=3, index=1), op("b", 2, "create", 2, "y", 9), op("c", 3, "create", 3, "z", 9), cost(3, 70), cost(9, 5), op(None, 4, "update", 3))
    assert depth() == {"transaction": 1, "cost": 2} and stored.bad.read().count() == 1
    feed(spark, stored, 1)
    assert depth() == {"cost": 1}  # the cost of 9 waits for its operation
    assert {r.entity_key: r.cost for r in stored.snapshot.read().collect()} == {"a": 2, "b": 1, "c": 70}
    # Transaction 2 is taken back and comes again in another block, with a cleanup too many for one batch.
    feed(spark, stored, 2, gone(1), gone(2), gone(3), op("b", 2, "create", 8, "again", 9), op("d", 9, "create", 9, "d", 9))
    assert depth() == {"cleanup": 1}
    assert {r.entity_key: (r.data, r.cost) for r in stored.snapshot.read().collect()} == {"b": ("again", 1), "c": ("z", 70), "d": ("d", 5)}
    feed(spark, stored, 3)
    assert depth() == {} and {r.entity_key for r in stored.snapshot.read().collect()} == {"b", "d"}


def test_delete_before_a_late_update_stays(spark, tmp_path):
    stored = ledger(spark, tmp_path)
    feed(spark, stored, 0, op("a", 1, "create", 1, "x", 9))
    feed(spark, stored, 1, op("a", 3, "delete", 3, stage="delete"))
    feed(spark, stored, 2, op("a", 2, "update", 2, "late", 9))
    row = stored.snapshot.read().first()
    assert (row.data, row.status) == (None, "deleted")


@pytest.mark.parametrize("lost", ["stage", "tx_hash"])
def test_rows_of_no_stage_or_transaction_go_to_quarantine(spark, tmp_path, lost):
    stored = ledger(spark, tmp_path)
    rows = spark.createDataFrame([op("a", 1, "create", 1, "x", 9)], OPS + ", stage string").withColumn(lost, F.lit("unheard of") if lost == "stage" else F.lit(None).cast("bigint"))
    stored.tick(rows, 0)
    assert stored.bad.read().count() == 1 and stored.snapshot.read().count() == 0


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    stored = ledger(spark, tmp_path / "ledger", buckets=50)
    feed(spark, stored, 0, *(op(f"e{n}", n, "create", n, f"d{n}", 9) for n in range(40)), op("e3", 60, "update", 70, "new", 9), op("e4", 60, "update", 70, "other", 9, index=1))
    keys = spark.createDataFrame([("e3",), ("e3",), ("e7",), ("none",), (None,)], "entity_key string")
    entities = stored.get_entity(keys)
    assert sorted((r["entity_key"], r["data"]) for r in entities.collect()) == [("e3", "new"), ("e7", "d7")]
    assert len(entities.inputFiles()) <= 3 < len(stored.snapshot.read().inputFiles())
    assert [(r["entity_key"], r["tx_hash"]) for r in stored.get_entity_history(keys).collect()] == [("e3", 3), ("e3", 60), ("e7", 7)]
    at = spark.createDataFrame([(60, 1), (7, 0), (7, 1), (999, 0), (None, 0)], "tx_hash bigint, op_index bigint")
    assert sorted((r["tx_hash"], r["entity_key"], r["operation"], r["data"]) for r in stored.get_operation(at).collect()) == [(7, "e7", "create", "d7"), (60, "e4", "update", "other")]
    assert sorted((r["tx_hash"], r["prev_data"], r["data"]) for r in stored.get_entity_operation(at).collect()) == [(7, None, "d7"), (60, "d4", "other")]
    # A reader that holds a commit goes on seeing it after the next.
    feed(spark, stored, 1, op("e3", 61, "delete", 80))
    status = lambda number: stored.get_entity(keys.filter("entity_key = 'e3'"), number).first()["status"]
    assert (status(0), status(1)) == ("active", "deleted")
