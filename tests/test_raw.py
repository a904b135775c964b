"""Known answers and odd input for decoding, ranks, keyed tables, the stream's tick and chart arguments."""

import pytest
from pyspark.sql import functions as F

from strandbook.functions import hashing, rlp, texts
from strandbook.operators import charts, decode, fold, ordering, sinks
from strandbook.streaming.tick import Ledger

# Digests that are known for these messages.
KNOWN = {b"": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470", b"abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"}
TX = bytes.fromhex("296508b5285b8596691435c7089e591d2fad7d3756279820347696cdb09197a4")
TEST_KEY = "35d1ae22f8813a630b1a4d6b8660113ed226d684511747b35dd764c7f96251c5"


def test_keccak(spark):
    rows = spark.createDataFrame([(m,) for m in [*KNOWN, None]], "m binary").select(F.lower(F.hex(hashing.keccak256("m"))))
    assert [r[0] for r in rows.collect()] == [*KNOWN.values(), None]
    row = spark.createDataFrame([(TX, b"test", 0)], "t binary, d binary, i bigint").select(F.lower(F.hex(hashing.entity_key("t", "d", "i"))), F.octet_length(hashing.deposit_source_hash("t", "i"))).first()
    assert tuple(row) == (TEST_KEY, 32)
    long = [bytes(n) for n in (135, 136, 137, 272, 1000)]
    assert [hashing.keccak_batch([m]) for m in long] == [[d] for d in hashing.keccak_batch(long)]


def test_encoding_is_read_back(spark):
    sizes = [0, 1, 2, 55, 56, 255, 256, 70000]
    rows = spark.createDataFrame([(n, b"\x7f" * n) for n in sizes], "n bigint, b binary").select("n", rlp.rlp_list(rlp.rlp_bytes(F.col("b")), rlp.rlp_number(F.col("n")), rlp.rlp_list()).alias("e")).collect()
    for r in rows:
        body, number, empty = rlp.read(bytes(r["e"]))
        assert (body, rlp.number(number), empty) == (b"\x7f" * r["n"], r["n"], [])
    for bad in (b"", b"\x81\x01", b"\x82a", b"\xb8\x01a", b"\xc2a", b"aa"):
        with pytest.raises(ValueError):
            rlp.read(bad)


def test_undecodable_payloads_go_to_quarantine(spark):
    empty = bytes([0xC5, 0xC0, 0xC0, 0xC0, 0xC0, 0xC0])
    rows = spark.createDataFrame([(b"1", empty), (b"2", None), (b"3", b"\xff"), (b"4", bytes([0xC4, 0xC0, 0xC0, 0xC0, 0xC0])), (b"5", bytes([0xC6, 0xC1, 0xC0, 0xC0, 0xC0, 0xC0, 0xC0]))], "tx_hash binary, input binary")
    decoded = decode.decode_storage_tx(rows, compression=None)
    assert sorted(bytes(r["tx_hash"]) for r in decode.quarantined(decoded).collect()) == [b"2", b"3", b"4", b"5"]
    assert decode.explode_operations(decoded).count() == 0 and decode.explode_operations(decode.decode_storage_tx(rows.limit(0), compression=None)).count() == 0


def test_bad_deposits_have_errors(spark):
    word, address = bytes(32), bytes(12) + b"a" * 20
    data = bytes(31) + b" " + bytes(31) + bytes([73]) + bytes(73)
    rows = [(1, address, address, word, data), (2, None, address, word, data), (3, address, b"b" * 32, word, data), (4, address, address, b"\x01" * 32, data), (5, address, address, word, data[:100]), (6, address, address, word, None), (7, address, address, word, data[:63] + b"\xff" + data[64:])]
    logs = spark.createDataFrame([(b"t", word, i, *r) for i, *r in rows], "tx_hash binary, block_hash binary, index bigint, second_topic binary, third_topic binary, fourth_topic binary, data binary")
    found = {r["index"]: r for r in decode.decode_deposits(logs).collect()}
    assert [found[i]["error"] for i in range(1, 8)] == [None, "missing topic", "no address", "unsupported version", "short data", "short data", "bad length"]
    assert bytes(found[1]["from"]) == b"a" * 20 and bytes(found[1]["calldata"]) == b"" and found[2]["to"] is None


def test_ranks_cut_equal_values(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 5000, numPartitions=4).select(F.lit(1).alias("v"), F.col("id"), F.lit("x").alias("__note"))
        rows = ordering.ranked(df, "v", ["id"])
        assert rows.filter("rank <> id + 1").count() == 0 and rows.columns == ["v", "id", "__note", "rank"]
        assert ordering._ranged(df, [F.desc("v"), F.asc("id")]).select("__part").distinct().count() > 1
        sums = ordering.running_sum(df, "id", "v", "total")
        assert sums.filter("total <> id + 1").count() == 0 and ordering.running_sum(df.limit(0), "id", "v", "total").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_wide_costs_saturate(spark):
    top = b"\xff" * 32
    rows = [("a", 1, 0, 1, 0, top[:31] + b"\xfe"), ("a", 1, 0, 1, 1, bytes(31) + b"\x01"), ("a", 1, 0, 1, 2, None), ("a", 2, 0, 2, 0, top), ("b", 1, 0, 1, 3, None)]
    ops = spark.createDataFrame(rows, "entity_key string, block_number bigint, tx_index bigint, tx_hash bigint, op_index bigint, cost_word binary")
    got = [r["total_cost"] for r in fold.total_cost_wide(ops).orderBy("entity_key", *fold.POSITION).collect()]
    assert got == [str(2**256 - 2)] + [str(2**256 - 1)] * 3 + ["0"]


OPS = "entity_key string, tx_hash bigint, tx_index bigint, op_index bigint, operation string, block_number bigint, block_seconds bigint, sender bigint, to_system boolean, data string, btl bigint, new_owner bigint, cost bigint"


def op(entity, tx, kind, block, data=None, btl=None):
    return (entity, tx, 0, 0, kind, block, block * 2, 7, False, data, btl, None, 1)


def test_ticks_take_late_repeated_orphaned_and_bad_operations(spark, tmp_path):
    stored = Ledger(spark, f"file://{tmp_path}/ledger", spark.createDataFrame([], OPS).schema)

    def tick(number, *rows, orphaned=()):
        batch = spark.createDataFrame(list(rows), OPS).withColumn("orphaned", F.lit(False))
        gone = spark.createDataFrame([(t, True) for t in orphaned], "tx_hash bigint, orphaned boolean")
        stored.tick(batch.unionByName(gone, allowMissingColumns=True), number)
        return {r["entity_key"]: (r["data"], r["status"]) for r in stored.snapshot.read().collect()}

    assert tick(0, op("a", 1, "create", 1, "x", 9), op("b", 2, "create", 1, "y", 9)) == {"a": ("x", "active"), "b": ("y", "active")}
    assert tick(0, op("a", 1, "create", 1, "other", 9))["a"] == ("x", "active")  # a repeated batch
    assert tick(1, op("a", 4, "delete", 5), op("a", 4, "delete", 5))["a"] == (None, "deleted")
    assert tick(2, op("a", 3, "update", 3, "late", 9))["a"] == (None, "deleted")
    assert tick(3, op(None, 9, "update", 3, "bad", 9), orphaned=[4])["a"] == ("late", "active")
    assert tick(4, orphaned=[2]) == {"a": ("late", "active")}
    assert stored.bad.read().count() == 1 and stored.log.read().count() == 2 and stored.history.read().count() == 2


def test_keyed_tables_and_views(spark, tmp_path):
    table = sinks.KeyedTable(spark, f"file://{tmp_path}/t")
    assert table.versions() == [] and table.read() is None and table.read("k bigint").count() == 0
    for v in range(3):
        table.write(spark.range(v + 1), v)
    (tmp_path / "t" / "v9").mkdir()  # a version that was never completed
    assert table.read().count() == 3
    table.vacuum(keep=1)
    assert table.versions() == [2]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, spark.createDataFrame([(2, "c"), (2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    paths = sinks.refresh_views({"one": lambda: spark.range(2)}, f"file://{tmp_path}/views")
    assert spark.read.parquet(paths["one"]).count() == 2


def test_chart_arguments():
    assert charts.parse_range("2024-01-02", "2024-01-03", "DAY", 0) == (1704153600, 1704240000)
    assert charts.parse_range("2024-01-02 10:30", "2024-01-03 00:00", "HOUR", 1704200000) == (1704189600, 1704200000)
    assert charts.parse_range(None, "2024-01-03 00:00", "HOUR", 5) == (None, 1704240000)
    for bad in (("2024-01-03", "2024-01-02", "DAY", 0), ("2024-01-02 10:30", None, "DAY", 0), (None, None, "YEAR", 0)):
        with pytest.raises(ValueError):
            charts.parse_range(*bad)


def test_texts(spark):
    row = spark.createDataFrame([("0xAb01", "zz", "abc", 1704153600)], "a string, b string, c string, s bigint").select(
        texts.hex_text(texts.from_hex("a")), texts.from_hex("b"), texts.from_hex("c"), texts.from_hex_array(F.array("a", "b")), texts.day_text("s"), texts.hour_text("s"), texts.rfc3339("s"), texts.same_text(F.col("a"), F.lit("0XAB01"))
    ).first()
    assert tuple(row) == ("0xab01", None, None, [b"\xab\x01", None], "2024-01-02", "2024-01-02 00:00", "2024-01-02T00:00:00+00:00", True)
