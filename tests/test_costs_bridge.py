import random

from pyspark.sql import functions as F

from strandbook.operators import bridge, costs

TOPIC, HOUSE = b"\x01" * 32, b"\xde" * 20


def word(n: int) -> bytearray:
    return bytearray(n.to_bytes(32, "big"))


def test_256_bit_words_and_sums(spark):
    rng = random.Random(7)
    numbers = [0, 1, 10**30 - 1, 10**30, 10**60 - 1, 10**60, 2**255, costs.TOP, *(rng.getrandbits(rng.choice((8, 64, 128, 200, 256))) for _ in range(60))]
    df = spark.createDataFrame([(i, word(n)) for i, n in enumerate(numbers)], "i int, w binary").withColumn("x", costs.limbs_of_word(F.col("w")))
    one = df.select("i", costs.plain(costs.as_text(*(F.col("x")[n] for n in costs.LIMBS))).alias("t"))
    assert {r["i"]: int(r["t"]) for r in one.collect()} == dict(enumerate(numbers))
    sums = df.groupBy((F.col("i") % 5).alias("g")).agg(*costs.add_limbs(F.col("x")))
    got = {r["g"]: int(r["t"]) for r in sums.select("g", costs.plain(costs.carry(*(F.col(n) for n in costs.LIMBS))).alias("t")).collect()}
    assert got == {g: min(costs.TOP, sum(numbers[g::5])) for g in range(5)}


def test_event_cost_and_alignment(spark):
    created, updated, extended = b"c" * 32, b"u" * 32, b"e" * 32
    rows = [(0, created, 64), (1, created, 63), (2, updated, 96), (3, extended, 96), (4, extended, 95), (5, b"x" * 32, 96), (6, None, 96)]
    data = b"".join(word(n) for n in (1, 2, 3))
    df = spark.createDataFrame([(i, bytearray(t) if t else None, bytearray(data[:n])) for i, t, n in rows], "i int, topic binary, data binary")
    got = {r["i"]: r["w"] and int.from_bytes(r["w"], "big") for r in df.select("i", costs.event_cost(F.col("topic"), F.col("data"), created, updated, extended).alias("w")).collect()}
    assert got == {0: 2, 1: None, 2: 3, 3: 3, 4: None, 5: None, 6: None}
    logs = spark.createDataFrame([("a", 9), ("a", 4), ("b", 7)], "transaction_hash string, index int")
    assert {(r["transaction_hash"], r["index"], r["op_index"]) for r in costs.align(logs).collect()} == {("a", 4, 0), ("a", 9, 1), ("b", 7, 0)}


def test_unprocessed_waits_for_operations_and_cleanups(spark):
    logs = spark.createDataFrame([(t, "h", i) for t in "abcd" for i in (1, 2)], "transaction_hash string, block_hash string, index int")
    queue = logs.filter("index = 2")
    transactions = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 1)], "transaction_hash string, status int")
    waits = lambda t: spark.createDataFrame([(t,), (t,)], "transaction_hash string")
    got = costs.unprocessed(logs, queue, transactions, waits("c"), waits("d")).collect()
    assert [(r["transaction_hash"], r["index"], r["op_index"]) for r in got] == [("a", 2, 1)]


def test_apply_costs_keeps_what_it_has(spark):
    ops = spark.createDataFrame([("a", 0, "1"), ("a", 1, "1"), ("b", 0, None)], "tx_hash string, op_index int, cost string")
    told = spark.createDataFrame([("a", 1, "5"), ("z", 0, "9")], "tx_hash string, op_index int, cost string")
    assert {(r["tx_hash"], r["op_index"], r["cost"]) for r in costs.apply_costs(ops, told).collect()} == {("a", 0, "1"), ("a", 1, "5"), ("b", 0, None)}


BLOCKS = (
    "chain_id long, number long, hash string, seconds long, "
    "transactions array<struct<type:int,from:binary,to:binary,hash:string,source_hash:string>>, "
    "receipts array<struct<status:int,tx_hash:string,logs:array<struct<topics:array<binary>,data:binary>>>>"
)


def test_l3_deposits_and_withdrawals(spark):
    a, b = bytearray(b"\x0a" * 20), bytearray(b"\x0b" * 20)
    passed = ([bytearray(TOPIC), word(5), bytearray(12) + a, bytearray(12) + b], word(7) + word(8) + word(9) + word(10))
    other = ([word(3)], word(1))
    blocks = [
        (1, 10, "h10", 100, [(126, bytearray(HOUSE), a, "t0", "s0"), (126, a, None, "t1", "s1"), (2, a, b, "t2", None)], [(1, "t0", []), (0, "t1", [other]), (1, "t2", [other, passed, passed])]),
        (1, 11, "h11", 101, [], []),
    ]
    df = spark.createDataFrame(blocks, BLOCKS)
    got = bridge.extract_l3_deposits(df, HOUSE).collect()
    assert [(r["tx_hash"], r["to"], r["source_hash"], r["success"], r["block_number"]) for r in got] == [("t1", None, "s1", False, 10)]
    (r,) = bridge.extract_l3_withdrawals(df, TOPIC).collect()
    assert (r["tx_hash"], r["sender"], r["target"], r["block_seconds"]) == ("t2", a, b, 100)
    assert [int.from_bytes(r[c], "big") for c in ("nonce", "value", "gas_limit", "withdrawal_hash")] == [5, 7, 8, 10]


def test_block_ranges(spark):
    chains = spark.createDataFrame([(1, True, 9, 100, 20), (2, True, 99, 100, 20), (3, True, 100, 100, 20), (4, False, 0, 100, 20), (5, True, 90, 100, 20)], "chain_id long, enabled boolean, last_indexed long, latest long, batch long")
    ranges = lambda **kw: {r["chain_id"]: (r["from_block"], r["to_block"]) for r in bridge.plan_block_range(chains, **kw).collect()}
    assert ranges() == {1: (10, 30), 2: (None, None), 3: (None, None), 5: (91, 100)}
    assert ranges(strict=True) == {1: (10, 29), 2: (100, 100), 3: (None, None), 5: (91, 100)}
