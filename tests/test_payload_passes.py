"""Payloads are unpacked and decoded once for all kinds of operations and attributes, with no more memory than they need."""

import tracemalloc
from decimal import Decimal

import pyarrow as pa
import pytest

from strandbook import registry
from strandbook.functions import hashing
from strandbook.operators import decode

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["explode_attributes", "decode_storage_tx"])
def test_one_pass(spark, name):
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Relation [") == 1  # packing and decoding


def test_both_kinds_of_attributes(spark):
    pairs = "array<struct<key string, value {}>>"
    schema = f"entity_key binary, tx_hash binary, op_index bigint, string_attributes {pairs.format('string')}, numeric_attributes {pairs.format('decimal(20,0)')}"
    top = Decimal(2**64 - 1)
    rows = [(b"a", b"t", 0, [("k", "v"), ("k", None)], [("n", top), ("n", Decimal(0))]), (b"b", b"t", 1, None, [("n", Decimal(7))]), (None, b"t", 2, [("", "w")], None), (b"c", b"t", 3, [], []), (b"d", b"t", 4, None, None)]
    found = decode.explode_attributes(spark.createDataFrame(rows, schema), None)
    assert found.columns == ["entity_key", "tx_hash", "op_index", "key", "value"]
    got = [(r.op_index, r.key, r.value) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([(0, "k", "v"), (0, "k", None), (0, "n", str(top)), (0, "n", "0"), (1, "n", "7"), (2, "", "w")], key=repr)


def test_creates_get_their_keys_and_others_keep_theirs(spark):
    schema = f"tx_hash binary, operations array<struct<{decode.OPERATION}>>"
    op = lambda kind, key, data: (kind, key, None, None, data, None, [], [])
    rows = [(b"t" * 32, [op("create", None, b"x"), op("delete", b"k" * 32, None), op("create", None, None)]), (b"u" * 32, []), (b"v" * 32, None), (None, [op("update", b"m" * 32, b"x")])]
    found = {(r.tx_hash and bytes(r.tx_hash)[:1], r.op_index): bytes(r.entity_key) for r in decode.explode_operations(spark.createDataFrame(rows, schema)).collect()}
    number = lambda n: n.to_bytes(32, "big")
    first, third = hashing.keccak_batch([b"t" * 32 + b"x" + number(0), b"t" * 32 + number(2)])
    assert found == {(b"t", 0): first, (b"t", 1): b"k" * 32, (b"t", 2): third, (None, 0): b"m" * 32}


@pytest.mark.parametrize("size", [0, 1, decode.PIECE - 1, decode.PIECE, decode.PIECE + 1, 5 * decode.PIECE])
def test_payloads_of_any_size_unpack_whole(size):
    payload = bytes(i % 251 for i in range(size))
    for codec in ("brotli", "gzip"):
        packed = pa.compress(payload, codec=codec, asbytes=True)
        assert decode._unpacked(packed, codec) == payload
        for end in range(1, len(packed), len(packed) // 20 + 1):  # cut short: as one read of all bytes takes it
            assert _outcome(lambda: decode._unpacked(packed[:end], codec)) == _outcome(lambda: _in_one_read(packed[:end], codec))  # noqa: B023


def _in_one_read(packed, codec):
    with pa.CompressedInputStream(pa.BufferReader(packed), codec) as stream:
        return stream.read(decode.UNPACKED + 1)


def _outcome(run):
    try:
        return run()
    except Exception as e:
        return type(e)


def test_small_payloads_set_little_memory_aside():
    packed = pa.compress(b"x" * 100, codec="brotli", asbytes=True)
    tracemalloc.start()
    try:
        decode._unpacked(packed, "brotli")
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
