"""Payload bytes put together by hand, field by field, plain and compressed."""

import pyarrow as pa
import pytest

from strandbook.operators import decode

KEYS = [bytes([n]) * 32 for n in (0x11, 0x22, 0x33, 0x44)]
OWNER = b"\x55" * 20
# create: btl 5, content type "a", payload "hi", one string and one numeric attribute; each item after its length.
CREATES = bytes.fromhex("ce" "cd" "05" "61" "826869" "c3c26b76" "c3c26e07")
# update: key, content type, btl, payload, no attributes.
UPDATES = bytes.fromhex("e9" "e8" "a0") + KEYS[0] + bytes.fromhex("61" "05" "826869" "c0" "c0")
DELETES = bytes.fromhex("e1" "a0") + KEYS[1]
EXTENSIONS = bytes.fromhex("e3" "e2" "a0") + KEYS[2] + bytes.fromhex("09")
OWNERS = bytes.fromhex("f7" "f6" "a0") + KEYS[3] + bytes.fromhex("94") + OWNER
PAYLOAD = bytes.fromhex("f8b7") + CREATES + UPDATES + DELETES + EXTENSIONS + OWNERS


@pytest.mark.parametrize("codec", [None, "brotli", "gzip"])
def test_known_payload(spark, codec):
    packed = pa.compress(PAYLOAD, codec=codec, asbytes=True) if codec else PAYLOAD
    rows = [(b"t" * 32, packed), (b"u" * 32, packed[:-3]), (b"v" * 32, b"\xff" * 9), (b"w" * 32, b""), (b"x" * 32, None)]
    decoded = decode.decode_storage_tx(spark.createDataFrame(rows, "tx_hash binary, input binary"), compression=codec).cache()
    assert sorted(bytes(r.tx_hash)[:1] for r in decode.quarantined(decoded).collect()) == [b"u", b"v", b"w", b"x"]
    found = {r.op_index: r for r in decode.explode_operations(decoded).collect()}
    told = [(r.operation, r.btl, r.content_type, r.data, r.new_owner) for _, r in sorted(found.items())]
    assert told == [("create", 5, "a", b"hi", None), ("delete", None, None, None, None), ("update", 5, "a", b"hi", None), ("extend", 9, None, None, None), ("changeowner", None, None, None, OWNER)]
    assert [bytes(found[n].entity_key) for n in (1, 2, 3, 4)] == [KEYS[1], KEYS[0], KEYS[2], KEYS[3]]
    assert [(a.key, a.value) for a in found[0].string_attributes] == [("k", "v")] and [(a.key, int(a.value)) for a in found[0].numeric_attributes] == [("n", 7)]


def test_payloads_that_unpack_to_too_much_go_to_quarantine(spark, monkeypatch):
    monkeypatch.setattr(decode, "UNPACKED", 100)
    with pytest.raises(ValueError):
        decode._unpacked(pa.compress(bytes(101), codec="brotli", asbytes=True), "brotli")
    assert decode._unpacked(pa.compress(bytes(100), codec="brotli", asbytes=True), "brotli") == bytes(100)


def test_a_codec_that_is_not_there_fails_when_the_plan_is_built(spark):
    with pytest.raises(ValueError):
        decode.decode_storage_tx(spark.createDataFrame([], "tx_hash binary, input binary"), compression="no such codec")
