"""From raw transactions and logs to operations, attributes and bridge events.

Payloads are decoded in Arrow batches, because a nested list encoding has no expression. All else is native.
What cannot be decoded is not dropped silently: each decoder has a part for quarantine.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rlp
from ..functions.hashing import deposit_source_hash, entity_key

OPERATION = (
    "operation string, entity_key binary, btl decimal(20,0), content_type string, data binary, new_owner binary, "
    "string_attributes array<struct<key string, value string>>, numeric_attributes array<struct<key string, value decimal(20,0)>>"
)
_NUMBER = pa.decimal128(20, 0)
_PAIRS = {name: pa.list_(pa.struct([("key", pa.string()), ("value", kind)])) for name, kind in (("string_attributes", pa.string()), ("numeric_attributes", _NUMBER))}
OPERATIONS = pa.list_(pa.struct([
    ("operation", pa.string()), ("entity_key", pa.binary()), ("btl", _NUMBER), ("content_type", pa.string()), ("data", pa.binary()), ("new_owner", pa.binary()), *_PAIRS.items(),
]))
ZERO_WORD = bytes(32)
UNPACKED = 64 << 20  # bytes that one payload may unpack to
PIECE = 64 << 10  # bytes that are read of it at first


def _key(item: list | bytes, size: int = 32) -> bytes:
    if isinstance(item, list) or len(item) != size:
        raise ValueError(f"not {size} bytes")
    return item


def _text(item: list | bytes) -> str:
    if isinstance(item, list):
        raise ValueError("no text")
    return item.decode("utf-8")


def _attributes(items: list, of) -> list[dict]:
    return [{"key": _text(k), "value": of(v)} for k, v in items]


def _setter(kind: str, key: bytes | None, btl, content_type, payload, strings=(), numbers=()) -> dict:
    if isinstance(payload, list):
        raise ValueError("no payload")
    return {
        "operation": kind, "entity_key": key, "btl": Decimal(rlp.number(btl)), "content_type": _text(content_type), "data": payload, "new_owner": None,
        "string_attributes": _attributes(strings, _text), "numeric_attributes": _attributes(numbers, lambda v: Decimal(rlp.number(v))),
    }


def read_storage_tx(payload: bytes) -> list[dict]:
    """Operations of a payload, in the order in which they are numbered: creates, deletes, updates, extensions, changes of owner."""
    creates, updates, deletes, extensions, owners = rlp.read(payload)
    bare = {"btl": None, "content_type": None, "data": None, "new_owner": None, "string_attributes": [], "numeric_attributes": []}
    out = [_setter("create", None, *c) for c in creates]
    out += [bare | {"operation": "delete", "entity_key": _key(d)} for d in deletes]
    for key, content_type, btl, *rest in updates:
        out.append(_setter("update", _key(key), btl, content_type, *rest))
    out += [bare | {"operation": "extend", "entity_key": _key(k), "btl": Decimal(rlp.number(n))} for k, n in extensions]
    out += [bare | {"operation": "changeowner", "entity_key": _key(k), "new_owner": _key(o, 20)} for k, o in owners]
    return out


def _unpacked(payload: bytes, codec: str) -> bytes:
    first = min(PIECE, UNPACKED + 1)
    with pa.CompressedInputStream(pa.BufferReader(payload), codec) as stream:
        out = stream.read(first)
        if len(out) == first:  # a read sets aside all the bytes it is asked for, so that few payloads should ask for the most
            out += stream.read(UNPACKED + 1 - first)
    if len(out) > UNPACKED:
        raise ValueError(f"unpacks to more than {UNPACKED} bytes")
    return out


def decode_storage_tx(transactions: DataFrame, input_col: str = "input", compression: str | None = "brotli") -> DataFrame:
    """transactions with operations (array of structs, null if the payload cannot be decoded) and error (text, else null).

    ``compression`` names a codec of Arrow; None takes payloads as they are. A null input is an error, as are payloads
    that are cut short or unpack to more than UNPACKED bytes.
    """
    if compression and not pa.Codec.is_available(compression):
        raise ValueError(f"Arrow has no codec {compression}")
    operations = T.ArrayType(T.StructType.fromDDL(OPERATION))
    schema = T.StructType([*transactions.schema.fields, T.StructField("operations", operations), T.StructField("error", T.StringType())])

    def run(batches):
        unpack = (lambda payload: _unpacked(payload, compression)) if compression else bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, found, errors = batch.slice(at, 1024), [], []
                for payload in part.column(input_col).to_pylist():
                    try:
                        found.append(read_storage_tx(unpack(payload)))
                        errors.append(None)
                    except Exception as e:  # whatever is wrong with a payload, the row goes to quarantine
                        found.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, OPERATIONS), pa.array(errors, pa.string())], names=[*part.schema.names, "operations", "error"])

    return transactions.mapInArrow(run, schema)


def explode_operations(decoded: DataFrame) -> DataFrame:
    """One row per operation of decoded transactions (tx_hash and any columns): op_index counts across all kinds; creates get their keys.

    One pass: payloads are decoded once for all kinds, and only messages of creates are hashed.
    """
    kept = [c for c in decoded.columns if c not in ("operations", "error", "input")]
    rows = decoded.filter("operations is not null").select(*kept, F.posexplode("operations").alias("op_index", "op"))
    rows = rows.select(*kept, F.col("op_index").cast("bigint").alias("op_index"), "op.*")
    made = F.col("operation") == "create"
    key = entity_key(F.when(made, F.col("tx_hash")), "data", "op_index")
    return rows.withColumn("entity_key", F.when(made, key).otherwise(F.col("entity_key")))


def explode_attributes(operations: DataFrame, kind: str | None = "string") -> DataFrame:
    """entity_key, tx_hash, op_index, key, value: one row per attribute of a kind (string or numeric), in one pass of both with values as text for None."""
    if kind:
        return operations.select("entity_key", "tx_hash", "op_index", F.inline(f"{kind}_attributes"))
    as_text = F.transform("numeric_attributes", lambda a: F.struct(a["key"].alias("key"), a["value"].cast("string").alias("value")))
    both = F.concat(*(F.coalesce(held, F.array()) for held in (F.col("string_attributes"), as_text)))
    return operations.select("entity_key", "tx_hash", "op_index", F.inline(both))


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error is not null").select("tx_hash", "error")


def consensus_transactions(transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Transactions of consensus blocks with the block's number and time; those that lack a number, hash, time or index are left out."""
    told = blocks.filter("consensus").select(F.col("hash").alias("block_hash"), F.col("number").alias("block_number"), F.col("seconds").alias("block_seconds"))
    return transactions.drop("block_number", "block_seconds").join(told, "block_hash").dropna(subset=["block_hash", "block_number", "block_seconds", "tx_index"])


def _number(data: Column, start: int, length: int = 8) -> Column:
    """length bytes of data from start (1-based) as a decimal of 20 digits."""
    return F.conv(F.hex(F.substring(data, start, length)), 16, 10).cast("decimal(20,0)")


def extended_expiry(data: Column) -> Column:
    """New expiry block of an extension's log, its second word; null if it is missing or wider than 64 bits."""
    fits = (F.octet_length(data) >= 64) & (F.substring(data, 33, 24) == F.lit(bytes(24)))
    return F.when(fits, _number(data, 57))


def delete_log_operations(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Delete operations of delete logs: the key is the second topic, the number the log's index; logs without it are left out."""
    told = transactions.select("tx_hash", "block_number", "block_seconds", "tx_index", F.col("from_address").alias("sender"), F.col("to_address").alias("recipient"))
    rows = logs.filter("second_topic is not null").select("tx_hash", F.col("second_topic").alias("entity_key"), F.col("index").cast("bigint").alias("op_index"))
    return rows.join(told, "tx_hash").withColumn("operation", F.lit("delete"))


def _address(topic: Column) -> Column:
    """The address of a topic, null unless its first 12 bytes are zero."""
    return F.when((F.octet_length(topic) == 32) & (F.substring(topic, 1, 12) == F.lit(bytes(12))), F.substring(topic, 13, 20))


def route_bridge_logs(logs: DataFrame, deposited: bytes, proven: bytes, finalized: bytes) -> dict[str, DataFrame]:
    """Logs by their first topic: deposited, proven, finalized, and unrouted, which stay in the queue."""
    kind = F.when(F.col("first_topic") == F.lit(deposited), "deposited").when(F.col("first_topic") == F.lit(proven), "proven").when(F.col("first_topic") == F.lit(finalized), "finalized").otherwise("unrouted")
    marked = logs.withColumn("__kind", kind)
    return {name: marked.filter(F.col("__kind") == name).drop("__kind") for name in ("deposited", "proven", "finalized", "unrouted")}


def decode_deposits(logs: DataFrame) -> DataFrame:
    """tx_hash, index, from, to, source_hash, mint, value (words), gas_limit, is_creation, calldata, error.

    Topics two and three are addresses, topic four the version, which must be 0; the data has at least 137 bytes.
    Rows that fail have an error and nulls.
    """
    data = F.col("data")
    size = F.conv(F.hex(F.substring(data, 57, 8)), 16, 10).cast("decimal(20,0)")
    error = (
        F.when(F.col("second_topic").isNull() | F.col("third_topic").isNull() | F.col("fourth_topic").isNull(), "missing topic")
        .when(_address(F.col("second_topic")).isNull() | _address(F.col("third_topic")).isNull(), "no address")
        .when(F.col("fourth_topic") != F.lit(ZERO_WORD), "unsupported version")
        .when(F.coalesce(F.octet_length(data), F.lit(0)) < 137, "short data")
        .when((F.substring(data, 33, 24) != F.lit(bytes(24))) | (size + 64 > F.octet_length(data)) | (size < 73), "bad length")
    )
    whole = lambda c: F.when(F.col("error").isNull(), c)
    rows = logs.withColumn("error", error).withColumn("source_hash", deposit_source_hash("block_hash", "index"))
    calldata = F.expr("substring(data, 138, cast(conv(hex(substring(data, 57, 8)), 16, 10) as int) - 73)")
    return rows.select(
        "tx_hash", "index", whole(_address(F.col("second_topic"))).alias("from"), whole(_address(F.col("third_topic"))).alias("to"), whole(F.col("source_hash")).alias("source_hash"),
        whole(F.substring(data, 65, 32)).alias("mint"), whole(F.substring(data, 97, 32)).alias("value"), whole(_number(data, 129)).alias("gas_limit"),
        whole(F.substring(data, 137, 1) != F.lit(b"\0")).alias("is_creation"), whole(calldata).alias("calldata"), "error",
    )


def decode_proven(logs: DataFrame) -> DataFrame:
    """tx_hash, index, withdrawal_hash, from, to; logs without all topics are left out."""
    rows = logs.select("tx_hash", "index", F.col("second_topic").alias("withdrawal_hash"), _address(F.col("third_topic")).alias("from"), _address(F.col("fourth_topic")).alias("to"))
    return rows.dropna(subset=["withdrawal_hash", "from", "to"])


def decode_finalized(logs: DataFrame) -> DataFrame:
    """tx_hash, index, withdrawal_hash, success: whether the data's first word ends in a byte other than zero."""
    rows = logs.filter("second_topic is not null and octet_length(data) >= 32")
    return rows.select("tx_hash", "index", F.col("second_topic").alias("withdrawal_hash"), (F.substring("data", 32, 1) != F.lit(b"\0")).alias("success"))
