"""Keccak-256, which Spark lacks (its SHA3 pads differently): whole Arrow batches advance through the permutation together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 136  # bytes that a block takes in
ROUNDS = 24


def _round_constants() -> list[int]:
    """By the linear feedback register that defines them."""
    out, state = [], 1
    for _ in range(ROUNDS):
        word = 0
        for j in range(7):
            if state & 1:
                word |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(word)
    return out


def _offsets() -> dict[tuple[int, int], int]:
    """Rotation of each lane: triangular numbers along the walk that visits all lanes but the first."""
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


CONSTANTS, OFFSETS = [np.uint64(c) for c in _round_constants()], _offsets()


def _turned(lane: np.ndarray, by: int) -> np.ndarray:
    return lane if not by else (lane << np.uint64(by)) | (lane >> np.uint64(64 - by))


def _permuted(a: dict) -> dict:
    for constant in CONSTANTS:
        c = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
        d = [c[x - 1] ^ _turned(c[(x + 1) % 5], 1) for x in range(5)]
        b = {(y, (2 * x + 3 * y) % 5): _turned(a[x, y] ^ d[x], OFFSETS[x, y]) for x in range(5) for y in range(5)}
        a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & b[(x + 2) % 5, y]) for x in range(5) for y in range(5)}
        a[0, 0] = a[0, 0] ^ constant
    return a


def keccak_batch(messages: list[bytes]) -> list[bytes]:
    """Digests of many messages; those of equally many blocks are taken together."""
    out: list[bytes] = [b""] * len(messages)
    blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        blocks.setdefault(len(m) // RATE + 1, []).append(i)
    for count, rows in blocks.items():
        padded = np.zeros((len(rows), count * RATE), np.uint8)
        for k, i in enumerate(rows):
            padded[k, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            padded[k, len(messages[i])] ^= 0x01
        padded[:, -1] ^= 0x80
        lanes = padded.view("<u8").reshape(len(rows), count, RATE // 8)
        state = {(x, y): np.zeros(len(rows), np.uint64) for x in range(5) for y in range(5)}
        for block in range(count):
            for lane in range(RATE // 8):
                state[lane % 5, lane // 5] = state[lane % 5, lane // 5] ^ lanes[:, block, lane]
            state = _permuted(state)
        digest = np.stack([state[x, 0] for x in range(4)], axis=1).astype("<u8")
        for k, i in enumerate(rows):
            out[i] = digest[k].tobytes()
    return out


@F.pandas_udf(T.BinaryType())
def _keccak(messages: pd.Series) -> pd.Series:
    known = messages.notna()
    out = pd.Series([None] * len(messages), dtype=object)
    out[known.to_numpy()] = keccak_batch([bytes(m) for m in messages[known]])
    return out


def keccak256(message: Column | str) -> Column:
    """32 bytes; null for null."""
    return _keccak(message)


def word(number: Column | str) -> Column:
    """A non-negative bigint as a big-endian word of 32 bytes."""
    return F.unhex(F.lpad(F.hex(number), 64, "0"))


def entity_key(tx_hash: Column | str, payload: Column | str, op_index: Column | str) -> Column:
    """Key of a created entity: the hash of transaction, payload and the operation's number as a word."""
    return keccak256(F.concat(tx_hash, F.coalesce(payload, F.lit(b"")), word(op_index)))


def deposit_source_hash(block_hash: Column | str, log_index: Column | str) -> Column:
    """Key that both chains give a deposit: the hash of a zero word and the hash of block and log index."""
    return keccak256(F.concat(F.lit(bytes(32)), keccak256(F.concat(block_hash, word(log_index)))))
