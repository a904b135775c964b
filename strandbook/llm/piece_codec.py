"""SentencePiece encoding and decoding of whole texts.

Encoding gives the ids of the model's own library, by an Aho-Corasick automaton that drives a Viterbi pass
(see ``pieces.BestScore``). Decoding gives the text back, except that U+2581 becomes a space.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import widened, worker_memo


AT_ONCE = 1 << 20  # ids that are decoded together


def model_path() -> str:
    """The piece model: STRANDBOOK_PIECE_MODEL, else the installed public one."""
    if found := os.environ.get("STRANDBOOK_PIECE_MODEL"):
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _coder(model: str | None):
    path = model or model_path()
    return worker_memo(f"best_score_{path}", lambda: pieces.BestScore(pieces.Vocabulary(path)))


def _text(joined: pa.Array) -> pa.Array:
    """Texts of joined pieces; bytes that are not UTF-8 become U+FFFD."""
    try:
        texts = joined.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
    spaced = pc.replace_substring(texts, pieces.SPACE_MARK, " ")
    return pc.replace_substring_regex(spaced, r"\A ", "", max_replacements=1)


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """docs with piece_ids, array<int>, added (a column of that name is replaced).

    Null and empty texts have no ids. Characters outside the vocabulary are spelled in bytes, so nothing
    is lost. Rows and other columns stay; texts are never cut.
    """
    columns = [c for c in docs.columns if c != "piece_ids"]

    def run(batches):
        coder = _coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = coder.encode_all(part.column(text_col).to_pylist())
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "piece_ids"])

    plain = docs.select(*(F.col(f"`{c}`") for c in columns))
    return plain.mapInArrow(run, widened(plain, piece_ids=T.ArrayType(T.IntegerType())))


def decode(coded: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """coded with the text that the ids spell in out_col; null ids give null, no ids an empty text."""
    columns = [c for c in coded.columns if c != out_col]

    def run(batches):
        spelled = pa.array(_coder(model).vocabulary.spelled, pa.binary())
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            whole, at = np.r_[0, np.cumsum(sizes)], 0
            while at < batch.num_rows:  # as many rows as have AT_ONCE ids together, or one
                rows = max(1, int(np.searchsorted(whole, whole[at] + AT_ONCE, "right")) - 1 - at)
                part = batch.slice(at, rows)
                ids = part.column(ids_col)
                ends = pa.array((whole[at : at + rows + 1] - whole[at]).astype(np.int32))
                parts = pa.ListArray.from_arrays(ends, spelled.take(pc.list_flatten(ids)))
                texts = pc.if_else(pc.is_valid(ids), _text(pc.binary_join(parts, b"")), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out_col])
                at += rows

    plain = coded.select(*(F.col(f"`{c}`") for c in columns))
    return plain.mapInArrow(run, widened(plain, **{out_col: T.StringType()}))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_bytes_spelled, ids_sha256 (of the ids, comma-joined) and whether decoding gives the text back."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = decode(encode(plain, model=model), model=model)
    same = F.coalesce(F.col("decoded"), F.lit("")) == F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("▁"), F.lit(" "))
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.size(F.filter("piece_ids", lambda i: (i >= 3) & (i < 259))).cast("long").alias("n_bytes_spelled"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        same.alias("round_trip"),
    )
