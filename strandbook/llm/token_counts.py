"""Token counts of whole texts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import widened, worker_memo
from .piece_codec import model_path

LIMIT = 4096


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are those of the model's own byte-pair encoding, without begin or end tokens; strings that look
    like special tokens are ordinary text. Null texts count as empty: no bytes, no tokens. Repeated rows
    get equal counts; other columns are not read. Texts are never cut.
    """

    def run(batches):
        path = model or model_path()
        counter = worker_memo(f"merge_count_{path}", lambda: pieces.MergeCount(pieces.Vocabulary(path)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = pa.array([counter.count(t.as_py()) for t in part.column("text")], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = plain.mapInArrow(run, widened(plain.drop("text"), n_tokens=T.LongType()))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
