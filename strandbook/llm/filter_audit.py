"""What each of five filters removes, alone and in every order, counted by a stream of files.

All files are taken as available-now micro-batches. A task measures its texts once (words, capitals, marks) into a
mask of four failures and sums equal texts before anything is shuffled. The fifth filter removes what repeats the
text of a smaller doc_id: the state holds, keyed by text (128 bits), the smallest id so far and who has it; when a
smaller one arrives, the masks of those who had it are retracted from the counters of their parts and entered anew
with the fifth failure. The state is dealt in buckets of some thousand texts, as many as the table asks for, since a
state of its own for each text costs 8 ms of calls. The order of files does not matter. Each batch writes its counter changes under its number,
so that a repeated batch writes the same again; the report reads their sums.

Counters are by part, mask and labels: 32 masks at most a part. From them every order follows by arithmetic: what is
kept after some filters depends on their set alone, and a document that fails k filters is removed first by each of
them in one k-th of the orders.

Null texts are empty, null sources the part ''. Documents without id never repeat another and are never repeated; of
equal ids with equal texts none is the smaller. Documents without labels count as neither; of several label rows of one
document any 1 counts. An empty table gives no rows. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MICRO_BATCHES = 8  # so many at most, whatever the number of files: a lost driver repeats an eighth
COMBINED = 50_000  # texts that a task sums before it lets them go
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
NO_LABEL_SPREAD = 1024

MEASURED = "label_key string, doc_id long, part string, mask int, text_key binary"
SUMMED = "text_key binary, mask int, part string, quality boolean, toxic boolean, low long, n_low long, n_more long, n_free long"
CHANGES = "part string, mask int, quality boolean, toxic boolean, n long"
STATE = "held binary"
SUMMED_NAMES = [f.split()[0] for f in SUMMED.split(", ")]
HELD_KINDS = [pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
STATE_BYTES, HEAP_STATE_BYTES = 64, 1 << 30
HEAP_STATE, DISK_STATE = (f"org.apache.spark.sql.execution.streaming.state.{n}StateStoreProvider" for n in ("HDFSBacked", "RocksDB"))
TEXTS_A_BUCKET = 4096  # rows for each bucket of the state: about 200 KB


def mask_of(text: str) -> int:
    """Failures of A to D as bits."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII blanks only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), MARKS.search(raw) is not None)
    return sum(1 << n for n, bad in enumerate(failed) if bad)


def _measured(batches):
    """(doc_id, part, text) to MEASURED; rows without id get keys that no label has, spread."""
    n = 0
    for batch in batches:
        ids, parts, texts = (c.to_pylist() for c in batch.columns)
        masks, keys, names = [], [], []
        for doc_id, text in zip(ids, texts):
            text, n = text or "", n + 1
            masks.append(mask_of(text))
            keys.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            names.append(str(doc_id) if doc_id is not None else f"none {n % NO_LABEL_SPREAD}")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], ["label_key", "doc_id", "part", "mask", "text_key"])


def _summed(batches):
    """Rows of one text, part and labels in one: the smallest id, how many have it, a larger one, or none."""

    def flush():
        columns = list(zip(*((*k, *v) for k, v in held.items()))) or [()] * 9
        held.clear()
        kinds = [pa.binary(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SUMMED_NAMES)

    held: dict[tuple, list] = {}
    for batch in batches:
        for doc_id, *key in zip(*(c.to_pylist() for c in batch.columns)):
            row = held.setdefault(tuple(key), [None, 0, 0, 0])
            if doc_id is None:
                row[3] += 1
            elif row[0] is None or doc_id < row[0]:
                row[0], row[1], row[2] = doc_id, 1, row[2] + row[1]
            else:
                row[1 if doc_id == row[0] else 2] += 1
        if len(held) >= COMBINED:
            yield flush()
    if held:
        yield flush()


def _changes(key, frames, state):
    """Counter changes of a bucket of texts in this batch; keeps each text's smallest id and who has it."""
    held: dict[bytes, list] = {}
    if state.exists:
        for text_key, low, *who, n in zip(*(c.to_pylist() for c in pa.ipc.open_stream(state.get[0]).read_all().columns)):
            held.setdefault(text_key, [low, {}])[1][tuple(who)] = n
    found: dict[tuple, int] = {}

    def add(who, mask, n):
        if n:
            found[(*who, mask)] = found.get((*who, mask), 0) + n

    for frame in frames:
        for text_key, mask, part, quality, toxic, low, n_low, n_more, n_free in zip(*(frame[c].tolist() for c in SUMMED_NAMES)):
            who = (part, quality, toxic)
            add(who, mask, n_free)
            add(who, mask | REPEATED, n_more)
            if not n_low:
                continue
            low, text_key = int(low), bytes(text_key)
            known = held.get(text_key)
            if known is not None and low > known[0]:
                add(who, mask | REPEATED, n_low)
                continue
            if known is None or low < known[0]:  # those who had the smallest id repeat this one from now on
                for other, n in known[1].items() if known else ():
                    add(other, mask, -n)
                    add(other, mask | REPEATED, n)
                known = held[text_key] = [low, {}]
            add(who, mask, n_low)
            known[1][who] = known[1].get(who, 0) + n_low
    kept = [(text_key, low, *who, n) for text_key, (low, holders) in held.items() for who, n in holders.items()]
    if kept:
        table = pa.table([pa.array(c, k) for c, k in zip(zip(*kept), HELD_KINDS)], [f"c{n}" for n in range(len(HELD_KINDS))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    rows = [(part, mask, quality, toxic, n) for (part, quality, toxic, mask), n in found.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "quality", "toxic", "n"])


def labels_of(labels: DataFrame) -> DataFrame:
    """One row per labelled document: label_key, quality and toxic as booleans."""
    rows = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("label_key"))
    return rows.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("quality"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))


def _streamable(spark: SparkSession, path: str) -> str:
    """path, as a pattern that only it matches where it is one file: streams take folders and patterns."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return path if folder else f"{path[:-1]}[{path[-1]}]"


def count(spark: SparkSession, path: str, labels: DataFrame, scratch: Scratch, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """Counters (part, mask, quality, toxic, n) of all documents in the files below path, by a stream that ends when they are read."""
    docs = spark.read.parquet(path)
    files = max(1, -(-len(docs.inputFiles()) // micro_batches))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(_streamable(spark, path))
    rows = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(_measured, MEASURED)
    told = checked_broadcast(labels_of(labels), 64)
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.join(told, "label_key", "left").select("doc_id", "text_key", "mask", "part", false("quality"), false("toxic")).mapInArrow(_summed, SUMMED)
    total = docs.count()  # from the files' footers
    buckets = 1 + total // TEXTS_A_BUCKET
    changes = rows.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(_changes, CHANGES, STATE, "update", "NoTimeout")
    root = f"{scratch.root}/filter-audit"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    # A state of proven size stays on executors' heaps; a larger one goes to their disks with one bound on memory per
    # executor. RocksDB allots 4 MB for each partition beforehand, which small states need not pay.
    wanted = {"spark.sql.streaming.stateStore.providerClass": HEAP_STATE if total * STATE_BYTES <= HEAP_STATE_BYTES else DISK_STATE, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
        query = writer.trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    parts = spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{root}/changes") if query.lastProgress else spark.createDataFrame([], CHANGES)
    return scratch.keep(parts.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0"), "filter-counters")


def report(counters: DataFrame) -> DataFrame:
    """Every part, order of the filters and step, from the counters by mask."""
    bit = lambda f: 1 << f
    n = F.col("n")
    kinds = {"all": n, "good": F.when(F.col("quality"), n).otherwise(0), "toxic": F.when(F.col("toxic"), n).otherwise(0)}
    # left[s]: the documents that fail no filter of the set s.
    sets = counters.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    passed = F.col("mask").bitwiseAND(F.col("s")) == 0
    sets = sets.groupBy("part", "s").agg(*(F.sum(F.when(passed, c).otherwise(0)).alias(k) for k, c in kinds.items()))
    left = sets.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", *kinds))).alias("left"))
    has = lambda f: F.col("mask").bitwiseAND(F.lit(bit(f))) != 0
    alone = F.array(*(F.sum(F.when(F.col("mask") == bit(f), n).otherwise(0)) for f in range(len(FILTERS))))
    shares = F.array(*(F.sum(F.when(has(f), n * (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0)) for f in range(len(FILTERS))))
    wide = left.join(counters.groupBy("part").agg(alone.alias("alone"), shares.alias("shares")), "part")
    steps = []
    for order in map("".join, permutations(FILTERS)):
        for step, letter in enumerate(order, 1):
            before = sum(bit(FILTERS.index(x)) for x in order[: step - 1])
            at = FILTERS.index(letter)
            steps.append({"filter_order": order, "step": step, "at": at, "before": before, "after": before | bit(at), "own": bit(at)})
    kind = "array<struct<filter_order string, step int, at int, before int, after int, own int>>"
    rows = wide.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    of = lambda what, s: F.col("left")[F.col(s)][what]
    lost = lambda what: of(what, "before") - of(what, "after")
    failing = F.col("left")[0]["all"] - of("all", "own")
    out = {
        "kept": of("all", "after"), "removed": lost("all"), "redundant": failing - lost("all"), "unique_fails": F.col("alone")[F.col("at")],
        "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": F.col("shares")[F.col("at")],
    }
    return rows.select("part", "filter_order", "step", *(c.cast("long").alias(k) for k, c in out.items()))


def audit(spark: SparkSession, path: str, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The report on all documents in the files below path."""
    return report(count(spark, path, labels, scratch or Scratch(spark)))


ORACLE = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
worded AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM cut),
measured AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50) AS fa, 100 * len(list_distinct(w)) < 65 * len(w) AS fb, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fc,
    regexp_matches(t, '[#$%&*|]') AS fd, coalesce(low < worded.doc_id, false) AS fe
    FROM worded LEFT JOIN told USING (doc_id)),
masked AS (SELECT part, good, toxic, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask FROM measured),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY ALL),
letters AS (SELECT chr(65 + i::INT) AS x FROM range(5) r(i)),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s::INT AS step, 1 << (ascii(o[s]) - 65) AS bit, list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i::INT]) - 65)))::INT AS ahead FROM orders, range(1, 6) r(s))
SELECT part, o AS filter_order, step,
    sum(CASE WHEN mask & (coalesce(ahead, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(ahead, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(ahead, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(ahead, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(ahead, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
    sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM counted, steps GROUP BY part, o, step
"""
