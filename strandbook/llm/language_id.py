"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a boundary, and runs of boundaries count once. N-grams of one
to three characters are hashed into BUCKETS. Each task counts its documents' n-grams per language before
anything is shuffled; the matrix of log probabilities (BUCKETS rows, at most LANGS_A_BLOCK languages: 16 MB)
is broadcast, and batches of texts are scored as sparse rows. More languages are scored block after block,
so that none is left out. Counts cover every learning document and whole texts.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned.
Ties go to the smallest language by code point; repeated rows get equal answers. A text of any length is
taken CHUNK characters at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, unused, worker_memo

BUCKETS = 1 << 16
SMOOTHING = 0.1
LANGS_A_BLOCK = 32
CHUNK = 1 << 18
UNKNOWN = "und"
SPACE = 32
DENSE = 4096  # from so many n-grams on, a row of all buckets is cheaper than sorting


def _folding() -> np.ndarray:
    """Every code point's lower case; what is no letter is a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return (h >> np.uint32(16)).astype(np.int64)


def grams(text: str):
    """Bucket numbers of a text's n-grams, an array for each CHUNK characters; nothing if it has no letter."""
    folding = worker_memo("folding", _folding)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    tail = np.full(2, SPACE, np.uint32)
    for at in range(0, len(codes), CHUNK):
        chars = folding[codes[at : at + CHUNK]]
        before = np.concatenate([tail[-1:], chars[:-1]])
        chars = chars[(chars != SPACE) | (before != SPACE)]
        if at + CHUNK >= len(codes) and (chars if len(chars) else tail)[-1] != SPACE:
            chars = np.append(chars, np.uint32(SPACE))
        row = np.concatenate([tail, chars])
        tail = row[-2:]
        if len(chars):
            spread = row * np.uint32(2654435761)
            one, two = spread[2:], spread[2:] + spread[1:-1] * np.uint32(31)
            three = two + spread[:-2] * np.uint32(961)
            yield np.concatenate([_mixed(one[chars != SPACE] + np.uint32(1)), _mixed(two + np.uint32(2)), _mixed(three + np.uint32(3))])


def sparse_row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    found = list(grams(text))
    if sum(map(len, found)) < DENSE:
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = sum(np.bincount(part, minlength=BUCKETS) for part in found)
    hit = np.flatnonzero(row)
    return hit, row[hit]


def _counted(batches):
    """(lang, text) to (lang, bucket, n), a task's documents summed; bucket BUCKETS counts the documents."""

    def flush():
        for lang, row in held.items():
            hit = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(row[hit])], ["lang", "bucket", "n"])
        held.clear()

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in held and len(held) == 2 * LANGS_A_BLOCK:
                yield from flush()  # memory stays bounded however many languages a task meets
            row = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            buckets, counts = sparse_row(text)
            row[buckets] += counts
            row[BUCKETS] += 1
    yield from flush()


def learn(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Counts (lang, bucket, n) of all rows with text and lang, stored; bucket BUCKETS holds the number of documents."""
    rows = docs.filter("text is not null and lang is not null").select("lang", "text")
    parts = rows.mapInArrow(_counted, T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]))
    return scratch.keep(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")


def blocks(counts: DataFrame):
    """Matrices for the languages in order, LANGS_A_BLOCK at a time: (languages, log priors, log probabilities by bucket)."""
    documents = {r.lang: r.n for r in counts.filter(F.col("bucket") == BUCKETS).collect()}
    langs = sorted(documents)
    for at in range(0, len(langs), LANGS_A_BLOCK):
        block = langs[at : at + LANGS_A_BLOCK]
        rows = counts.filter(F.col("lang").isin(block) & (F.col("bucket") < BUCKETS)).toPandas()
        table = np.zeros((BUCKETS, len(block)))
        table[rows["bucket"].to_numpy(), np.searchsorted(np.array(block, object), rows["lang"].to_numpy(object))] = rows["n"].to_numpy()
        weights = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * BUCKETS)
        priors = np.log(np.array([documents[x] for x in block], float) / sum(documents.values()))
        yield block, priors, weights


def scores_of(texts: list[str | None], priors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log scores per text and language, whether the text has a letter)."""
    rows = [sparse_row(t) if t else (np.zeros(0, np.int64),) * 2 for t in texts]
    sizes = np.array([len(b) for b, _ in rows])
    scores, lettered = np.tile(priors, (len(texts), 1)), sizes > 0
    at = 0
    while at < len(rows):  # sparse rows are multiplied some at a time, so that memory stays bounded
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
        full = [i for i in range(at, end) if sizes[i]]
        if full:
            buckets, counts = np.concatenate([rows[i][0] for i in full]), np.concatenate([rows[i][1] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            scores[full] += np.add.reduceat(weights[buckets] * counts[:, None], starts)
        at = end
    return scores, lettered


def predict(df: DataFrame, counts: DataFrame, text: str = "text") -> DataFrame:
    """df with lang_pred and score, the posterior probability of that language; columns of these names are replaced."""
    spark, kept = df.sparkSession, [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    df = df.select(*(F.col(f"`{c}`") for c in kept))
    best, top, mass = (unused(n, df) for n in ("best", "top", "mass"))
    held = df.withColumns({best: F.lit(None).cast("string"), top: F.lit(None).cast("double"), mass: F.lit(None).cast("double")})
    for langs, priors, weights in blocks(counts):
        shipped, at = spark.sparkContext.broadcast((langs, priors, weights)), len(kept)

        def score(batches, shipped=shipped, at=at, column=kept.index(text)):
            langs, priors, weights = shipped.value
            for batch in batches:
                scores, lettered = scores_of(batch.column(column).to_pylist(), priors, weights)
                first = scores.argmax(axis=1)
                high = scores[np.arange(len(first)), first]
                total = high + np.log(np.exp(scores - high[:, None]).sum(axis=1))
                names, tops, masses = (batch.column(at + k).to_pylist() for k in range(3))
                for i in np.flatnonzero(lettered):
                    if names[i] is None or high[i] > tops[i]:
                        names[i], tops[i] = langs[first[i]], float(high[i])
                    masses[i] = float(total[i]) if masses[i] is None else float(np.logaddexp(masses[i], total[i]))
                columns = [*batch.columns[:at], pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(masses, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        held = held.mapInArrow(score, held.schema)
    return held.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col(best).isNotNull(), F.least(F.lit(1.0), F.exp(F.col(top) - F.col(mass)))).otherwise(0.0).alias("score"))


def held_out(doc_id: Column, of: int = 4, part: int = 2) -> Column:
    """Whether the checksum of a document's id puts it into the part held back from learning; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == part, F.lit(False))


def identify(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All documents with held_out, lang_pred and score; learned from the others. Documents without id are neither held out nor learned from."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "held_out"), held_out(F.col("doc_id")).alias("held_out"))
    counts = learn(docs.filter("doc_id is not null and not held_out"), scratch)
    return predict(docs, counts)
