"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are normalised and dealt to lists in two levels: the nearest coarse centroid, then the nearest of the
fine centroids that all coarse ones share, by what the coarse one leaves over. There are about as many lists as
the root of the rows, at every size, though centroids, rotation and the number of probed lists are fitted on a
bounded sample (FIT_ROWS): n lists need only the root of n centroids a level. Every row is indexed. Lists are
cut into blocks, and the queries of a list into chunks, so that a hot list is many tasks of a bounded size.

A query's nearest list is scanned first; the distance of its last place bounds the scan of the other lists.
Within a block, tiles of growing size tighten the bound further, and partial distances over column blocks of
the rotated vectors test whether a candidate can still be among the nearest: those that fail are given up
early. What survives is scored on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

FIT_ROWS = 8192  # rows of the sample that rotation, centroids and probes are fitted on
BLOCK_ROWS, CHUNK_QUERIES = 4096, 1024
COLUMN_BLOCK, FIRST_TILE, QUERIES_AT_ONCE = 16, 64, 64
EPSILON = 2.5  # width of the test: a larger value gives up fewer candidates
COVERAGE = 0.97  # share of the sample's nearest neighbours that probed lists must hold


def _centroids(points: np.ndarray, many: int, rng: np.random.Generator, on_sphere: bool) -> np.ndarray:
    centres = points[rng.choice(len(points), many, replace=False)]
    for _ in range(8):
        owner = (2 * points @ centres.T - (centres * centres).sum(1)).argmax(1)
        sums, held = np.zeros_like(centres), np.bincount(owner, minlength=many)[:, None]
        np.add.at(sums, owner, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if on_sphere else held
        centres = np.where((held > 0) & (size > 1e-12), sums / np.maximum(size, 1e-12), centres)
    return centres


class Index:
    """What the sample decides: rotation, two levels of centroids, probes."""

    def __init__(self, sample: np.ndarray, rows: int, nearest: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        level = min(int(np.ceil(rows**0.25)), len(unit))  # the root of the rows, as a product of two levels
        self.coarse = _centroids(unit, level, rng, True)
        self.fine = _centroids(unit - self.coarse[(unit @ self.coarse.T).argmax(1)], level, rng, False)
        self.lists = level * level
        self.norms = (self.coarse**2).sum(1)[:, None] + 2 * self.coarse @ self.fine.T + (self.fine**2).sum(1)
        # Probes: how many lists, nearest first, hold COVERAGE of the sample's own nearest neighbours.
        owner, tried, ranks = self.owner(unit), min(512, len(unit)), []
        for i in range(tried):
            close = unit @ unit[i]
            close[i] = -np.inf
            best = np.argsort(-close, kind="stable")[:nearest]
            rank_of = np.empty(self.lists, np.int64)
            rank_of[self.order(unit[i])] = np.arange(self.lists)
            ranks += rank_of[owner[best]].tolist()
        self.probes = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(COVERAGE * len(ranks))) - 1)]) + 1 if ranks else 1

    def owner(self, unit: np.ndarray) -> np.ndarray:
        coarse = (unit @ self.coarse.T).argmax(1)
        left = unit - self.coarse[coarse]
        return coarse * len(self.fine) + (2 * left @ self.fine.T - (self.fine**2).sum(1)).argmax(1)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """All lists, the one with the nearest centre first."""
        far = self.norms - 2 * (self.coarse @ unit)[:, None] - 2 * (self.fine @ unit)
        return np.argsort(far.ravel(), kind="stable")

    def probed(self, unit: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
        """Lists that hold rows, nearest first: those of the first ``probes``, or more until they hold ``least`` rows."""
        order = self.order(unit)
        enough = int(np.searchsorted(np.cumsum(counts[order]), least)) + 1
        order = order[: max(self.probes, enough)]
        return order[counts[order] > 0]


def scan_block(rotated: np.ndarray, queries: np.ndarray, nearest: int, bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, place) of the candidates that may be among a query's nearest, and how many partial distances were summed for it.

    ``bounds`` are squared distances within which ``nearest`` rows of each query are known to lie, or infinite. Tiles double
    in size, and each tightens the bounds for those after it. The place ``own`` (-1: none) is the query's and takes no part.
    """
    rows, dim = rotated.shape
    bounds, low, work = bounds.copy(), 0, 0
    asked, found, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    tile = max(FIRST_TILE, 4 * nearest) * (1 if np.isinf(bounds).any() else 8)
    while low < rows:
        high = min(rows, low + tile)
        here, there = queries[:, :COLUMN_BLOCK], rotated[low:high, :COLUMN_BLOCK]
        near = (here * here).sum(1)[:, None] + (there * there).sum(1) - 2 * here @ there.T
        inside = np.flatnonzero((own >= low) & (own < high))
        near[inside, own[inside] - low] = np.inf
        q, r = np.nonzero(near * (dim / min(dim, COLUMN_BLOCK)) <= (bounds * _slack(COLUMN_BLOCK, dim) + 1e-9)[:, None])
        partial, r, work = near[q, r], r + low, work + near.size
        if np.isinf(bounds).any():
            q, r, partial = q[np.isfinite(partial)], r[np.isfinite(partial)], partial[np.isfinite(partial)]
        for left in range(COLUMN_BLOCK, dim, COLUMN_BLOCK):
            right, work = min(dim, left + COLUMN_BLOCK), work + len(q)
            partial = partial + ((rotated[r, left:right] - queries[q, left:right]) ** 2).sum(1)
            keep = partial * (dim / right) <= bounds[q] * _slack(right, dim) + 1e-9
            q, r, partial = q[keep], r[keep], partial[keep]
        asked, found, far = np.r_[asked, q], np.r_[found, r], np.r_[far, partial]
        order = np.lexsort((far, asked))
        asked, found, far = asked[order], found[order], far[order]
        last = _places(asked) == nearest - 1
        bounds[asked[last]] = np.minimum(bounds[asked[last]], far[last])
        keep = far <= bounds[asked] + 1e-9
        asked, found, far = asked[keep], found[keep], far[keep]
        low, tile = high, min(2 * tile, BLOCK_ROWS)
    return asked, found, work


def _slack(right: int, dim: int) -> float:
    """By how much a distance over the first columns may exceed its share of the bound."""
    return 1.0 if right >= dim else (1 + EPSILON / right**0.5) ** 2


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal values, of sorted values."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _load(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _search(index: Index, nearest: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict = {"query_id": [], "vec_id": [], "score": [], "far": []}
        if candidates.num_rows and queries.num_rows:
            order = np.argsort(candidates["vec_id"].to_numpy())  # ids do not repeat
            ids, plain = candidates["vec_id"].to_numpy()[order], _load(candidates["vector"])[order]
            norms = np.sqrt((plain * plain).sum(1))
            rotated = np.ascontiguousarray((plain / norms[:, None]) @ index.rotation)
            of, bounds = queries["vec_id"].to_numpy(), np.array([np.inf if x is None else x for x in queries["bound"].to_pylist()])
            wanted = _load(queries["vector"])
            sizes = np.sqrt((wanted * wanted).sum(1))
            turned = (wanted / sizes[:, None]) @ index.rotation
            at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
            own = np.where(ids[at] == of, at, -1)
            for low in range(0, len(of), QUERIES_AT_ONCE):
                some = slice(low, low + QUERIES_AT_ONCE)
                asked, found, _ = scan_block(rotated, turned[some], nearest, bounds[some], own[some])
                asked = asked + low
                scores, far = np.empty(len(asked)), np.empty(len(asked))
                slice_of = max(1, (1 << 20) // plain.shape[1])  # many ties may be left: their vectors are taken in slices
                for i in range(0, len(asked), slice_of):
                    q, r = asked[i : i + slice_of], found[i : i + slice_of]
                    scores[i : i + slice_of] = (plain[r] * wanted[q]).sum(1) / (norms[r] * sizes[q])
                    far[i : i + slice_of] = ((rotated[r] - turned[q]) ** 2).sum(1)
                order = np.lexsort((ids[found], -scores, asked))
                best = order[_places(asked[order]) < nearest]
                out["query_id"].append(of[asked[best]])
                out["vec_id"].append(ids[found[best]])
                out["score"].append(scores[best])
                out["far"].append(far[best])
        out = {k: np.concatenate(v) if v else [] for k, v in out.items()}
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("far", pa.float64())]))

    return run


def nearest_neighbours(vectors: DataFrame, every: int = 50, nearest: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the nearest other rows found by cosine.

    Ties go to the smaller id; a query's own id is left out. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without id or of another length than most. Fewer
    candidates than ``nearest``: all of them. Of rows that repeat an id, the one with the least vector counts.
    No rows: no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite)
    rows = scratch.keep(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "rows")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.filter(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").collect()
    index = Index(np.array([r["vector"] for r in sample]), total, nearest)

    def place(batches):
        for batch in batches:
            plain = np.array(batch.column("vector").to_pylist(), np.float64).reshape(batch.num_rows, dim)
            unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(index.owner(unit), pa.int32()), pa.array([x.tobytes() for x in plain], pa.binary())],
                names=["vec_id", "list", "vector"],
            )

    placed = scratch.keep(rows.mapInArrow(place, "vec_id long, list int, vector binary"), "index")
    scratch.drop("rows")
    # One row a list, of which there are about the root of the rows: a million at 10**12 rows.
    held = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(index.lists, np.int64)
    counts[list(held)] = list(held.values())

    def probe(batches):
        for batch in batches:
            plain = _load(batch.column("vector"))
            lists = [index.probed(x, counts, nearest + 1).tolist() for x in plain / np.linalg.norm(plain, axis=1, keepdims=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    asked = placed.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vector").mapInArrow(probe, "vec_id long, vector binary, lists array<int>")
    asked = scratch.keep(asked.select("vec_id", "vector", F.posexplode("lists").alias("turn", "list")), "asked")
    blocks = spark.createDataFrame([(i, -(-n // BLOCK_ROWS)) for i, n in held.items()], "list int, blocks int")
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    keys = ["list", "block", "chunk"]

    def scan(queries: DataFrame) -> DataFrame:
        """query_id, vec_id, score, far: the nearest in each block of the lists asked for."""
        chunks = queries.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
        plan = F.broadcast(blocks.join(chunks, "list"))
        left = placed.join(plan, "list").withColumn("block", deal("blocks", 1)).withColumn("chunk", upto("chunks")).select(*keys, "vec_id", "vector")
        right = queries.join(plan, "list").withColumn("chunk", deal("chunks", 2)).withColumn("block", upto("blocks")).select(*keys, "vec_id", "vector", "bound")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(index, nearest), "query_id long, vec_id long, score double, far double")

    first = scratch.keep(scan(asked.filter("turn = 0").withColumn("bound", F.lit(None).cast("double"))), "first")
    place_of = F.row_number().over(W.partitionBy("query_id").orderBy("far", "vec_id"))
    bounds = first.withColumn("place", place_of).filter(F.col("place") == nearest).select(F.col("query_id").alias("vec_id"), F.col("far").alias("bound"))
    others = scan(asked.filter("turn > 0").join(bounds, "vec_id", "left"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
