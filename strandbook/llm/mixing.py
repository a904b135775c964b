"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Document rates r minimise the divergence sum(size * (r log r - r)) under
the token constraints sum(size * r) = target of each source, 0 <= r <= LIMIT, and balance constraints: in each
source, the mean log length over the words taken shall be that of all words of all sources. Balance is soft
(SOFTNESS), since a source may have no lengths to balance with; the token constraints are not. The convex dual has one
multiplier per constraint; Newton steps on it need only sums over all documents, which Spark aggregates with
map-side combining. The solution tilts documents exponentially: r = min(exp(m0 + m1 * x), LIMIT).

Rates become whole copies: everyone gets floor(r), and those whose hash, divided by what is left of their rate,
falls below a source's threshold get one more. Thresholds are found on all documents by refining a histogram, and
leave a gap that is smaller than the next document; up to TURNS single documents then gain or lose their extra copy, the
one that leaves the least gap at a time (the best of each of CLASSES classes of hashes are weighed with all their repetitions).
No rank, sort or group of documents is needed, so a source with most of the rows is no burden. One row per source
reaches the driver.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, Scratch, checked_broadcast, row_key, unused

WEIGHTS = (5, 2, 1)
LIMIT = 3  # a source's target, and a document's copies, are at most so many times what is there
BINS, LEVELS = 1024, 3  # refinement of the hash threshold: BINS ** LEVELS steps
CLASSES = 64  # candidates a source has for closing the gap that its threshold leaves
TURNS = 3  # of closing gaps by single documents
SPREAD = 4  # hashes divided by rates are binned up to here
SOFTNESS = 0.05  # how much balance may be missed: a multiplier m1 leaves the mean SOFTNESS * m1 deviations off
NEWTON_STEPS, TOLERANCE = 40, 1e-9


def targets_for(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> dict[str | None, float]:
    """Target per source: shares of all sizes by weight, capped at limit times the source's size, excess reshared by weight.

    Sources are ordered by code point, null last, and take the weights in turn. Sizes of 0 get target 0.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    left, free, target = float(sum(size.values())), set(order), {}
    while free:
        whole = sum(weight[s] for s in order if s in free)
        over = [s for s in order if s in free and left * weight[s] / whole > limit * size[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in order if s in free}
            break
        for s in over:
            target[s] = float(limit * size[s])
            free.discard(s)
        left = float(sum(size.values())) - sum(target.values())
    return target


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    starts = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[^{SPACE}]++", "x")
    return (F.length(starts) - F.length(F.replace(starts, F.lit("x"), F.lit("")))).cast("long")


def solve_rates(sized: DataFrame, targets: DataFrame, features: tuple[str, ...] = (), feature_targets: dict[str, float] | None = None, limit: float = math.inf, softness: float = 0.0) -> DataFrame:
    """(source, m0, m1..): dual multipliers per source by distributed Newton steps.

    sized has source, size and the feature columns; targets has source and target. Each source has its own
    block of constraints: its words, and for each named feature the mean over its words, missed by softness times
    its multiplier. Rates stop at limit; a target of limit times the source's size or more gives that rate to all.
    Sources with size or target 0 get no row. The step is damped until the dual objective falls.
    """
    count, top = 1 + len(features), math.log(limit)
    wanted = {r["source"]: [r["target"]] + [r["target"] * (feature_targets or {})[f] for f in features] for r in targets.collect()}
    size = {r["source"]: float(r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    live = [s for s in wanted if wanted[s][0] > 0 and size.get(s, 0) > 0]
    lam = {s: [min(top, math.log(wanted[s][0] / size[s]))] + [0.0] * (count - 1) for s in live}
    open_ = [s for s in live if wanted[s][0] < limit * size[s] * (1 - 1e-9)]
    step, best = {s: [0.0] * count for s in open_}, {}
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    spark = sized.sparkSession
    schema = "source string, " + ", ".join(f"m{i} double" for i in range(count))
    for _ in range(NEWTON_STEPS if features else 0):  # without features the multiplier is the logarithm it starts with
        trial = {s: [a + b for a, b in zip(lam[s], step[s])] for s in open_}
        if not open_:
            break
        held = spark.createDataFrame([(s, *trial[s]) for s in open_], schema)
        z = sum((F.col(f"m{i}") * x[i] for i in range(1, count)), F.col("m0") * x[0])
        tilted, free = F.exp(F.least(z, F.lit(top))), z < top
        dual = F.when(free, tilted).otherwise(limit * (1 + z - top)) if limit < math.inf else tilted
        joined = sized.join(checked_broadcast(held, 64), sized["source"].eqNullSafe(held["source"]))
        sums = joined.groupBy(held["source"].alias("source")).agg(
            F.sum(dual * F.col("size")).alias("z"), *(F.sum(tilted * F.col("size") * x[i]).alias(f"g{i}") for i in range(count)),
            *(F.sum(F.when(free, tilted * F.col("size") * x[i] * x[j]).otherwise(0.0)).alias(f"h{i}_{j}") for i in range(count) for j in range(i, count)),
        )
        worst = 0.0
        for r in sums.collect():
            s = r["source"]
            soft = [0.0] + [softness * wanted[s][0]] * (count - 1)
            value = r["z"] - sum(a * b for a, b in zip(trial[s], wanted[s])) + sum(c * a * a / 2 for c, a in zip(soft, trial[s]))
            if s in best and value > best[s] + 1e-9 * abs(best[s]):
                step[s] = [b / 2 for b in step[s]]
                worst = max(worst, 1.0 if max(map(abs, step[s])) > 1e-12 else 0.0)
                continue
            lam[s], best[s] = trial[s], value
            gradient = [r[f"g{i}"] - wanted[s][i] + soft[i] * trial[s][i] for i in range(count)]
            hessian = [[r[f"h{min(i, j)}_{max(i, j)}"] + (soft[i] if i == j else 0.0) for j in range(count)] for i in range(count)]
            step[s] = _solve(hessian, [-g for g in gradient])
            worst = max(worst, max(abs(g) for g in gradient) / wanted[s][0])
        if worst < TOLERANCE:
            break
    else:
        if features and open_:
            warnings.warn(f"rates are not balanced after {NEWTON_STEPS} steps: off by {worst:.2g} of a target", stacklevel=2)
    return spark.createDataFrame([(s, *lam[s]) for s in live], schema)


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small symmetric system, with a little added to the diagonal."""
    import numpy as np

    a = np.array(matrix)
    return np.linalg.solve(a + np.eye(len(right)) * 1e-12 * max(1.0, float(np.trace(a))), np.array(right)).tolist()


def _thresholds(parted: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, cut, gap): documents with v below the cut get one more copy, which leaves the gap; parted has (source, size, v), goals (source, goal).

    Each level sums the words of one range of each source into BINS cells, and goes on in the cell that holds the goal.
    """
    scale = BINS**LEVELS
    at = goals.select("source", F.lit(0).cast("long").alias("low"), F.col("goal").alias("left"))
    for level in range(LEVELS):
        width = scale // BINS ** (level + 1)
        told = checked_broadcast(at.withColumnRenamed("source", "of"), 40)
        cells = parted.join(told, F.col("source").eqNullSafe(F.col("of"))).withColumn("cell", F.floor((F.col("v") - F.col("low")) / width)).filter(F.col("cell").between(0, BINS - 1))
        cells = cells.groupBy("source", "cell").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy("cell"))
        crossed = cells.withColumn("upto", upto).filter(F.col("upto") > F.col("left")).groupBy(F.col("source").alias("of")).agg(F.min_by(F.struct("cell", "upto", "n"), "cell").alias("x"))
        rest = F.col("left") - (F.col("x.upto") - F.col("x.n"))
        # Without a crossing everything is taken.
        low = F.when(F.col("x").isNull(), scale).otherwise(F.col("low") + F.col("x.cell") * width).cast("long")
        at = at.join(crossed, F.col("source").eqNullSafe(F.col("of")), "left").select("source", low.alias("low"), F.when(F.col("x").isNull(), 0.0).otherwise(rest).cast("double").alias("left"))
        at = scratch.keep(at, f"cut-{level}")
    return at.select("source", F.col("low").alias("cut"), F.col("left").alias("gap"))


def _gaps_closed(rated: DataFrame, cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, row_key, more): documents that get one copy more or less than their cut says, as that brings their source nearer.

    In each of TURNS, a source whose words are too few gives one more document a copy, and one whose words are too many
    takes one back: the document that leaves the least gap.
    """
    state, done = cuts, []
    for turn in range(TURNS):
        told = checked_broadcast(state.withColumnRenamed("source", "of"), 48)
        pool = rated.filter("v is not null").join(told, F.col("source").eqNullSafe(F.col("of")))
        for found in done:
            picked = checked_broadcast(found.select(F.col("source").alias("by"), F.col("row_key").alias("by_key")), 56)
            pool = pool.join(picked, F.col("source").eqNullSafe(F.col("by")) & (F.col("row_key") == F.col("by_key")), "left_anti")
        off = lambda size: F.abs(F.abs(F.col("gap")) - F.col(size))
        pool = pool.filter(((F.col("v") < F.col("cut")) == (F.col("gap") < 0)) & (off("size") < F.abs(F.col("gap"))))
        some = pool.groupBy("source", F.pmod("v", F.lit(CLASSES)).alias("class")).agg(F.min(F.struct(off("size").alias("off"), "v", "row_key", "gap")).alias("x"))
        some = scratch.keep(some.select(F.col("source").alias("of"), F.col("x.row_key").alias("of_key"), F.col("x.gap").alias("gap")), f"some-{turn}")
        same = F.col("source").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("of_key"))
        whole = rated.join(checked_broadcast(some, 80), same).groupBy("source", "row_key", "gap").agg(F.sum("size").alias("n"))
        best = whole.filter(off("n") < F.abs(F.col("gap"))).groupBy("source").agg(F.min(F.struct(off("n").alias("off"), "row_key", "n", "gap")).alias("x"))
        found = scratch.keep(best.select("source", F.col("x.row_key").alias("row_key"), F.signum("x.gap").cast("int").alias("more"), F.col("x.n").alias("n")), f"turn-{turn}")
        done.append(found)
        moved = found.select(F.col("source").alias("of"), (F.col("more") * F.col("n")).alias("moved"))
        state = state.join(checked_broadcast(moved, 48), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "cut", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap"))
    out = done[0]
    for found in done[1:]:
        out = out.unionByName(found)
    return out.drop("n")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, row_key, source, size, source_size, target, rate, copies, taken.

    Sizes are words (null text: 0). A null source is one source, last in order. Documents of size 0, and
    all documents of a source of size 0, get no copies. Repeated rows have the same hash and get equal
    copies. A rerun over the same rows gives the same copies, in whatever order they come. No rows: no rows.
    """
    spark, scratch, scale = docs.sparkSession, Scratch(docs.sparkSession), BINS**LEVELS
    key = row_key(id_col, source_col, text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("row_key"))
    sized = scratch.keep(sized.withColumn("u", F.pmod(F.xxhash64(F.col("row_key"), F.lit(1)), F.lit(scale))), "sized")
    sizes = [(r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goals = targets_for(sizes, weights, limit)
    about = spark.createDataFrame([(s, n, float(goals[s])) for s, n in sizes], "source string, source_size long, target double")
    length = F.log(F.greatest("size", F.lit(1)).cast("double"))
    m = sized.agg(F.sum("size").cast("double").alias("n"), F.sum(length * F.col("size")).alias("s"), F.sum(length * length * F.col("size")).alias("q")).first()
    mean = m["s"] / m["n"] if m["n"] else 0.0
    spread = math.sqrt(max(m["q"] / m["n"] - mean * mean, 0.0)) if m["n"] else 0.0
    balanced = sized.withColumn("x", (length - mean) / (spread if spread > 1e-9 else 1.0))
    found = solve_rates(balanced, about, ("x",), {"x": 0.0}, float(limit), SOFTNESS)
    told = checked_broadcast(about.join(found.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of"), 80)
    rate = F.when((F.col("size") > 0) & F.col("m0").isNotNull(), F.least(F.exp(F.col("m0") + F.col("m1") * F.col("x")), F.lit(float(limit)))).otherwise(0.0)
    rated = balanced.join(told, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    # Of two documents with equal hashes, the one whose rate leaves more comes first.
    place = ((F.col("u") + 0.5) / F.col("part") / SPREAD).cast("long")
    rated = rated.withColumn("v", F.when(F.col("part") > 1e-9, F.least(place, F.lit(scale - 1))))
    rated = scratch.keep(rated.select("doc_id", "row_key", "source", "size", "source_size", "target", "rate", "whole", "v"), "rated")
    left = rated.groupBy("source").agg(F.greatest(F.max("target") - F.sum(F.col("whole") * F.col("size")), F.lit(0.0)).alias("goal"))
    cuts = _thresholds(rated.filter("v is not null").select("source", "size", "v"), left, scratch)
    closed = _gaps_closed(rated, cuts, scratch).select(F.col("source").alias("by"), F.col("row_key").alias("by_key"), "more")
    scratch.drop("sized")
    told = checked_broadcast(cuts.withColumnRenamed("source", "of"), 48)
    out = rated.join(told, F.col("source").eqNullSafe(F.col("of")))
    out = out.join(checked_broadcast(closed, 56), F.col("source").eqNullSafe(F.col("by")) & (F.col("row_key") == F.col("by_key")), "left")
    extra = F.when(F.col("v") < F.col("cut"), 1).otherwise(0) + F.coalesce("more", F.lit(0))
    out = out.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.least(F.col("whole") + extra, F.lit(limit))))
    return out.select("doc_id", "row_key", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as many times as the mix takes it; columns stay."""
    key, copies, copy = (unused(name, docs) for name in ("__key", "__copies", "__copy"))
    found = mix(docs, id_col, source_col, text_col).filter("copies > 0").select(F.col("row_key").alias(key), F.col("copies").alias(copies)).dropDuplicates([key])
    joined = docs.withColumn(key, row_key(id_col, source_col, text_col)).join(checked_broadcast(found, 40), key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
