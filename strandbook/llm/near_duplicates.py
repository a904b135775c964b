"""N-gram Jaccard join with PartEnum signatures.

Every set of word shingles is hashed into first-level parts of the element domain, each part into second-level
parts, and the subsets of second-level parts are enumerated (see ``shingle_sets``). Numbers of parts follow
from the size band and the threshold, so that two sets that reach the threshold share a signature. Sets that
share one are candidates. Candidates pass exact lower bounds of their difference (sizes, the Hamming
distance of 512 parity bits, then that of parity sketches of twice as many bits as elements, which are
small beside the sets) and are then compared element by element.

Copies with equal sets are one class from the start. Each set is first compared with a hub, a member that shares
most with others, of one of its signature groups only. Groups that then hold more than one
component are compared across components: small ones pair by pair, which is at most SMALL / 2 pairs a
member. Members of larger ones are matched again by another exact criterion, all such groups at once: of two
near sets, in an order of elements by rising frequency, those parts hold a common element that the least
overlap of their sizes leaves no room to miss. Near copies that have more edits of their own than the
threshold lets pass, and unlike texts with a passage in common, meet nobody there. No link between different
sets is lost: a pair is left out only if it is in one component already, or below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import shingle_sets as sets
from .common import Scratch, checked_broadcast, components, row_key, unused

SKETCH_LONGS = 8
SMALL = 16  # members of a signature group that are compared pair by pair
HOT = 64  # rows of one signature in a task from which they are dealt over SALTS tasks
SALTS = 64
ROUNDS = 2  # in which sets meet hubs
REMEMBERED = 1 << 20  # sets that a task knows it has signed already


def _describe(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, sizes, keys, parities, fine = part.column(0), [], [], [], []
                for text in part.column(1):
                    elements = sets.shingle_set(text.as_py(), width)
                    sizes.append(len(elements))
                    keys.append(sets.set_key(elements))
                    parities.append(sets.parity(elements, SKETCH_LONGS))
                    fine.append(sets.fine_parity(elements))
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(x) for x in np.array(parities).T.copy()), pa.array(fine, pa.binary()), *part.columns[2:]],
                    names=["doc_id", "n", "key", *(f"p{i}" for i in range(SKETCH_LONGS)), "fine", *part.schema.names[2:]],
                )

    return run


def _sign(width: int, num: int, den: int):
    """(sig, salt, key) of each set once a task: signatures that are frequent in the task are dealt over salts, with one row left at salt 0."""

    def dealt(sigs, keys):
        sig, key = np.concatenate(sigs), np.concatenate(keys)
        order = np.argsort(sig, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(sig[order]) != 0])
        counts = np.diff(np.r_[first, len(sig)])
        often = np.empty(len(sig), bool)
        often[order] = np.repeat(counts > HOT, counts)
        salt = np.where(often, 1 + (sets.mix(key.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), 0)
        beacon = order[first[counts > HOT]]
        # Rows stay in the order of their sets: keys that follow each other are alike, and shuffle in less space.
        sig, key, salt = np.r_[sig, sig[beacon]], np.r_[key, key[beacon]], np.r_[salt, np.zeros(len(beacon), np.int32)]
        for at in range(0, len(sig), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (sig, salt.astype(np.int32), key)], names=["sig", "salt", "key"])

    def run(batches):
        bands, known, sigs, keys, held = sets.Bands(num, den), set(), [], [], 0
        for batch in batches:
            for text in batch.column(0):
                elements = sets.shingle_set(text.as_py(), width)
                key = sets.set_key(elements)
                if not len(elements) or key in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(key)
                sigs.append(sets.signatures(elements, bands))
                keys.append(np.full(len(sigs[-1]), key, np.int64))
                held += len(sigs[-1])
                if held >= 1 << 20:
                    yield from dealt(sigs, keys)
                    sigs, keys, held = [], [], 0
        if held:
            yield from dealt(sigs, keys)

    return run


def _elements(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [sets.shingle_set(x.as_py(), width) for x in part.column(0)]
                keys = pa.array([sets.set_key(x) for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes() for x in data], pa.binary())], names=["key", "elements"])

    return run


def _spelled(batches):
    for batch in batches:
        for key, elements in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.frombuffer(elements.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int64)), pa.array(found)], names=["key", "e"])


def _bounded(num: int, den: int):
    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a_n", "a_fine", "b_n", "b_fine"))
            good = [sets.may_reach(*row, num, den) for row in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a_elements"), batch.column("b_elements")
            good = [sets.reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _may_reach(num: int, den: int) -> Column:
    """Exact bounds on a row with a_n, b_n and both parity sketches: false means below the threshold."""
    apart = sum((F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))) for i in range(1, SKETCH_LONGS)), F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))))
    sizes = F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num
    return sizes & (apart * (num + den) <= (F.col("a_n") + F.col("b_n")) * (den - num))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when den * intersection >= num * union of their sets of ``width``-word shingles
    (words: runs without ASCII white space, A-Z lower-cased; a shorter text is one shingle).
    component_id is the smallest doc_id reachable by links, itself included.

    Null or wordless texts have n_shingles 0, link with nothing and are their own component. Repeated
    rows stay, each with the same component. A row without doc_id links with nothing; it gets the component
    of documents with an equal set, else null. No rows: no rows. Other columns are not read.
    """
    return _components(docs, width, num, den, id_col, text_col)


def _rare_first(num: int, den: int):
    """(group, side, key) for rows of (key, n, common), common being the set's frequent elements with their numbers of sets, rarest first.

    Sets of at least ``other`` elements share more than ``least`` elements with this one if they are near, so
    that they meet within the first n - least + 1 of either, in one order of all elements.
    """

    def run(batches):
        bands = sets.Bands(21, 20 + 2)  # narrow bands of sizes: their ratio is 22 / 21
        tops = bands.tops
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                groups, sides, keys = [], [], []
                for key, n, common in zip(*(part.column(c).to_pylist() for c in ("key", "n", "common"))):
                    elements = np.array([x["e"] for x in common], np.int64).view(np.uint64)
                    rare, own = n - len(elements), bands.of(n)
                    for other in range(bands.of(-(-n * num // den)), bands.of(n * den // num) + 1):
                        low = max(tops[other - 1] + 1 if other else 1, -(-n * num // den))
                        first = n - -(-num * (n + low) // (num + den)) + 1 - rare
                        if first > 0:
                            pair = np.uint64((min(own, other) << 20 | max(own, other)) * sets.PLACES[4] & (1 << 64) - 1)
                            groups.append(sets.mix(elements[:first] + pair).view(np.int64))
                            sides.append(np.full(len(groups[-1]), (own > other) - (own < other), np.int32))
                            keys.append(np.full(len(groups[-1]), key, np.int64))
                if groups:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (groups, sides, keys)], names=["sig", "side", "key"])

    return run


def _components(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """As ``jaccard_components``; if keyed, with row_key and component, the key of one set of the component (null: no words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keys = [row_key(id_col, text_col).alias("row_key")] if keyed else []
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    parities = [f"p{i}" for i in range(SKETCH_LONGS)]
    schema = "doc_id long, n long, key long, " + ", ".join(f"{p} long" for p in parities) + ", fine binary" + (", row_key binary" if keyed else "")
    slim = scratch.keep(plain.mapInArrow(_describe(width), schema), "slim")
    named = slim.filter("n > 0 and doc_id is not null")
    sketched = ["n", *parities]
    facts = scratch.keep(named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in [*sketched, "fine"])), "facts")

    # Signature groups of two or more different sets. A frequent signature is met by many tasks, each of which salts it.
    signed = plain.filter("doc_id is not null").select("text").mapInArrow(_sign(width, num, den), "sig long, salt int, key long")
    by_sig = W.partitionBy("sig", "salt")
    members = signed.withColumn("low", F.min("key").over(by_sig)).withColumn("high", F.max("key").over(by_sig)).filter("low < high or salt > 0")
    members = members.dropDuplicates(["sig", "salt", "key"]).select("sig", "key")
    members = scratch.keep(members, "members")
    sizes = members.groupBy("sig").agg(F.count("*").alias("members"))
    degrees = members.join(sizes, "sig").groupBy("key").agg(F.sum("members").alias("degree"))
    ranked = members.join(scratch.keep(degrees, "degrees"), "key")
    hubs = ranked.groupBy("sig").agg(F.max(F.struct("degree", "key")).alias("hub"), F.count("*").alias("members"))
    hubs = scratch.keep(hubs.select("sig", "members", "hub.degree", F.col("hub.key").alias("hub")), "hubs")

    def told(side: str, columns: list[str]) -> DataFrame:
        return facts.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Different pairs (a, b) that reach the threshold: by coarse sketches, then fine ones, then element by element."""
        near = pairs.select("a", "b").distinct()
        for side in ("a", "b"):
            near = near.join(told(side, sketched), side)
        near = scratch.keep(near.filter(_may_reach(num, den)).select("a", "b"), f"{name}-coarse")
        near = near.join(told("a", ["n", "fine"]), "a").join(told("b", ["n", "fine"]), "b")
        near = scratch.keep(near.mapInArrow(_bounded(num, den), "a long, b long"), f"{name}-near")
        elements = elements_of(near.select(F.col("a").alias("key")).union(near.select("b")).distinct(), f"{name}-elements")
        one = elements.select(F.col("key").alias("a"), F.col("elements").alias("a_elements"))
        two = elements.select(F.col("key").alias("b"), F.col("elements").alias("b_elements"))
        links = scratch.keep(near.join(one, "a").join(two, "b").mapInArrow(_verify(num, den), "a long, b long"), name)
        scratch.drop(f"{name}-elements", f"{name}-near", f"{name}-coarse")
        return links

    def elements_of(keys: DataFrame, name: str) -> DataFrame:
        """(key, elements) of sets, from one document of each."""
        keys = scratch.keep(keys, f"{name}-keys")
        chosen = facts.join(keys, "key", "left_semi").select("doc_id").distinct()
        found = plain.join(checked_broadcast(chosen, 16), "doc_id", "left_semi").select("text").mapInArrow(_elements(width), "key long, elements binary")
        found = scratch.keep(found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("elements").alias("elements")), name)
        scratch.drop(f"{name}-keys")
        return found

    def across(rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of rows (sig, side, key, label) of one sig, of different labels and opposite sides, for signatures of several labels.

        The most frequent label of a signature is met by the others only, not by itself, and a pair comes out of the
        join only if coarse sketches let it.
        """
        totals = rows.groupBy("sig", "label").agg(F.count("*").alias("n"))
        most = totals.groupBy("sig").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("sig", "most")
        held = rows.join(checked_broadcast(most, 24), "sig").join(checked_broadcast(facts.select("key", *sketched), 120), "key")
        held = scratch.keep(held.select("sig", "side", "key", "label", "most", *sketched), f"across-{len(scratch.paths)}")
        left, right = (held.select("sig", "most", *(F.col(c).alias(f"{s}_{c}") for c in ("side", "key", "label", *sketched))) for s in "ab")
        met = left.filter("a_label <> most").join(right.drop("most"), "sig").filter("a_side = -b_side and a_label <> b_label and (b_label = most or a_label < b_label)").filter(_may_reach(num, den))
        return met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))

    # Each set meets one hub in a round, of the hubs of its groups that are not in its component the one that shares most.
    labels, links = None, None
    for turn in range(ROUNDS):
        rows = members.join(hubs.filter("members > 1"), "sig").filter("key <> hub")
        if turn:
            label_of = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))  # noqa: E731,B023
            rows = rows.join(label_of("key", "own"), "key", "left").join(label_of("hub", "other"), "hub", "left")
            rows = rows.filter(F.coalesce("own", "key") != F.coalesce("other", "hub"))
        stars = rows.groupBy("key").agg(F.max(F.struct("degree", "hub")).alias("best")).select(F.col("best.hub").alias("a"), F.col("key").alias("b"))
        found = verified(stars, f"star-links-{turn}")
        links = found if links is None else links.union(found)
        labels = components(links, scratch, f"stars-{turn}")

    # What the hubs did not join: groups of more than one component.
    placed = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    spread = placed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).filter("low < high")
    spread = scratch.keep(spread.select("sig", "members"), "spread")
    placed = scratch.keep(placed.join(checked_broadcast(spread, 24), "sig"), "placed")
    few = placed.filter(F.col("members") <= SMALL).withColumn("side", F.lit(0))
    pairs = across(few)

    # Larger groups, all at once: sets that share an element among the rarest of both.
    many = scratch.keep(placed.filter(F.col("members") > SMALL).select("key", "label").distinct(), "many")
    elements = elements_of(many.select("key"), "many-elements")
    spelled = elements.mapInArrow(_spelled, "key long, e long")
    often = scratch.keep(spelled.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    common = spelled.join(checked_broadcast(often, 24), "e").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("common"))
    ranked = common.join(facts.select("key", "n"), "key").select("key", "n", "common")
    rare = scratch.keep(ranked.mapInArrow(_rare_first(num, den), "sig long, side int, key long").join(many, "key"), "rare")
    more = verified(pairs.union(across(rare)), "cross-links")
    labels = components(links.union(more), scratch, "all")

    classes = facts.select("key", F.col("doc_id").alias("low"))
    linked = labels.withColumnRenamed("node", "key")
    lows = linked.join(classes, "key").groupBy("label").agg(F.min("low").alias("component_id"))
    of_key = classes.join(linked.join(lows, "label").select("key", "label", "component_id"), "key", "left").select("key", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("label", "key").alias("component"))
    of_key = scratch.keep(of_key, "of-key")
    out = slim.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"), *(["row_key"] if keyed else [])).join(of_key, "key", "left")
    result = scratch.keep(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["row_key", "component"] if keyed else [])), "result")
    scratch.drop_all("result")
    return result


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per component, the first by doc_id and row_key, with all columns.

    Documents without words stay, and so do rows without doc_id. Of rows that repeat a doc_id with its text,
    one stays; different texts of one doc_id are judged apart.
    """
    found = _components(docs, width, num, den, id_col, text_col, keyed=True).filter("doc_id is not null")
    worded = found.filter("n_shingles > 0")
    first = worded.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("first")).select("first.row_key")
    key = unused("__key", docs)
    gone = worded.select("row_key").distinct().join(first, "row_key", "left_anti").withColumnRenamed("row_key", key)
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(checked_broadcast(gone, 32), key, "left_anti")
    if found.groupBy("row_key").count().filter("count > 1").limit(1).count():
        kept = kept.filter(F.col(id_col).isNotNull()).dropDuplicates([key]).unionByName(kept.filter(F.col(id_col).isNull()))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
