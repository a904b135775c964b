import os
import random

import pytest
from pyspark.sql import functions as F

from strandbook.operators import fold, keyed, ordering, spans
from strandbook.plans import stored
from strandbook.plans.catalog import Ledger
from strandbook.sources.landed import LandedBlocks

DIR = "/root/testdata/sf0.001"


def test_points_meet_every_span_that_holds_them(spark):
    rng = random.Random(3)
    held = [(i, rng.randrange(-500, 500), rng.choice([None, rng.randrange(-500, 1500), rng.randrange(-500, 500)])) for i in range(120)]
    held += [(200, None, 5), (201, 7, 7), (202, 8, 3), (203, -(2**61), 2**61), (204, 7, 8)]
    points = [(i, rng.choice([None, *range(-600, 600, 7)])) for i in range(150)] + [(900, 7), (901, 2**61 - 1), (902, 2**61), (903, -(2**61) - 1), (904, 7)]
    p = spark.createDataFrame(points, "p int, at bigint")
    s = spark.createDataFrame(held, "s int, low bigint, high bigint")
    want = {(i, j) for i, at in points if at is not None for j, low, high in held if low is not None and low <= at and (high is None or at < high)}
    got = [(r["p"], r["s"]) for r in spans.span_join(p, s, "at", "low", "high").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    left = [(r["p"], r["s"]) for r in spans.span_join(p, s, "at", "low", "high", how="left").collect()]
    assert sorted(x for x in left if x[1] is not None) == sorted(want)
    assert {i for i, j in left if j is None} == {i for i, _ in points} - {i for i, _ in want}


def test_spans_may_be_missing_and_names_may_not_clash(spark):
    p, s = spark.createDataFrame([(1, 5)], "p int, at bigint"), spark.createDataFrame([], "low bigint, high bigint")
    assert spans.span_join(p, s, "at", "low", "high").count() == 0
    assert [tuple(r) for r in spans.span_join(p, s, "at", "low", "high", how="left").collect()] == [(1, 5, None, None)]
    with pytest.raises(ValueError, match="at"):
        spans.span_join(p, s.withColumn("at", F.lit(1)), "at", "low", "high")


def test_what_follows_crosses_ranges(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("n"), F.expr("id * 7919 % 5000 * 3").alias("v")).repartition(16)
    got = {r["n"]: r["next"] for r in ordering.followed(df, ["n"], "v", "next").collect()}
    assert got == {n: (n + 1) * 3 if n < 4999 else None for n in range(5000)}
    assert ordering.followed(df.limit(0), ["n"], "v", "next").count() == 0


def test_a_deep_page_reads_one_range(spark):
    df = spark.range(0, 1_200_000).select((F.col("id") * 999983 % 1_200_000).alias("n"))
    pages = ordering.Pages(df, ["n"], rows_a_range=50_000)
    assert len(pages.before) > 8 and pages.total == 1_200_000
    deep = pages.page(10_000)
    assert [r["n"] for r in deep.collect()] == list(range(999_900, 1_000_000))
    assert len({os.path.dirname(f) for f in deep.inputFiles()}) <= 2
    assert pages.page(12_001).count() == 0 and pages.page(0).first()["total_pages"] == 12_000
    # A page over the end of a range has the rows of both.
    cut = pages.before[3][1]
    page = cut // 100 + 1
    assert [r["n"] for r in pages.page(page).collect()] == list(range(page * 100 - 100, page * 100))
    assert ordering.Pages(df.limit(0), ["n"]).page(1).collect() == []


def test_a_key_opens_one_bucket(spark):
    df = spark.range(0, 60_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 3).alias("j"), F.col("id").alias("v"))
    one = keyed.KeyedRows(df, ["k"], buckets=200)
    got = one.get((7,), (8,), (None,), (999_999,))
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(k, k + 20_000 * i) for k in (7, 8) for i in range(3)]
    assert len(got.inputFiles()) <= 3 < len(one._of(one.present).inputFiles())
    assert one.get((None,)).collect() == []
    two = keyed.KeyedRows(df, ["k", "j"], rows_a_bucket=1000)
    assert two.buckets == 60
    pairs = [(7, 7 % 3), (9, (20_009) % 3)]
    want = sorted(v for v in range(60_000) if (v % 20_000, v % 3) in pairs)
    assert sorted(r["v"] for r in two.get(*pairs).collect()) == want
    assert sorted(r["v"] for r in two.matching(spark.createDataFrame(pairs * 2, "k long, j long")).collect()) == want
    with pytest.raises(ValueError, match="matching"):
        one.get(*((n,) for n in range(keyed.MANY + 1)))


def test_wide_costs_run_over_segments_and_saturate(spark):
    rng, top = random.Random(5), 2**256 - 1
    rows = []
    for i in range(600):
        entity = rng.choice(["a", "a", "b", None])
        cost = rng.choice([None, 0, 1, 2**32 - 1, 2**64, 10**30, 2**255, rng.getrandbits(200)] if entity == "b" else [None, rng.getrandbits(rng.choice((8, 63, 64, 200)))])
        rows.append((entity, rng.choice([None, *range(0, 90000, 450)]), i % 4, i, 0, cost))
    df = spark.createDataFrame([(*r[:5], None if r[5] is None else bytearray(r[5].to_bytes(32, "big"))) for r in rows], "entity_key string, block_number bigint, tx_index int, tx_hash int, op_index int, cost binary")
    for segments in (1, 7, 64):
        got = {r["tx_hash"]: int(r["total_cost"]) for r in fold.total_cost_in_segments(df, segments=segments).collect()}
        want, sums = {}, {}
        for entity, block, tx_index, tx, op, cost in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], *r[2:5])):
            sums[entity] = sums.get(entity, 0) + (cost or 0)
            want[tx] = min(sums[entity], top)
        assert got == want
    assert top in want.values() and any(2**63 < v < top for v in want.values())
    assert fold.total_cost_in_segments(df.limit(0)).count() == 0


def land(df, folder, chain, first, last):
    """The blocks of a range as one file that appears whole."""
    aside = f"{folder}-aside-{chain}-{first}"
    df.filter((F.col("chain_id") == chain) & F.col("number").between(first, last)).coalesce(1).write.parquet(aside)
    (part,) = (f for f in os.listdir(aside) if f.endswith(".parquet"))
    os.makedirs(f"{folder}/{chain}", exist_ok=True)
    os.rename(f"{aside}/{part}", f"{folder}/{chain}/{first}-{last}.parquet")


def test_landed_blocks_are_read_once_over_restarts(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("landed", "out", "offsets"))
    spark.dataSource.register(LandedBlocks)
    blocks = stored.l3_blocks(Ledger(spark, DIR)).cache()
    top = {r["chain_id"]: r["n"] for r in blocks.groupBy("chain_id").agg(F.max("number").alias("n")).collect()}
    low = {r["chain_id"]: r["n"] for r in blocks.groupBy("chain_id").agg(F.min("number").alias("n")).collect()}
    os.makedirs(folder)

    def run():
        stream = spark.readStream.format("landed_blocks").option("path", f"file://{folder}").option("batch", "4").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", offsets).option("path", out).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        got = spark.read.schema(blocks.schema).parquet(out)
        seen = [(r["chain_id"], r["number"]) for r in got.select("chain_id", "number").collect()]
        assert len(seen) == len(set(seen))
        return got, set(seen)

    land(blocks, folder, 0, low[0], 9)
    land(blocks, folder, 1, low[1], 4)
    land(blocks, folder, 1, 8, 11)  # 5 to 7 are missing: they hold chain 1
    _, seen = run()
    assert {c for c, _ in seen} == {0, 1} and max(n for c, n in seen if c == 0) == 9 and max(n for c, n in seen if c == 1) == 4
    assert run()[1] == seen  # a restart without new files
    land(blocks, folder, 1, 3, 7)  # overlaps what is there: blocks 3 and 4 do not come again
    land(blocks, folder, 2, low[2], top[2])  # a chain that the checkpoint does not know
    land(blocks, folder, 0, 10, top[0])
    _, seen = run()
    assert max(n for c, n in seen if c == 1) == 11
    land(blocks, folder, 1, 12, top[1])
    got, seen = run()
    assert len(seen) == blocks.count()
    for form in (stored.deposits_of, stored.withdrawals_of):
        assert sorted(map(repr, form(got).collect())) == sorted(map(repr, form(blocks).collect()))
