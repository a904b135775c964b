"""Earlier operators: places in linear work, arrivals written once, writers beside each other."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from strandbook.llm import personal_data, shards


def test_running_totals_and_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    spans = lambda n: sorted((s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(n)))
    rows = [(spans(rng.randint(0, 12)), spans(rng.randint(0, 12))) for _ in range(60)]
    kind = "array<struct<start int, end int>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    sums = personal_data.running(F.transform("a", lambda s: s["end"]), lambda x, y: x + y)
    for a, b, total, flags in df.select("a", "b", sums, personal_data.overlapped(F.col("a"), F.col("b"))).collect():
        ends = [e for _, e in a]
        assert total == [sum(ends[: i + 1]) for i in range(len(ends))]
        assert flags == [any(s < end and e > start for s, e in b) for start, end in a]


def test_long_texts_are_redacted_in_order(spark):
    import time

    rng = random.Random(9)
    short = ["été 1.2.3.4 and a@b.cc 😀 +1 234 555 1234", "9.9.9.9" * 3, "x" * 3000 + " 1.2.3.4 " + "é" * 5000, "4111 1111 1111 1111" + "y" * 2047 + " q@r.st"]
    df = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    spans = {r.doc_id: r.found for r in personal_data.find(df).collect()}
    for r in personal_data.redact(df).collect():
        text, at, out = short[r.doc_id], 0, ""
        for s in sorted(spans[r.doc_id], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                out += text[at : s["start"]] + "[" + (*personal_data.KINDS, "other")[s["kind"]].upper() + "]"
            at = max(at, s["end"])
        assert r.text == out + text[at:]
    numbers = " ".join(f"{rng.randrange(10**6)}, 1.2.3.{i % 256}" for i in range(60_000))
    began = time.time()
    row = personal_data.redact(spark.createDataFrame([(1, numbers)], "doc_id long, text string")).first()
    assert row.text.count("[IP]") == 60_000 and "1.2.3." not in row.text
    assert time.time() - began < 90  # squared work takes many minutes


def store(spark, path):
    return shards.ShardStore(spark, f"file://{path}", base=64)


def test_arrivals_are_runs_of_their_own(spark, tmp_path):
    rows = spark.range(100).withColumn("part", F.col("id") % 3)
    held = store(spark, tmp_path)
    assert held.append_each(rows, F.col("id") % 4) == 4
    assert [held.read(rows.schema, v).count() for v in range(1, 5)] == [25, 50, 75, 100]
    assert sorted(map(tuple, held.read(rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    assert held.append_each(rows.limit(0), F.col("id") % 4) == 4


@pytest.mark.parametrize("other", ["append", "compact"])
def test_writers_beside_each_other_lose_nothing(spark, tmp_path, other):
    held, df = store(spark, tmp_path), spark.range(30).coalesce(1)
    for n in range(5):
        held.append(df.filter(F.col("id") % 5 == n))
    fails = []

    def work(what):
        try:
            what()
        except Exception as e:  # noqa: BLE001 - told by the main thread
            fails.append(e)

    more = [spark.range(100, 110), spark.range(200, 210)]
    jobs = [lambda: held.append(more[0]), (lambda: store(spark, tmp_path).append(more[1])) if other == "append" else (lambda: store(spark, tmp_path).compact(df.schema))]
    threads = [threading.Thread(target=work, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not fails
    want = [*range(30), *range(100, 110), *(range(200, 210) if other == "append" else ())]
    assert sorted(r.id for r in held.read(df.schema).collect()) == want


def test_vacuum_finds_what_dead_writers_left(spark, tmp_path):
    held = store(spark, tmp_path)
    held.append(spark.range(10))
    spark.range(5).write.parquet(f"file://{tmp_path}/data/{'d' * 32}")  # a writer that died before its commit
    spark.range(5).write.parquet(f"file://{tmp_path}/manifests/{'e' * 32}")
    held.vacuum()
    assert (tmp_path / "data" / ("d" * 32)).exists()  # perhaps still at work
    held.vacuum(dead_after=0)
    assert not (tmp_path / "data" / ("d" * 32)).exists() and not (tmp_path / "manifests" / ("e" * 32)).exists()
    assert held.read(spark.range(1).schema).count() == 10
