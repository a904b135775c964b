"""The mix against brute force: targets, exponential rates, copies that miss no target by much."""

import math

from pyspark.sql import functions as F

from strandbook.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r["source"], []).append(r)
    return out


def test_each_source_comes_within_a_hundredth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    rows = mixing.mix(docs).collect()
    whole = {}
    for r in rows:
        whole[r["source"]] = whole.get(r["source"], 0) + r["size"]
        assert r["size"] == sizes[r["doc_id"]]
    goals = mixing.targets_for(list(whole.items()))
    assert abs(sum(goals.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    for source, held in by_source(rows).items():
        assert abs(sum(r["taken"] for r in held) - goals[source]) <= 0.01 * goals[source]
        # Rates meet the target in sum and are exponential in the logarithm of the size, up to the limit.
        assert math.isclose(sum(r["rate"] * r["size"] for r in held), goals[source], rel_tol=1e-6)
        inner = sorted((math.log(r["size"]), math.log(r["rate"])) for r in held if 0 < r["rate"] < mixing.LIMIT - 1e-9)
        (x0, y0), (x1, y1) = inner[0], inner[-1]
        assert all(abs(y0 + (y1 - y0) * (x - x0) / (x1 - x0) - y) < 1e-6 for x, y in inner)
        assert all(math.floor(r["rate"] + 1e-9) <= r["copies"] <= math.floor(r["rate"] + 1e-9) + 1 for r in held if r["size"])


def test_repeated_rows_get_equal_copies_and_count_as_often_as_they_are(spark):
    rows = [(1, "a", "w " * 40)] * 7 + [(i, "a", "w " * (i % 23 + 3)) for i in range(2, 60)] + [(i, None, "w " * 30) for i in range(60, 90)] + [(90, "b", None), (91, "b", "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert len({r["copies"] for r in got if r["doc_id"] == 1}) == 1 and len(got) == len(rows)
    for source, held in by_source(got).items():
        assert abs(sum(r["taken"] for r in held) - held[0]["target"]) <= (0 if source == "b" else 15)


def test_gaps_close_in_turns(spark):
    from strandbook.llm.common import Scratch

    rated = spark.createDataFrame([("s", b"a", 50, 10), ("s", b"b", 30, 90), ("s", b"c", 12, 91), ("s", b"d", 12, 91), (None, b"e", 9, 5), (None, b"f", 8, 95), ("t", b"g", 5, None)], "source string, row_key binary, size long, v long")
    cuts = spark.createDataFrame([("s", 40, 44.0), (None, 40, -1.0), ("t", 40, 5.0), ("u", 0, 3.0)], "source string, cut long, gap double")
    found = {(r["source"], bytes(r["row_key"]), r["more"]) for r in mixing._gaps_closed(rated, cuts, Scratch(spark)).collect()}
    # 44: first 30 more, then 12 more (the smaller key of two alike); nothing of size 2 is left. -1: taking 9 back would leave 8.
    assert found == {("s", b"b", 1), ("s", b"c", 1)}
    assert mixing._gaps_closed(rated.filter(F.lit(False)), cuts, Scratch(spark)).count() == 0
