"""The search against brute force: ties, repeated ids, bounds, lists that grow with the table."""

import numpy as np

from strandbook.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def clustered(many, dim=32, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, many)] + 0.35 * rng.standard_normal((many, dim))


def brute(vectors, query, nearest=5):
    """The nearest rows of a query by cosine, ties to the smaller place."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ unit[query]
    score[query] = -np.inf
    return np.lexsort((np.arange(len(score)), -score))[:nearest].tolist()


def test_scan_keeps_the_nearest_and_a_known_bound_saves_work():
    points, kept, total = clustered(3000, 64), 0, 0
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    own = np.arange(0, 3000, 60)
    far = ((points[None, own] - points[:, None]) ** 2).sum(2).T
    far[np.arange(50), own] = np.inf
    want = np.argsort(far, axis=1, kind="stable")[:, :5]
    work = []
    for bounds in (np.full(50, np.inf), far[np.arange(50), want[:, -1]]):
        asked, found, summed = neighbours.scan_block(points, points[own], 5, bounds, own)
        work.append(summed)
        for i in range(50):
            kept, total = kept + len(set(want[i]) & set(found[asked == i])), total + 5
            assert own[i] not in found[asked == i]
    free, bounded = work
    blocks = 50 * 3000 * (64 // neighbours.COLUMN_BLOCK)
    assert kept >= 0.98 * total and bounded < free < 0.6 * blocks


def test_lists_grow_with_the_root_of_the_rows_from_one_sample():
    sample = clustered(4000)
    few, many = neighbours.Index(sample, 10**4, 5), neighbours.Index(sample, 10**9, 5)
    assert few.lists == 100 and 31_000 < many.lists < 33_000
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    for index in (few, many):
        owner = index.owner(unit)
        assert owner.min() >= 0 and owner.max() < index.lists
        assert sorted(index.order(unit[0]).tolist()) == list(range(index.lists))
        counts = np.bincount(owner, minlength=index.lists)
        assert counts[index.probed(unit[0], counts, 6)].sum() >= 6
    assert np.bincount(many.owner(unit)).max() < 0.2 * np.bincount(few.owner(unit)).max()


def test_ties_go_to_the_smaller_id_and_repeated_ids_count_once(spark):
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(0, 20)] + [(60, [0.0, 0.0, 1.0]), (60, [0.0, 0.0, 2.0]), (50, [5.0, 5.0, 0.0])]
    rows += [(i, [1.0, 1.0, 0.0]) for i in range(0, 20)] + [(7, [0.0, 0.0, 9.0])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("query_id", "rank").collect()
    got = {q: [(r["rank"], r["vec_id"]) for r in found if r["query_id"] == q] for q in (0, 50)}
    # The least vector of id 7 is (0, 0, 9): it is near to no query.
    assert got[0] == list(enumerate([1, 2, 3, 4, 5], 1)) and got[50] == list(enumerate([0, 1, 2, 3, 4], 1))


def test_few_rows_and_other_lengths(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [-1.0, 0.0]), (3, [1.0]), (50, None), (100, [1.0, float("inf")])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1), (0, 2)]


def test_recall_with_a_list_over_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "CHUNK_QUERIES", 8)
    points = clustered(3000)
    points[:1000] = points[0] + 0.1 * points[:1000]  # a third of the rows near one another
    found = neighbours.nearest_neighbours(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], SCHEMA)).collect()
    hits = 0
    for q in range(0, 3000, 50):
        got = [r["vec_id"] for r in found if r["query_id"] == q]
        assert len(got) == len(set(got)) == 5
        hits += len(set(got) & set(brute(points, q)))
    assert hits >= 0.9 * 5 * 60
