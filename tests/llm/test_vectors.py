"""Vector searches against brute force, with copies, ties and unusable rows."""

import numpy as np
import pytest

from halyard.llm import exact_topk, vp_search

SCHEMA = "vec_id long, embedding array<float>, label int, part string, dim string, score int, rank string"


def frame(spark, n=700, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)).astype(np.float32)
    points[::3] = points[0]  # a third of the rows hold the same vector
    rows = [(i, [float(x) for x in p], 0, "a", "b", 1, "c") for i, p in enumerate(points)]
    odd = [
        (n + 1, None, 0, "a", "b", 1, "c"),
        (n + 2, [], 0, "a", "b", 1, "c"),
        (n + 3, [0.0] * dim, 0, "a", "b", 1, "c"),
        (n + 4, [float("nan")] * dim, 0, "a", "b", 1, "c"),
        (n + 5, [float("inf")] * dim, 0, "a", "b", 1, "c"),
        (n + 6, [None] * dim, 0, "a", "b", 1, "c"),
        (None, [1.0] * dim, 0, "a", "b", 1, "c"),
        rows[5],
        (n + 10, [1.0, 2.0], 0, "a", "b", 1, "c"),
    ]
    return spark.createDataFrame(rows + odd, SCHEMA), points.astype(float)


def brute(points, queries, k, scores):
    out = {}
    for q in queries:
        row = scores(points[q])
        row[q] = -np.inf
        best = np.lexsort((np.arange(len(row)), -row))[:k]
        out[int(q)] = [(int(i), row[i]) for i in best]
    return out


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (vp_search.FACTOR, 0.9)])
def test_vantage_point_search(spark, factor, least):
    df, points = frame(spark)
    rows = vp_search.nearest(
        df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, factor=factor, shard_rows=150, block_rows=20, leaf_rows=8
    ).collect()
    want = brute(points, range(0, 700, 20), 10, lambda q: (points * q).sum(1))
    # the query of another dimension finds nothing; ids divisible by 20 beyond the plain rows are unusable
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= least
    if factor == 1.0:
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


@pytest.mark.parametrize("kind", ["small numbers", "one line", "rounded"])
def test_more_ties_than_places(spark, kind):
    draw = np.random.default_rng(4)
    if kind == "small numbers":
        points = draw.integers(-2, 3, (300, 3)).astype(float) + [0, 0, 3]
    elif kind == "one line":
        points = np.stack([np.ones(600), draw.normal(size=600)], axis=1)
        points[0] = [1.0, 0.0]  # its products are all one
    else:
        points = np.round(draw.normal(size=(300, 5)), 1) / 3  # products tie but for the order of addition
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    rows = vp_search.nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 20, factor=1.0, shard_rows=100, block_rows=7, leaf_rows=8).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(points, range(0, len(points), 20), 20, lambda q: (points * q).sum(1))


@pytest.mark.parametrize("bin_bits", [2, 11])
def test_exact_top_k(spark, bin_bits):
    df, points = frame(spark, seed=1)
    whole = np.floor(1024 * points)
    rows = exact_topk.top_k(
        df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, shard_rows=150, block_rows=5, bin_bits=bin_bits
    ).collect()
    # the zero vector takes part here and scores zero
    padded = np.vstack([whole, np.full((4, 8), 0.0)])
    want = brute(padded, range(0, 700, 50), 10, lambda q: np.where(np.isin(np.arange(704), [700, 701, 702]), -np.inf, (padded * q).sum(1)))
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: [(i, int(s)) for i, s in found] for q, found in want.items()}


def test_few_candidates_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    near = vp_search.nearest(few, few.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).collect()
    assert sorted((r.query_id, r.rank) for r in near) == [(q, k) for q in (0, 20, 100) for k in (1, 2)]
    top = exact_topk.top_k(few, few.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in top) == [(0, 20, 524288), (0, 100, 0), (100, 0, 0), (100, 20, 524288)]
    none = few.limit(0)
    assert vp_search.nearest(none, none, "vec_id", "embedding", 5).count() == 0
    assert exact_topk.top_k(none, none, "vec_id", "embedding", 5).count() == 0


def test_scores_beyond_a_double_stay_exact(spark):
    big = 1.0e6
    rows = [(100, [big, 1.0]), (1, [big, 2.0]), (2, [big, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, df.where("vec_id = 100"), "vec_id", "embedding", 2).collect()
    scale = int(big * 1024)
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, scale**2 + 1024 * 2048), (2, 2, scale**2 + 1024**2)]
