"""Order statistics against brute force, with heavy ties and a hot group."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.operators.ordered import (
    area_under_curve,
    exact_quantiles,
    hash_positions,
    kolmogorov_tail,
    ks_two_sample,
    lattice_tail,
    roc_points,
    running_totals,
)
from halyard.operators.trailing import trailing_features


def test_running_totals_match_one_window(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.7 else f"g{i % 5}", i, random.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, n long")
    got = running_totals(df, ["g"], ["o"], ["n"])
    frame = W.partitionBy("g").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("n_through", F.sum("n").over(frame))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("accuracy", [50, 200, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(size=20000), 3)
    b = np.where(rng.random(20000) < 0.9, 5.0, rng.random(20000))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    ps = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "b"], ps, accuracy=accuracy)
    assert got["a"] == pytest.approx(np.quantile(a, ps).tolist(), abs=1e-12)
    assert got["b"] == pytest.approx(np.quantile(b, ps).tolist(), abs=1e-12)


def test_quantiles_skip_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got["a"] == [2.0] and got["b"] == [None]


def test_quantiles_of_a_full_and_a_sparse_column(spark):
    """The approximate bracket of a column with few values must not stand for the interpolated value."""
    rows = spark.range(300_000).select(
        F.col("id").cast("double").alias("a"), F.when(F.col("id") < 10, F.col("id").cast("double")).alias("b")
    )
    for accuracy in (100, 10_000):
        got = exact_quantiles(rows, ["a", "b"], [0.25, 0.5, 0.75], accuracy=accuracy)
        assert got["b"] == [2.25, 4.5, 6.75]
        assert got["a"] == [74999.75, 149999.5, 224999.25]


def test_a_null_group_keeps_its_rows(spark):
    rows = [(i, None if i % 10 == 0 else i % 2, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, g long, n long")
    assert running_totals(df, ["g"], ["id"], ["n"]).count() == 100
    placed = hash_positions(df, "id", ["g"])
    assert placed.count() == 100
    assert sorted(r.position for r in placed.where("g is null").collect()) == list(range(10))


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=400), 1), np.round(rng.normal(0.4, 1, size=300), 1)
    a = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    b = spark.createDataFrame([(float(v),) for v in y], "v double")
    row = ks_two_sample(a, b, ["v"]).first()
    grid = np.union1d(x, y)
    d = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    assert row.statistic == pytest.approx(d, abs=1e-12)
    assert (row.ref_rows, row.inc_rows) == (400, 300)
    assert row.p_value < 0.05
    same = ks_two_sample(a, a, ["v"]).first()
    assert same.statistic == 0 and same.p_value == 1.0


def by_all_orders(x, y):
    """The share of all assignments of the pooled places to the first sample whose distance is as large."""
    pooled = sorted([(v, 0) for v in x] + [(v, 1) for v in y])
    n, m = len(x), len(y)

    def gap(places):
        chosen, worst, i = set(places), 0, 0
        for place in range(n + m):
            i += place in chosen
            worst = max(worst, abs(i * m - (place + 1 - i) * n))
        return worst

    ends = [k for k in range(n + m) if k == n + m - 1 or pooled[k][0] != pooled[k + 1][0]]
    counts = [sum(s == 0 for _, s in pooled[: k + 1]) for k in ends]
    seen = max(abs(i * m - (k + 1 - i) * n) for i, k in zip(counts, ends))
    orders = list(itertools.combinations(range(n + m), n))
    return seen, sum(gap(o) >= seen for o in orders) / len(orders)


def test_exact_p_value_of_small_samples(spark):
    cases = [([1, 2, 2, 3, 9], [2, 4, 4, 5, 6, 7, 8]), ([1, 1, 1, 1, 1], [1, 1, 2, 2, 3, 3, 3]), ([5, 6, 7], [5, 6, 7, 8])]
    for x, y in cases:
        seen, share = by_all_orders(x, y)
        assert lattice_tail(len(x), len(y), seen) == pytest.approx(share, abs=1e-12)
        sides = [spark.createDataFrame([(float(v),) for v in side], "v double") for side in (x, y)]
        assert ks_two_sample(*sides, ["v"]).first().p_value == pytest.approx(share, abs=1e-12)


def test_exact_p_value_of_twenty_against_twenty():
    """Equal sizes have a closed form: paths that leave the band, by reflection."""
    n = 20
    for h in range(1, n + 1):
        outside = 2 * sum((-1) ** (k - 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1)) / math.comb(2 * n, n)
        assert lattice_tail(n, n, h * n) == pytest.approx(outside, rel=1e-9)
    assert lattice_tail(20, 20, 0) == 1.0
    # the two ends of one sample wholly below the other: two orders of all
    assert lattice_tail(5, 7, 35) == pytest.approx(2 / math.comb(12, 5), rel=1e-12)


def test_the_series_takes_over_near_the_exact_value(spark):
    n = m = 5000
    exact = lattice_tail(n, m, round(0.02 * n * m))
    series = spark.range(1).select(kolmogorov_tail(F.lit(0.02), F.lit(float(n)), F.lit(float(m)))).first()[0]
    assert exact == pytest.approx(series, rel=0.05)


def test_auc_counts_ties_half(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.2), (0, 0.1), (0, 0.2), (1, 0.9)]
    df = spark.createDataFrame(rows, "label int, score double")
    pairs = [(p, n) for lp, p in rows if lp for ln, n in rows if not ln]
    want = sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs)
    assert area_under_curve(df, "label", "score").first()[0] == pytest.approx(want)
    points = {r.threshold: (r.fpr, r.tpr) for r in roc_points(df, "label", "score").collect()}
    assert points[0.1] == (1.0, 1.0) and points[0.9] == (1 / 3, 2 / 3)
    one_class = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert area_under_curve(one_class, "label", "score").first()[0] is None


def test_hash_positions_number_each_group(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    got = hash_positions(df, "id", ["g"])
    for g, n in ((0, 666), (1, 334)):
        assert sorted(r.position for r in got.where(F.col("g") == g).collect()) == list(range(n))


@pytest.mark.parametrize("hot_rows", [0, 7, 60, 10**9])
def test_sliced_windows_equal_plain_ones(spark, hot_rows):
    random.seed(9)
    rows = [
        (random.choice([1, 1, 1, 1, 2, 3]) if i % 10 else i, i % 37, i, None if i % 11 == 0 else random.random())
        for i in range(700)
    ]
    df = spark.createDataFrame(rows, "k int, t int, tie int, v double")
    got = trailing_features(df, "k", ["t", "tie"], ["v"], (1, 3), (2, 6), hot_rows=hot_rows)
    base = W.partitionBy("k").orderBy("t", "tie")
    want = df.select(
        "*",
        F.lag("v", 1).over(base).alias("v_lag_1"),
        F.lag("v", 3).over(base).alias("v_lag_3"),
        *[
            f("v").over(base.rowsBetween(-n, -1)).alias(f"v_roll_{name}_{n}")
            for n in (2, 6)
            for name, f in (("mean", F.avg), ("std", F.stddev_samp))
        ],
    )
    assert got.columns == want.columns

    def rounded(df):
        return sorted(
            [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=lambda r: r[2]
        )

    assert rounded(got) == rounded(want)


def test_short_groups(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (2, 2, 3.0), (2, 3, 4.0)], "k int, t int, v double")
    out = {(r.k, r.t): r for r in trailing_features(df, "k", ["t"], ["v"], (1,), (3,)).collect()}
    assert out[1, 1].v_lag_1 is None and out[1, 1].v_roll_mean_3 is None
    assert out[2, 2].v_roll_mean_3 == 1.0 and out[2, 2].v_roll_std_3 is None
    assert out[2, 3].v_roll_std_3 == pytest.approx(np.std([1, 3], ddof=1))
