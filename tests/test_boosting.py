"""Boosted ensembles against plain loops, both plans against each other, grouped metrics, the pool of jobs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import attribution
from halyard.operators import boosting as B
from halyard.operators.scoring import classification_metrics, classification_metrics_by, regression_metrics, regression_metrics_by
from halyard.plans import boosted
from halyard.plans import training as T
from halyard.plans.registry import ModelRegistry
from halyard.plans.together import together


def plain(spec, x, y, weight):
    """Margins after all rounds by loops over nodes, features and rows; no shares of rows or columns."""
    fine = lambda v: round(v * B.FINE) / B.FINE
    margin = [0.0 if spec.classes else fine(sum(fine(v) for v in y)) / len(y)] * len(y)
    for _ in range(spec.rounds):
        grads = []
        for m, label, w in zip(margin, y, weight):
            p = 1 / (1 + math.exp(-m))
            grads.append((fine(w * (p - label)), fine(w * p * (1 - p))) if spec.classes else (fine(w * (m - label)), fine(w)))
        nodes, value = [(list(range(len(y))), 0)], {}

        def leaf(rows):
            g, h = (sum(grads[i][k] for i in rows) for k in (0, 1))
            return -spec.rate * g / (h + spec.l2)

        while nodes:
            rows, level = nodes.pop()
            for i in rows:
                value[i] = leaf(rows)
            if level == spec.depth:
                continue
            g, h = (sum(grads[i][k] for i in rows) for k in (0, 1))
            best = (1e-12, None)
            for f in range(x.shape[1]):
                for cut in sorted({x[i, f] for i in rows})[:-1]:
                    left = [i for i in rows if x[i, f] <= cut]
                    gl, hl = (sum(grads[i][k] for i in left) for k in (0, 1))
                    gr, hr = g - gl, h - hl
                    if hl >= spec.least_weight and hr >= spec.least_weight:
                        gain = 0.5 * (gl * gl / (hl + spec.l2) + gr * gr / (hr + spec.l2) - g * g / (h + spec.l2)) - spec.least_gain
                        if gain > best[0]:
                            best = (gain, (f, cut))
            if best[1]:
                f, cut = best[1]
                nodes += [([i for i in rows if x[i, f] <= cut], level + 1), ([i for i in rows if x[i, f] > cut], level + 1)]
        margin = [m + value[i] for i, m in enumerate(margin)]
    return margin


def sample(classes, n=200, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 12, (n, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] > 11).astype(float) if classes else (x[:, 0] * x[:, 1] / 144 - 0.3 * x[:, 2] / 12)
    return x, y + (0 if classes else draw.normal(0, 0.01, n)), draw.uniform(0.5, 2, n)


@pytest.mark.parametrize("classes", [True, False])
def test_one_model_equals_plain_boosting(classes):
    x, y, weight = sample(classes)
    spec = B.Spec(classes, 12, 3, 0.3, least_weight=2.0, least_gain=0.001)
    base = 0.0 if classes else sum(np.rint(y * B.FINE)) / B.FINE / len(y)
    names = np.arange(len(y), dtype=np.uint64)
    _, margin = B.fitted(spec, x.astype(np.uint8), names, y, weight, base, 32, 1.0, np.ones(len(y), bool))
    assert margin == pytest.approx(plain(spec, x, y, weight), abs=1e-9)


def frame(spark, classes, n=300, parts=3):
    x, y, weight = sample(classes, n, 2)
    rows = [(i, *map(float, r), float(v), float(w)) for i, (r, v, w) in enumerate(zip(x, y, weight))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, weight double")
    return T.assembled(df, list("abcd"), ["id", "label", "weight"]).repartition(parts, "id")


@pytest.mark.parametrize("classes", [True, False])
def test_both_plans_agree_whatever_the_blocks(spark, classes, monkeypatch):
    rows = frame(spark, classes).withColumn("fold", (F.col("id") % 3).cast("int"))
    folds = T.held_out_folds(rows, "id", 3)
    specs = [B.Spec(classes, 4, 2, 0.3), B.Spec(classes, 3, 3, 0.2, 0.8, 0.6, 2.0, 0.01, seed=7)]
    tasks = [boosted.Task(s, k, 1.5) for s in specs for k in range(3)]
    args = (T.VECTOR, "id", F.col("__train"), F.col("__test"), 3, tasks)
    read = lambda df: sorted(map(tuple, df.select("model", "label", "prediction").collect()))
    small = read(boosted.fold_scores(folds.rows, *args))
    assert len(small) == 2 * 300
    monkeypatch.setattr(boosted, "BLOCK_BYTES", 0)
    monkeypatch.setattr(boosted, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosted, "REFRESH", 2)
    large = read(boosted.fold_scores(folds.rows.repartition(5), *args))
    assert large == [pytest.approx(r, abs=1e-12) for r in small]


def test_a_level_is_one_job_whatever_the_number_of_models(spark, monkeypatch):
    rows = frame(spark, True).withColumn("fold", (F.col("id") % 2).cast("int"))
    folds = T.held_out_folds(rows, "id", 2)
    packed = boosted.written(
        boosted.blocks(folds.rows, T.VECTOR, "id", boosted.limits_of(rows, T.VECTOR), F.col("label"), F.lit(1.0), F.col("__train"), F.col("__test")), "test-blocks"
    )
    counted = []
    collect = boosted.DataFrame.collect
    monkeypatch.setattr(boosted.DataFrame, "collect", lambda self: counted.append(1) or collect(self))
    for models in (1, 4):
        counted.clear()
        boosted.level_by_level(packed, [boosted.Task(B.Spec(True, 3, 2, 0.3), k % 2) for k in range(models)], [0.0] * models, 1.0)
        assert len(counted) <= 3 * 2


@pytest.mark.parametrize("classes", [True, False])
def test_a_model_is_kept_scored_and_explained(spark, classes, tmp_path):
    rows = frame(spark, classes)
    model = boosted.BoostedTrees(B.Spec(classes, 6, 3, 0.3), T.VECTOR).fit(rows)
    registry = ModelRegistry(spark, str(tmp_path))
    registry.register("m", model, {"mae": 1.0}, list("abcd"), "boosted", "kept")
    column = "score" if classes else "prediction"
    want = {r.id: r[column] for r in T.scored(model, rows).collect()}
    got = {r.id: r[column] for r in T.scored(registry.load("m"), rows).collect()}
    assert got == want and len(want) == 300
    assert sum(model.featureImportances) == pytest.approx(1.0)
    top = max(range(4), key=lambda i: model.featureImportances[i])
    assert top in (0, 1)
    long = attribution.attributions(model, rows, "id", T.VECTOR, list("abcd"))
    totals = {r.id: r.total for r in long.groupBy("id").agg((F.max("base_value") + F.sum("attribution")).alias("total")).collect()}
    back = {i: math.log(p / (1 - p)) for i, p in want.items()} if classes else want
    assert all(totals[i] == pytest.approx(back[i], abs=1e-8) for i in want)


def test_refits_agree_however_rows_lie(spark):
    rows = frame(spark, True)
    spec = B.Spec(True, 4, 3, 0.2, rows_share=0.7)
    one, two = (boosted.BoostedTrees(spec, T.VECTOR).fit(r).getOrDefault("content") for r in (rows, rows.repartition(7)))
    assert one == two


def test_rows_without_a_label_and_empty_frames(spark):
    rows = frame(spark, True)
    holes = rows.withColumn("label", F.when(F.col("id") < 200, F.col("label")))
    spec = B.Spec(True, 3, 2, 0.3)
    fit = lambda r: boosted.BoostedTrees(spec, T.VECTOR).fit(r).getOrDefault("content")
    assert fit(holes) == fit(rows.where("id < 200"))
    one = rows.limit(1)
    assert boosted.BoostedTrees(spec, T.VECTOR).fit(one).transform(one).count() == 1


def test_grouped_metrics_equal_those_of_each_group(spark):
    draw = np.random.default_rng(3)
    rows = [(int(draw.integers(0, 4)), float(draw.integers(0, 2)), float(draw.integers(0, 2)), round(float(draw.random()), 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, label double, prediction double, score double")
    for metrics, by, columns in (
        (classification_metrics, classification_metrics_by, ["label", "prediction", "score"]),
        (regression_metrics, regression_metrics_by, ["label", "score"]),
    ):
        grouped = {r.g: r.asDict() for r in by(df, ["g"], *columns).collect()}
        for g in range(4):
            alone = metrics(df.where(F.col("g") == g), *columns).first().asDict()
            assert {k: grouped[g][k] for k in alone} == pytest.approx(alone)


def test_the_pool_keeps_the_order_and_raises(spark):
    assert together(spark, [lambda i=i: spark.range(i).count() for i in range(6)], 3) == list(range(6))

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        together(spark, [fails, lambda: spark.range(10).count()])


def test_of_two_children_only_the_smaller_is_added_up(monkeypatch):
    """The sums of a level are read off at most half of the rows; the trees are those of all sums."""
    draw = np.random.default_rng(5)
    bins = draw.integers(0, 32, (5000, 6)).astype(np.uint8)
    label = (bins[:, 0] * 1.0 + bins[:, 3] + draw.normal(0, 5, len(bins)) > 31).astype(float)
    spec = B.Spec(True, 3, 4, 0.3, 0.8, 0.7)
    added, seen = B._added, []
    monkeypatch.setattr(B, "_added", lambda parts, at, *rest: seen.append(len(at)) or added(parts, at, *rest))
    names, weight = draw.integers(0, 1 << 62, len(bins)).astype(np.uint64), np.where(label == 1, 1.7, 1.0)
    trees, margin = B.fitted(spec, bins, names, label, weight, 0.0, 32, 1.0, np.ones(len(bins), bool))
    roots = [n for n in seen if n > 2500]
    assert len(roots) == 3 and max(n for n in seen if n not in roots) <= max(roots) / 2
    again = np.zeros(len(bins))
    for number, tree in enumerate(trees):
        now, more = B.Growing(spec, number, 6), True
        g, h = B.gradients(spec, label, weight, again)
        rows = np.flatnonzero(B.drawn(spec, number, names))
        while more:
            total = B.sums(bins[rows], now.tree.place(bins[rows]), now.frontier, now.columns, g[rows], h[rows], 32)
            more = now.take(B.best_splits(total, spec))
        assert (now.tree.value == tree.value).all() and (now.tree.feature == tree.feature).all()
        again = again + tree.value[tree.place(bins)]
    assert (again == margin).all()


def test_rows_of_large_nodes_are_added_up_by_codes_of_three_features():
    """Whole codes, single features and any number of bins give the sums of plain loops."""
    draw = np.random.default_rng(8)
    for n_bins in (32, 12, 200):
        bins = draw.integers(0, n_bins, (40000, 5)).astype(np.uint8)
        g, h = np.rint(draw.normal(0, B.FINE, len(bins))), np.rint(draw.random(len(bins)) * B.FINE)
        place = np.where(draw.random(len(bins)) < 0.8, 1, 2)
        wanted = np.array([0, 2, 3, 4])
        got = B.sums(bins, place, [1, 2], wanted, g, h, n_bins)
        for side, x in enumerate((g, h)):
            for node in (1, 2):
                for i, f in enumerate(wanted):
                    here = place == node
                    assert (got[side, node - 1, i] == np.bincount(bins[here, f], x[here], n_bins)).all()


def test_the_demand_job_bins_the_rows_of_a_large_table_once(spark, monkeypatch):
    """Above ``SPREAD_ROWS`` boosting is not Spark's, which reads all rows anew for every level of every round; rounds, depth and rate are the same."""
    from halyard.plans import jobs

    rows = frame(spark, False).drop("weight")
    assert type(jobs.boosting(rows, 5, 3, 0.3, "id")).__name__ == "GBTRegressor"
    monkeypatch.setattr(T, "SPREAD_ROWS", 300)
    learner = jobs.boosting(rows, 5, 3, 0.3, "id")
    assert (learner.spec.rounds, learner.spec.depth, learner.spec.rate) == (5, 3, 0.3)
    model = learner.fit(rows)
    x = np.array([r.x for r in rows.select(F.expr("id"), T.vector_to_array(T.VECTOR).alias("x"), "label").orderBy("id").collect()])
    y = np.array([r.label for r in rows.orderBy("id").collect()])
    shift, unit = (y.min() + y.max()) / 2, (y.max() - y.min()) / 2
    want = np.array(plain(learner.spec, x, (y - shift) / unit, np.ones(len(y)))) * unit + shift
    got = [r.prediction for r in model.transform(rows).orderBy("id").collect()]
    assert got == pytest.approx(want.tolist(), abs=1e-6)


def test_one_value_of_all_rows_is_held_once(spark):
    rows = frame(spark, True, parts=1)
    args = (rows, T.VECTOR, "id", boosted.limits_of(rows, T.VECTOR), F.col("label"))
    same = [tuple(r) for r in boosted.blocks(*args, F.lit(2.0), F.lit(3), F.lit(0)).collect()]
    assert [len(p) for p in same[0][2:5]] == [8, 8, 8] and len(same) == 1
    block = boosted.Block(same, 0)
    assert len(block.label) == 300 and (block.weight == 2.0).all() and (block.train == 3).all() and len(block.test) == 300
    other = [tuple(r) for r in boosted.blocks(*args, F.lit(1.0), F.lit(3), F.lit(0)).collect()]
    both = boosted.Block(same + other, 0)
    assert both.weight.tolist() == [2.0] * 300 + [1.0] * 300
