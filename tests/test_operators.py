"""Small hand-computed frames: nulls, ties, zero denominators, unknown categories, empty input."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from halyard.functions import bounded, calendar_parts, half_up, safe_div, whole_days
from halyard.operators import cleaning as C
from halyard.operators import derivations as G
from halyard.operators import drift as D
from halyard.operators import encoding as N
from halyard.operators import joins as J
from halyard.operators import quality as Q
from halyard.operators import recommend as A
from halyard.operators import rollups as R
from halyard.operators import scoring as Z
from halyard.operators.describe import correlated_columns, correlation_pairs, describe_all
from halyard.operators.information import neighbour_information
from halyard.sources import sinks, tables
from tests.checking import plan


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rounding_and_division(spark):
    df = spark.createDataFrame([(2.675, 0.0), (-1.25, 2.0), (None, 1.0), (1e17, 4.0)], "x double, y double")
    assert [r[0] for r in rows(df.select(half_up("x", 1)))] == [2.7, -1.2, None, 1e17]
    assert [r[0] for r in rows(df.select(safe_div("x", "y")))] == [None, -0.625, None, 2.5e16]
    assert [r[0] for r in rows(df.select(bounded("x", 0.0, 2.0)))] == [2.0, 0.0, None, 2.0]


def test_calendar_parts_of_a_missing_date(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29),), (None,)], "d timestamp_ntz")
    got = rows(df.select(*[e.alias(n) for n, e in calendar_parts("d", "p").items()]))
    assert got == [(2024, 2, 1, 3, 29, 0, 1), (0, 0, 0, 0, 0, 0, 0)]
    late, early = F.lit(dt.datetime(2024, 1, 1, 1)), F.lit(dt.datetime(2024, 1, 2))
    assert spark.range(1).select(whole_days(late, early)).first()[0] == -1


def test_clean_table(spark):
    raw = spark.createDataFrame(
        [(" x ", "2024-01-05", -5.0, 120.0), (" x ", "2024-01-05", -5.0, 120.0), (None, "never", None, -1.0)],
        "`Customer Name` string, `Signup-Date` string, Annual_Revenue double, health_score double",
    )
    clean = C.clean_table(raw, "customers")
    assert clean.columns == ["customer_name", "signup_date", "annual_revenue", "health_score"]
    got = sorted(rows(clean), key=str)
    assert got == [("Unknown", None, None, 0.0), ("x", dt.datetime(2024, 1, 5), 0.0, 100.0)]
    assert rows(C.cleaning_summary("customers", raw, clean)) == [("customers", 3, 2, 2, 2, 1)]
    assert rows(C.duplicate_count(raw)) == [(1,)]


def test_clean_all_writes_tables(spark, tmp_path):
    raw = spark.createDataFrame([(1, "b"), (1, "b"), (2, None)], "id int, kind string")
    summary = C.clean_all({"things": raw}, str(tmp_path))
    assert rows(summary) == [("things", 3, 2, 1, 0, 1)]
    assert sorted(rows(tables.read_table(spark, str(tmp_path), "things"))) == [(1, "b"), (2, "Unknown")]


def test_validation_reports_injected_faults(spark):
    orders = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, -1.0), ("b", 9, None), (None, None, 1.0), (None, 1, 2.0)],
        "order_id string, customer_id int, order_amount double",
    )
    customers = spark.createDataFrame([(1,), (2,), (None,)], "customer_id int")
    assert Q.primary_key(orders, "orders", "order_id").first().failed_records == 2
    broken = Q.foreign_key(orders, "orders", "customer_id", customers, "customers", "customer_id").first()
    assert (broken.check_name, broken.failed_records, broken.status) == ("foreign_key_customer_id_to_customers", 2, "fail")
    report = Q.validate({"orders": orders, "customers": customers}, {"orders": 10})
    by_check = {(r.table_name, r.check_name): r for r in report.collect()}
    assert by_check["orders", "range_order_amount"].failed_records == 1
    assert by_check["orders", "range_quantity"].status == "skip" and by_check["orders", "range_quantity"].passed
    assert by_check["orders", "minimum_row_count"].failed_records == 5
    assert by_check["orders", "required_columns"].failed_records == 12
    counts = dict(rows(Q.status_counts(report)))
    assert set(counts) == {"pass", "fail", "skip"} and sum(counts.values()) == len(by_check)
    score = Q.quality_score(report).first()[0]
    assert score == pytest.approx(math.floor(1e4 * counts["pass"] / len(by_check) + 0.5) / 100)
    assert Q.summarise(report).first().pass_rate > score / 100
    assert all(r.status == "fail" for r in Q.failures(report).collect())


def test_quality_score_of_nothing(spark):
    assert Q.quality_score(Q.empty_report(spark)).first()[0] == 0.0


SAMPLE = [("A", "X", 10.0, 0), ("B", "Y", 20.0, 1), ("A", "X", 30.0, 0), ("C", "Z", 40.0, 1), (None, "Z", 50.0, None)]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(SAMPLE, "category string, segment string, value double, target int")


def test_one_hot_and_ordinal(sample):
    hot = N.one_hot(sample, ["category"], keep_source=False)
    assert hot.columns == ["segment", "value", "target", "category_A", "category_B", "category_C", "category_Unknown"]
    assert [r.category_Unknown for r in hot.collect()] == [0, 0, 0, 0, 1]
    placed = N.ordinal(sample, {"category": ["B", "A"]})
    assert [r.category_ordinal for r in placed.collect()] == [1, 0, 1, -1, -1]
    assert N.categories(sample, "category") == ["A", "B", "C", "Unknown"]


def test_one_hot_of_a_hundred_thousand_values(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    n = 100_000
    df = spark.range(n, numPartitions=4).select("id", F.concat(F.lit("v"), F.col("id") % n).alias("a"), (F.col("id") % 3).alias("b"))

    def collected(*given):
        raise AssertionError("collected")

    for name in ("collect", "toPandas", "toLocalIterator", "first"):
        monkeypatch.setattr(Classic, name, collected)
    words = N.dictionary(df, ["a", "b"])
    out = N.one_hot_sparse(df, "id", ["a", "b"], words)
    monkeypatch.undo()
    shape = words.agg(F.count("*"), F.min("index"), F.max("index"), F.count_distinct("index")).first()
    assert tuple(shape) == (n + 3, 0, n + 2, n + 3)
    ordered = words.orderBy("column_name", "value").select("index").limit(1000)
    assert [r["index"] for r in ordered.collect()] == list(range(1000))
    assert out.where("size = 100003 and size(indices) = 2 and size(values) = 2").count() == n


def test_sparse_one_hot_agrees_with_wide_columns(spark, sample):
    rows = sample.withColumn("id", F.monotonically_increasing_id())
    words = N.dictionary(rows, ["category", "segment"])
    names = {r["index"]: f"{r.column_name}_{r.value}" for r in words.collect()}
    wide = {r.id: r for r in N.one_hot(rows, ["category", "segment"]).collect()}
    sparse = N.one_hot_sparse(rows, "id", ["category", "segment"]).select("*", N.as_vector().alias("v"))
    for r in sparse.collect():
        assert {names[i] for i in r.indices} == {c for c in names.values() if wide[r.id][c] == 1.0}
        assert r.v.size == len(names) and list(r.v.indices) == list(r.indices)
    unseen = N.one_hot_sparse(spark.createDataFrame([(1, "new")], "id int, category string"), "id", ["category"], words).first()
    assert unseen.indices == [] and unseen["size"] == len(names)


def test_out_of_fold_means_leave_the_own_fold_out(spark):
    rows = [(i, f"c{i % 3}" if i % 7 else None, float(i % 2 + i % 3) if i % 5 else None) for i in range(60)] + [(100, "alone", 9.0)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    out = N.out_of_fold(df, "id", ["c"], "y", folds=4)
    fold = {r.id: r.f for r in df.select("id", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(4)).alias("f")).collect()}
    got = {r.id: r.c_target_encoded for r in out.collect()}
    assert out.columns == ["id", "c", "y", "c_target_encoded"] and len(got) == 61
    for i, c, _ in rows:
        others = [(cc, y) for j, cc, y in rows if fold[j] != fold[i] and y is not None]
        mean = sum(y for _, y in others) / len(others)
        same = [y for cc, y in others if cc == c and c is not None]
        want = (sum(same) + mean * 10) / (len(same) + 10) if same else mean
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_neighbour_information_against_brute_force(spark):
    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, n))

    draw = random.Random(6)
    rows = [(draw.choice("abc"), round(draw.gauss(0, 1) * 4) / 4, draw.random(), float(draw.randint(0, 2)), None) for _ in range(500)]
    rows = [(c, x + (c == "a"), y, z, w) for c, x, y, z, w in rows] + [("lonely", 0.0, 0.5, 1.0, 2.0), (None, 1.0, 1.0, 1.0, 1.0), ("two", 0.25, 0.5, 0.0, 0.0), ("two", 3.0, 0.6, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cls string, x double, y double, z double, w double").repartition(5)
    got = {r.feature: r.information for r in neighbour_information(df, ["x", "y", "z", "w"], "cls").collect()}
    for f in range(1, 5):
        pairs = [(r[0], r[f] or 0.0) for r in rows if r[0] not in (None, "lonely")]
        total = 0.0
        for i, (c, v) in enumerate(pairs):
            same = sorted(abs(v - u) for j, (d, u) in enumerate(pairs) if d == c and j != i)
            used = min(3, len(same))
            radius = same[used - 1]
            m = sum(abs(v - u) < radius if radius else v == u for _, u in pairs)
            total += psi(used) - psi(len(same) + 1) - psi(m)
        want = max(psi(len(pairs)) + total / len(pairs), 0.0)
        assert got["xyzw"[f - 1]] == pytest.approx(want, abs=1e-9)


def test_neighbour_information_has_no_window_over_a_whole_feature(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("c"))
    assert "SinglePartition" not in plan(neighbour_information(df, ["x"], "c")).split("Window")[0]
    assert neighbour_information(df.where("x < 0"), ["x"], "c").count() == 0


@pytest.mark.parametrize("limit", [100, 1])
def test_frequency_and_target(sample, limit):
    out = N.encode(sample, frequency=["category"], target=["category", "segment"], target_column="target", limit=limit)
    got = {r.value: r for r in out.collect()}
    assert [got[v].category_frequency for v in (10.0, 20.0, 40.0, 50.0)] == [0.4, 0.2, 0.2, 0.2]
    assert got[10.0].category_target_encoded == pytest.approx((0 * 2 + 0.5 * 10) / 12)
    assert got[20.0].category_target_encoded == pytest.approx((1 * 1 + 0.5 * 10) / 11)
    assert got[50.0].category_target_encoded == pytest.approx(0.5)
    assert got[50.0].segment_target_encoded == pytest.approx((1 * 1 + 0.5 * 10) / 11)
    assert N.encode(sample, frequency=["absent"]).columns == sample.columns


@pytest.mark.parametrize(
    "method,want",
    [
        ("standard", [(v - 30) / math.sqrt(200) for v in (10, 20, 30, 40, 50)]),
        ("minmax", [0, 0.25, 0.5, 0.75, 1]),
        ("robust", [-1, -0.5, 0, 0.5, 1]),
    ],
)
def test_scaling(sample, method, want):
    flat = sample.withColumn("flat", F.lit(3.0))
    out = N.scale(flat, ["value", "flat", "category"], method)
    assert [r[f"value_{method}_scaled"] for r in out.collect()] == pytest.approx(want)
    assert {r[f"flat_{method}_scaled"] for r in out.collect()} == {0.0}
    with pytest.raises(ValueError):
        N.scale(sample, ["value"], "unheard")


def test_correlation_filter_keeps_the_first(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, (-1.0) ** i) for i in range(10)], "a double, b double, c double")
    assert correlated_columns(df, 0.9) == ["b"]
    assert correlation_pairs(df).count() == 3


def test_dense_facts_equal_the_grid_completed_by_a_join(spark):
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (None, "n")], "k int, name string")
    facts = spark.createDataFrame(
        [(1, "m1", 5, 1.5), (1, "m3", None, 2.5), (2, "m2", 7, None), (9, "m1", 1, 1.0), (None, "m1", 2, 2.0), (2, None, 3, 3.0)],
        "k int, month string, n long, x double",
    )
    months = F.array(*map(F.lit, ["m1", "m2", "m3"]))
    want = J.complete_grid(J.dense_grid(keys, months, "month"), facts, ["k", "month"], {"n": 0})
    got = J.dense_facts(keys, facts, "k", months, "month", {"n": 0})
    assert got.columns == want.columns
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)


def test_rows_of_a_repeated_key_come_back_after_the_windows(spark):
    from halyard.plans import features as X

    lines = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (None, 14)], "k int, line int")
    goods = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, None, 2.0), (None, "n", 9.0), (4, "z", 4.0)], "k int, name string, x double")
    narrow = X._with_rows(lines, goods, "k", ["name", "x"], "more")
    assert sorted(r.line for r in narrow.collect()) == [10, 11, 12, 13, 14]  # a line is one row
    got = X._all_rows(narrow, ["name", "x"], "more")
    want = J.with_dimension(lines, goods, "k", ["name", "x"])
    assert got.columns == want.columns
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)


def test_validation_entries_keep_whole_keys_and_compiled_code(spark):
    orders = spark.createDataFrame([("a", 1, 10, -1), ("a", 2, None, 0), (None, 9, 30, 2), (None, None, 40, 3)], "order_id string, customer_id long, product_id int, quantity long")
    people = spark.createDataFrame([(1,), (2,), (2,), (None,)], "customer_id long")
    goods = spark.createDataFrame([("10",), ("30",)], "product_id string")  # a text here, a number there: both are compared as texts
    report = Q.validate({"orders": orders, "customers": people, "products": goods}, {"orders": 5, "customers": 4})
    got = {(r.table_name, r.check_name): r.failed_records for r in report.collect()}
    assert got["orders", "primary_key_uniqueness"] == 2 and got["customers", "primary_key_uniqueness"] == 1
    assert got["orders", "foreign_key_customer_id_to_customers"] == 2 and got["orders", "foreign_key_product_id_to_products"] == 2
    assert got["orders", "minimum_row_count"] == 1 and got["customers", "minimum_row_count"] == 0
    assert got["orders", "range_quantity"] == 2
    text = plan(report)
    assert "filter(array" not in text and "cast(customer_id" not in text


def test_wide_indicators_are_made_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(N, "MANY_COLUMNS", 3)
    df = spark.createDataFrame([(i, f"v{i % 5}", "x" if i % 2 else None) for i in range(40)], "id int, a string, b string").coalesce(1)
    wide = N.one_hot(df, ["a"], keep_source=False)
    assert wide.rdd.getNumPartitions() > 1  # the one file's rows are dealt out before they are widened
    assert N.one_hot(df, ["b"]).rdd.getNumPartitions() == 1
    got = {r.id: [r[f"a_v{k}"] for k in range(5)] for r in wide.collect()}
    assert got == {i: [float(k == i % 5) for k in range(5)] for i in range(40)}


def test_correlations_of_many_columns_in_one_pass(spark, monkeypatch):
    from halyard.operators import describe

    draw = random.Random(5)
    names = [f"c{i}" for i in range(8)]
    table = [[None if draw.random() < 0.2 else 1e6 + draw.gauss(0, 1) * (i + 1) for i in range(8)] for _ in range(300)]
    for row in table:
        row[1] = None if row[0] is None else 3.0 - 2.0 * row[0]
        row[2] = None  # never present
    table[7][3], table[7][4] = float("nan"), 1.0
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in names)).repartition(5)
    monkeypatch.setattr(describe, "MOMENT_ROWS", 16)
    found = correlation_pairs(df)
    assert "corr(" not in plan(found)  # hundreds of aggregates in one row are neither compiled nor fast
    got = {(r.column_a, r.column_b): r.correlation for r in found.collect()}
    want = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in got]).first().asDict()
    assert len(got) == 28
    for (a, b), value in got.items():
        assert value == pytest.approx(want[f"{a}|{b}"], abs=1e-9, nan_ok=True), (a, b)
    assert [r.correlation for r in correlation_pairs(df.limit(0)).collect()] == [None] * 28


def test_describe_mixed_columns(sample):
    got = {r.column_name: r for r in describe_all(sample).collect()}
    assert (got["value"].q50, got["value"].min, got["value"].max) == (30.0, 10.0, 50.0)
    assert tuple(got["category"])[1:5] == (4, 3, "A", 2)
    assert got["target"]["count"] == 4


def test_grid_and_suffix_joins(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b")], "product_id int, category string")
    sales = spark.createDataFrame([(1, "m1", 5), (1, "m2", 6)], "product_id int, month string, n int")
    months = J.distinct_list(sales, "month")
    grid = J.complete_grid(J.dense_grid(products, months, "month"), sales, ["product_id", "month"], {"n": 0})
    assert sorted((r.product_id, r.month, r.n) for r in grid.collect()) == [(1, "m1", 5), (1, "m2", 6), (2, "m1", 0), (2, "m2", 0)]
    left = spark.createDataFrame([(1, "x")], "product_id int, category string")
    assert J.with_suffix(left, products, "product_id", "_product").columns == ["product_id", "category", "category_product"]
    assert rows(left.select(J.lookup("category", {"y": 1}, -1))) == [(-1,)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert rows(R.histogram(df, "v", 4)) == [(0, 2, 2.0)]


def test_customer_without_orders_gets_defaults(spark):
    customers = spark.createDataFrame([(1,), (2,)], "customer_id int")
    orders = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 10.0, 0.1, 3, "Completed"), (1, dt.datetime(2024, 1, 11), 20.0, 0.0, 5, "Cancelled")],
        "customer_id int, order_date timestamp_ntz, order_amount double, discount_rate double, shipping_days int, order_status string",
    )
    got = {r.customer_id: r for r in R.with_customer_orders(customers, orders).collect()}
    assert (got[2].total_orders, got[2].recency_days, got[2].completion_rate) == (0, 999, 0.0)
    assert (got[1].average_order_value, got[1].recency_days, got[1].cancellation_rate) == (15.0, 0, 0.5)


def test_risk_rules(spark):
    finance = spark.createDataFrame([(1.5, 1e5, 1e5), (1.0, 1e4, 2e5), (2.0, 2e5, 5e4)], "dscr double, cash_balance double, debt_balance double")
    assert [r[0] for r in rows(finance.select(Z.financial_risk()))] == [0, 2, 0]
    stock = spark.createDataFrame([(0.1, 0.2), (0.8, 0.9), (0.4, 0.4), (None, None)], "stockout_risk double, inventory_utilization double")
    assert [r[0] for r in rows(stock.select(Z.operational_risk()))] == [0, 2, 1, 0]
    people = spark.createDataFrame([(20, 30), (80, 200), (50, 100)], "churn_risk_score int, recency_days int")
    assert [r[0] for r in rows(people.select(Z.customer_risk()))] == [0, 2, 1]


def test_risk_scores_with_a_missing_class(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.7],), ([0.5, 0.5],)], "p array<double>")
    got = rows(Z.risk_scores(df, "p").drop("p"))
    assert got == [(80.0, "High", 0.7), (25.0, "Low", 0.5)]


def test_metrics_with_no_positive_prediction(spark):
    df = spark.createDataFrame([(1, 0, 0.4), (0, 0, 0.1)], "label int, predicted int, score double")
    row = Z.classification_metrics(df, "label", "predicted", "score").first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.roc_auc) == (0.5, 0.0, 0.0, 0.0, 1.0)
    cells = {(r.actual, r.predicted): r.n for r in Z.confusion(df, "label", "predicted").collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_personas_number_repeats(spark):
    names = "annual_revenue_standard_scaled double, total_revenue_standard_scaled double, customer_activity_score_standard_scaled double"
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 1.0), (2, 0.1, 0.0, 0.0), (3, 0.0, 0.5, -0.5)], f"cluster_id int, {names}")
    got = {r.cluster_id: r.persona for r in Z.personas(df).collect()}
    assert got == {0: "Stable Mid-Market", 1: "Enterprise Champions", 2: "Stable Mid-Market (Group 3)", 3: "At-Risk High-Value"}


def drift_frames(spark, shift=0.0):
    ref = [(v, "a" if i % 2 else "b") for i, v in enumerate([10.0, 11.0, 12.0, 10.5, 9.5] * 8)]
    inc = [(v + shift, s) for v, s in ref]
    schema = "value double, segment string"
    return spark.createDataFrame(ref, schema), spark.createDataFrame(inc, schema)


def test_drift_cases(spark):
    ref, same = drift_frames(spark)
    calm = D.drift_report("x", ref, same)
    assert D.drift_summary(calm).first()[1:] == (True, False, 1)
    ref, moved = drift_frames(spark, 70.0)
    report = D.drift_report("x", ref, moved)
    assert D.drift_summary(report).first()[1:] == (True, True, 1)
    assert report.where("check_name = 'range' and flagged").count() == 1
    assert D.mean_deviation(ref, moved, ["value"]).first().drift_detected
    short = D.drift_report("x", ref, same.drop("segment"))
    assert not D.drift_summary(short).first().schema_valid
    new = D.category_check(ref, same.withColumn("segment", F.lit("z")), ["segment"])
    assert rows(new) == [("segment", "z")]


def test_recommendations(spark):
    churn = spark.createDataFrame([("C1", 0.72), ("C2", 0.5)], "customer_id string, churn_probability double")
    needs = spark.createDataFrame([("P1", "Tools", 100.7)], "product_id string, category string, reorder_point double")
    risk = spark.createDataFrame([("P1", 0.85)], "product_id string, stockout_risk double")
    forecast = spark.createDataFrame([("2024-01", 900000.0, 1000000.0)], "forecast_month string, predicted_next_month_revenue double, actual_current_month_revenue double")
    got = A.recommendations([A.churn_advice(churn), A.stockout_advice(needs, risk), A.revenue_advice(forecast)]).collect()
    text = sorted(r.business_insight for r in got)
    assert text == [
        "Customer C1 has a critical churn probability of 72.0%.",
        "Next month revenue is forecasted to drop by 10.0% to $900,000.00.",
        "Product P1 (Tools) has a high stockout risk score of 85.0%.",
    ]
    assert any("order of 100 units for Product P1" in r.recommendation for r in got)
    nothing = A.recommendations([A.churn_advice(churn.limit(0)), A.revenue_advice(forecast.limit(0))]).collect()
    assert [r.priority for r in nothing] == ["Medium"]


def test_calendar_covers_a_leap_year(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 12, 31))], "a date, b date")
    days = G.calendar(G.date_spine(bounds, "a", "b"))
    assert days.count() == 366
    assert G.date_spine(bounds, "a", "b", "month").count() == 12


def test_readers_and_logs(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, folder, "nothing")
    (tmp_path / "t.csv").write_text("id,when_date,name\n1,2024-01-02,a\n2,bad,\n")
    frame = tables.parse_date_columns(tables.read_table(spark, folder, "t", "id int, when_date string, name string"))
    assert rows(frame) == [(1, dt.datetime(2024, 1, 2), "a"), (2, None, None)]
    assert tables.read_with_fallback(spark, [folder + "/x", folder], "t", "id int").count() == 2
    assert tables.read_with_fallback(spark, [folder + "/x"], "t", "id int").count() == 0
    sinks.append_log(frame.select("id"), folder + "/log")
    sinks.append_log(frame.select("id"), folder + "/log")
    assert sinks.read_log(spark, folder + "/log", "id int").count() == 4
    assert sinks.read_log(spark, folder + "/nolog", "id int").count() == 0
    sinks.write_table(frame, folder, "out", ["id"])
    assert set(tables.read_tables(spark, folder, ["out"], views=True)["out"].columns) == {"id", "when_date", "name"}
    assert spark.sql("select count(*) from out").first()[0] == 2
