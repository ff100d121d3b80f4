"""The end-to-end runs on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from halyard.catalog.cleaning import entity_tables
from halyard.catalog.metrics import as_of
from halyard.plans import pipeline as P
from halyard.plans.training import Budget
from halyard.sources.sinks import write_table
from halyard.sources.tables import StarTables


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """The ten tables as files, as they would be delivered."""
    folder = str(tmp_path_factory.mktemp("raw"))
    tables = entity_tables(StarTables(spark, "/root/testdata/sf0.001"))
    return {name: spark.read.parquet(write_table(df, folder, name)) for name, df in tables.items()}


def test_pipeline_then_training(spark, raw, tmp_path):
    folder = str(tmp_path)
    done = P.run_pipeline(raw, folder, as_of())
    cleaned = {r.table_name: r for r in done["cleaning"].collect()}
    assert set(cleaned) == set(raw) and all(r.input_rows == r.output_rows for r in cleaned.values())
    assert done["quality"].first().checked_tables == 10
    failed = {r.check_name for r in done["validation"].where("status = 'fail'").collect()}
    assert {"minimum_row_count", "foreign_key_supplier_id_to_suppliers"} <= failed
    sizes = {r.dataset: r.row_count for r in done["features"].collect()}
    assert sizes["customer_features"] == cleaned["customers"].output_rows
    assert sizes["sales_features"] == cleaned["orders"].output_rows

    out = P.run_training(folder, spark, Budget(trees=3, rounds=2, depth=3, trials=1, folds=2), starts=1)
    assert {r.board for r in out["model_leaderboard"].collect()} == {"regression", "classification"}
    assert out["model_leaderboard"].count() == 7
    assert out["business_recommendations"].count() >= 1
    assert out["churn_drivers"].where(F.col("importance") > 0).count() > 0
    assert out["customer_segments"].count() == cleaned["customers"].output_rows


def test_exploration(raw):
    package = P.explore(raw)
    assert {name: df.limit(1).count() for name, df in package.items()} == dict.fromkeys(package, 1)
    assert package["kpi_summary"].count() == 7
