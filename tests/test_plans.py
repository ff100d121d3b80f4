"""What the physical plans must look like, whatever the size of the tables."""

import re

import pytest

from halyard.catalog import QUERIES, load_all
from tests.checking import plan

FOLDER = "/root/testdata/sf0.001"
load_all()
@pytest.fixture
def nothing_small(spark):
    """As if no table fitted a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(text: str, key: str) -> int:
    return len(re.findall(rf"Exchange hashpartitioning\({key}#", text))


def test_customer_window_and_join_share_a_shuffle(nothing_small):
    text = plan(QUERIES["e16_sales_features"](nothing_small, FOLDER))
    assert shuffles(text, "customer_id") == 2  # the lines once, the customers once


def test_wide_lines_are_not_shuffled_by_product(nothing_small):
    text = plan(QUERIES["e16_sales_features"](nothing_small, FOLDER))
    assert shuffles(text, "product_id") == shuffles(text, "l_partkey") == shuffles(text, "p_partkey") == 0


def test_grid_is_never_shuffled(nothing_small):
    text = plan(QUERIES["w8_demand_lags_and_rolls"](nothing_small, FOLDER))
    assert len(re.findall(r"Exchange hashpartitioning\(product_id#\d+L?, order_month#", text)) == 1  # sums of the lines


def test_extended_rollup_needs_one_shuffle(nothing_small):
    text = plan(QUERIES["a2_customer_order_rollup_extended"](nothing_small, FOLDER))
    assert shuffles(text, "customer_id") == 1


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["a5_region_segment_summary"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in text
    kept = plan(QUERIES["p5_threshold_filter"](spark, FOLDER))
    assert "GreaterThan(l_discount,0.05)" in kept


def test_top_k_keeps_k_rows_per_partition(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["t2_top_products"](spark, FOLDER))


def test_all_rules_read_each_table_once(nothing_small, tmp_path):
    from halyard.catalog.tables import entity_tables
    from halyard.operators.quality import validate
    from halyard.sources.sinks import write_table
    from halyard.sources.tables import StarTables

    spark, folder = nothing_small, str(tmp_path)
    tables = {n: spark.read.parquet(write_table(df, folder, n)) for n, df in entity_tables(StarTables(spark, FOLDER)).items()}
    text = plan(validate(tables))
    scans = re.findall(rf"FileScan parquet .*?Location: .*?/(\w+)\.parquet", text)
    assert len(re.findall("FileScan", text)) == len(tables) and len(set(scans)) == len(scans)
    assert len(re.findall(r"Exchange hashpartitioning\(rule#\d+, key#\d+", text)) == 1  # all keys of all tables
