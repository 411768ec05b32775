"""Plans keep what scale needs: early filters, narrow scans, partial aggregates, no row-at-a-time Python."""

import os

import pytest
from pyspark.sql import functions as F

from priceloom import catalog
from priceloom.catalog.mart import table
from priceloom.operators import consolidate as M
from priceloom.operators import ranking as R

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_check_has_a_query():
    catalog.load_all()
    assert set(catalog.CHECKS) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 125


def test_every_check_is_sql_text():
    from __spark_entry__ import oracle_sql

    found = oracle_sql()
    assert [name for name, sql in found.items() if not isinstance(sql, str)] == []


@needs_data
@pytest.mark.parametrize("name", ["client_elasticity", "map_values", "scenario_expand", "build_feature_rows", "price_bounds_iqr", "quote_confidence"])
def test_no_row_at_a_time_python(spark, name):
    catalog.load_all()
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    for word in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    kept = M.filter_not_split(table(spark, SF, "lineitem").withColumnRenamed("l_linenumber", "split")).select("l_orderkey")
    plan = plan_of(kept)
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


@needs_data
def test_anti_join_and_samples(spark):
    orders = table(spark, SF, "orders").withColumnRenamed("o_orderkey", "order_id")
    kits = orders.select("order_id", F.lit(1).alias("active"))
    assert "LeftAnti" in plan_of(M.join_not_exists_kits(orders, kits))
    assert "TakeOrderedAndProject" in plan_of(R.seeded_sample(orders, F.col("order_id").cast("string"), 10))


@needs_data
def test_top_rows_are_limited_before_the_shuffle(spark):
    versions = table(spark, SF, "orders").select(F.col("o_orderpriority").alias("model_name"), F.col("o_orderkey").alias("version"))
    assert "WindowGroupLimit" in plan_of(R.latest_version(versions))
