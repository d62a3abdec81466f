"""Plans: what reaches the scan, what is shuffled, what is broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from joulemill.operators.ordered import top_per_key
from joulemill.registry import load
from joulemill.sources.queries import bucketed
from joulemill.storage import checked_broadcast, shared_root
from joulemill.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(load()["tpch_06_revenue_forecast"](spark, folder))
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", text) and "LessThan(l_quantity,24.0)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" in schema and "l_partkey" not in schema and "l_tax" not in schema


def test_carbon_join_broadcasts_the_checked_trace(spark, folder):
    text = plan(load()["co_16_carbon_per_job"](spark, folder))
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_bucketed_join_has_no_exchange(spark, folder):
    o, l = bucketed(Tables(spark, folder))
    text = plan(o.hint("merge").join(l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "l_partkey"))
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_partition_filter_prunes(spark, folder, tmp_path):
    Tables(spark, folder).orders.write.partitionBy("o_orderstatus").parquet(str(tmp_path / "p"))
    text = plan(spark.read.parquet(str(tmp_path / "p")).filter("o_orderstatus = 'F'"))
    assert re.search(r"PartitionFilters: \[[^\]]*o_orderstatus", text)


def test_top_per_key_limits_before_the_shuffle(spark, folder):
    text = plan(top_per_key(Tables(spark, folder).orders, ["o_custkey"], [F.desc("o_totalprice")], 3))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", text)


def test_broadcast_only_under_the_bound(spark):
    small, big = spark.range(10), spark.range(1000)
    assert checked_broadcast(small, 100) is not small
    assert checked_broadcast(big, 100) is big


def test_shared_root_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", ["tpch_03_shipping_priority", "tpch_18_large_volume_customers", "srt_04_offset"])
def test_limits_are_top_k(spark, folder, name):
    assert "TakeOrderedAndProject" in plan(load()[name](spark, folder)) or name == "srt_04_offset"
