"""The physical plans are the ones wanted: pushed filters, pruned columns, few exchanges, no row-wise Python."""

import re

import pytest

import __spark_entry__ as entry
import keyloom as k
from keyloom.plans import table_queries

D = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["filter_select"](spark, D))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    assert "LessThanOrEqual(l_shipdate" in pushed and "GreaterThan(l_quantity" in pushed
    assert read_schemas(text) and all("l_partkey" not in s and "l_tax" not in s for s in read_schemas(text))
    assert "Exchange" not in text


def test_grouping_combines_before_its_one_exchange(spark):
    text = plan(entry.queries()["groupreduce_multi"](spark, D))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2


def test_key_order_saves_the_exchange(spark):
    t = k.table({"x": [1, 2, 2], "y": [1, 2, 3]}, keys=["x"]).rechunk("x")
    assert plan(t.groupby("mean", "x", "y").df).count("Exchange") == 1


def test_top_of_groups_is_cut_before_the_shuffle(spark):
    text = plan(entry.queries()["window_topk"](spark, D))
    assert text.count("WindowGroupLimit") == 2


def test_top_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["sort_topn"](spark, D))


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_no_cross_join_and_no_row_wise_python(spark, name):
    text = plan(entry.queries()[name](spark, D))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["asof_numbers", "lag_without_groups", "row_numbers"])
def test_ordered_operators_need_no_single_task(spark, name):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, D))


def test_lines_are_parsed_inside_the_scan(spark):
    text = plan(entry.queries()["p3_found"](spark, D))
    assert "Exchange" not in text and "MapInArrow" in text


def test_broadcasts_are_checked(spark):
    from keyloom.session import guarded_broadcast

    assert "ResolvedHint (strategy=broadcast)" in guarded_broadcast(spark.range(5), 120)._jdf.queryExecution().analyzed().toString()
    assert "Hint" not in guarded_broadcast(spark.range(6), 120)._jdf.queryExecution().analyzed().toString()
