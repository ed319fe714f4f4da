"""Shapes of physical plans that matter at scale."""

import pytest

from panelwright import catalog
from panelwright.catalog import views
from panelwright.operators import rolling
from panelwright.plans.blocks import fit_cells, over_blocks
from panelwright.spec import PanelSpec


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_shuffle_once_after_partial_aggregation(spark, sf):
    p = plan(catalog.queries()["d1_resample_ohlcv_1h"](spark, sf))
    assert p.count("Exchange") == 1 and "partial_max" in p


def test_bars_without_ties_need_no_sort(spark, sf):
    from panelwright.operators.resample import resample_ohlcv

    p = plan(resample_ohlcv(views.ticks(spark, sf), "1h", PanelSpec("ts", ("event_type",))))
    assert "HashAggregate" in p and "Sort" not in p


def test_indicators_share_one_shuffle(spark, sf):
    bars = views.bars(spark, sf).cache()
    cells = fit_cells(bars, views.BAR)
    p = plan(over_blocks(bars, views.BAR, *rolling.technical_features(), cells=cells))
    rows_side = p.split("InMemoryTableScan")[0]
    assert rows_side.count("Exchange hashpartitioning(event_type") == 1
    bars.unpersist()


@pytest.mark.parametrize("name", ["b4_filter_rows", "b5_filter_group", "h2_cyclical_features", "h5_promo_month", "h15_error_columns", "e17_scale"])
def test_no_python_in_the_plan(spark, sf, name):
    p = plan(catalog.queries()[name](spark, sf))
    assert "Python" not in p and "CartesianProduct" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(catalog.queries()["b5_filter_group"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_linestatus), EqualTo(l_returnflag,A), EqualTo(l_linestatus,F)]" in p
    assert "l_tax" not in p


def test_counted_dimension_is_broadcast(spark, sf):
    from panelwright.operators.sales import merge_store_data

    facts, dim = views.table(spark, sf, "orders").withColumnRenamed("o_custkey", "Store"), views.table(spark, sf, "customer")
    dim = dim.withColumnRenamed("c_custkey", "Store")
    assert "BroadcastHashJoin" in plan(merge_store_data(facts, dim))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(merge_store_data(facts, dim))  # measured, not guessed
        p = plan(merge_store_data(facts, dim, store_bytes=1 << 40))
        assert "Broadcast" not in p and "Generate" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labels_are_broadcast_by_the_size_of_their_own_column(spark, monkeypatch):
    from panelwright.operators import encode
    from panelwright.plans import lookup

    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 10_000)
    df = spark.range(20_000).selectExpr("concat('label ', id) AS many", "concat('kind ', id % 5) AS few")
    labels = encode.fit_labels(df, ["many", "few"])
    assert labels.sizes["few"] < 1000 < 10_000 < labels.sizes["many"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(labels.encode(df))
        assert p.count("BroadcastHashJoin") == 1 and p.count("SortMergeJoin") == 1 and "Generate" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evaluation_joins_no_predictions_to_actuals(spark, sf):
    p = plan(catalog.queries()["i8_evaluate"](spark, sf))
    assert "SortMergeJoin" not in p
