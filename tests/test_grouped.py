import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators.grouped import apply_by_group, block_function
from panelwright.plans.blocks import over_blocks
from panelwright.spec import PanelSpec

D0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    data = [(s, D0 + dt.timedelta(hours=i), i % 3, float(rng.normal())) for s, n in (("A", 200), ("B", 7), (None, 30)) for i in range(n)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, kind int, x double").repartition(5)


def _local():
    def smooth(rows):
        return pd.DataFrame({"low": rows["x"].rolling(6, min_periods=1).min(), "ahead": rows["x"].shift(-2)})

    return smooth


smooth = _local()  # workers cannot import this module

RETURNS = "low double, ahead double"


@pytest.mark.parametrize("block_rows", [1, 13, 10_000])
def test_equals_whole_groups(spark, panel, block_rows):
    spec = PanelSpec("ts", ("symbol",), cell_steps=4, step=3600, block_rows=block_rows)
    got = apply_by_group(panel, spec, smooth, RETURNS, ["x"], before=5, after=2)
    want = {}
    for s, part in panel.toPandas().groupby("symbol", dropna=False):
        part = part.sort_values("ts").reset_index(drop=True)
        for t, low, ahead in zip(part.ts, *smooth(part).to_numpy().T):
            want[None if pd.isna(s) else s, t.to_pydatetime()] = (low, None if np.isnan(ahead) else ahead)
    assert {(r.symbol, r.ts): (r.low, r.ahead) for r in got.collect()} == want
    assert got.columns == [*panel.columns, "low", "ahead"]


def test_no_group_meets_in_one_task(panel):
    seen = panel.sparkSession.sparkContext.accumulator(0)

    def count(rows):
        seen.add(1)
        assert len(rows) <= 20 + (5 + 2) + 4 * 4  # a block and its context, in whole cells
        return smooth(rows)

    spec = PanelSpec("ts", ("symbol",), cell_steps=4, step=3600, block_rows=20)
    out = apply_by_group(panel, spec, count, RETURNS, ["x"], before=5, after=2)
    assert out.count() == 237
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow [symbol" in plan and "_block" in plan.split("FlatMapGroupsInArrow")[1].split("]")[0]
    out.collect()
    assert seen.value >= 12


def test_types_nulls_and_several_functions(spark, panel):
    def kinds(rows):
        return pd.DataFrame({"name": rows["kind"].map({0: "zero", 1: None, 2: "two"}), "day": rows["ts"].dt.floor("D"), "n": rows["kind"].astype("Int64").where(rows["kind"] > 0)})

    spec = PanelSpec("ts", ("symbol",), block_rows=11)
    one, two = block_function(kinds, "name string, day timestamp_ntz, n long", ["ts", "kind"]), block_function(smooth, RETURNS, ["x"], 5, 2)
    out = over_blocks(panel, spec, one, two)
    assert out.filter("name <=> CASE kind WHEN 0 THEN 'zero' WHEN 2 THEN 'two' END AND n <=> nullif(kind, 0)").count() == 237
    assert out.filter(F.col("day") != F.date_trunc("day", "ts").cast("timestamp_ntz")).isEmpty()
    plain = over_blocks(panel, spec, two).select("symbol", "ts", "low", "ahead")
    assert plain.exceptAll(out.select("symbol", "ts", "low", "ahead")).isEmpty()


@pytest.mark.parametrize("bad", [lambda r: r[["x"]], lambda r: smooth(r).iloc[1:]])
def test_wrong_results_are_named(panel, bad):
    with pytest.raises(Exception, match="must return"):
        apply_by_group(panel, PanelSpec("ts", ("symbol",)), bad, RETURNS, ["x"]).collect()


def test_names_are_checked(panel):
    with pytest.raises(ValueError, match="already has"):
        apply_by_group(panel, PanelSpec("ts", ("symbol",)), smooth, "x double", ["x"])
    with pytest.raises(ValueError, match="missing"):
        apply_by_group(panel, PanelSpec("ts", ("symbol",)), smooth, RETURNS, ["y"])


def test_empty_panel(spark, panel):
    assert apply_by_group(panel.limit(0), PanelSpec("ts", ("symbol",)), smooth, RETURNS, ["x"]).count() == 0
