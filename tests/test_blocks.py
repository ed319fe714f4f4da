"""Block windows must equal plain windows whatever the block size."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import views
from panelwright.operators.rolling import ewm_mean, rsi
from panelwright.plans.blocks import Feature, _placed_cells, fit_cells, over_blocks, with_position
from panelwright.spec import PanelSpec

CUTS = [(60, 30, 50), (3600, 1, 3), (60, 1, 1), (86400, 7, 10_000)]


def source(spark, sf):
    hot = F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("event_type"))
    return views.table(spark, sf, "events").select(
        hot.alias("g"), "ts", "event_id", F.when(F.col("event_id") % 7 > 2, F.col("value")).alias("v")
    )


def feature():
    return Feature(
        lambda d, w: d.withColumns(
            {
                "total": F.round(F.sum("v").over(w.ordered.rowsBetween(-9, 0)), 6),
                "ahead": F.lead("v", 3).over(w.ordered),
                "last": w.last_value("v"),
                "next": w.next_value("v"),
                "first": w.first_value("v"),
            }
        ),
        before=9,
        after=3,
        carry_last=("v",),
        carry_next=("v",),
        carry_first=("v",),
    )


@pytest.mark.parametrize("step,cell_steps,block_rows", CUTS)
@pytest.mark.parametrize("counted", [False, True])
def test_equal_to_plain_windows(spark, sf, step, cell_steps, block_rows, counted):
    df = source(spark, sf)
    spec = PanelSpec("ts", ("g",), ("event_id",), step=step, cell_steps=cell_steps, block_rows=block_rows)
    f = feature()
    cells = fit_cells(df, spec, [f]) if counted else None
    got = over_blocks(df, spec, f, cells=cells, keep_position=True)
    w = Window.partitionBy("g").orderBy("ts", "event_id")
    every = Window.unboundedPreceding, Window.unboundedFollowing
    want = df.withColumns(
        {
            "total": F.round(F.sum("v").over(w.rowsBetween(-9, 0)), 6),
            "ahead": F.lead("v", 3).over(w),
            "last": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "first": F.first("v").over(w.rowsBetween(*every)),
            "_pos": F.row_number().over(w).cast("long"),
            "_group_rows": F.count(F.lit(1)).over(Window.partitionBy("g")),
        }
    )
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = got.select(cols), want.select(cols)
    assert a.count() == df.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_blocks_bound_the_rows_of_a_task(spark, sf):
    """A group holding a third of the rows is cut; no block exceeds its size by more than the
    context and one cell on either side."""
    df = source(spark, sf)
    spec = PanelSpec("ts", ("g",), ("event_id",), step=3600, cell_steps=4, block_rows=40)
    marks = Feature(
        lambda d, w: d.withColumn("in_block", F.count(F.lit(1)).over(Window.partitionBy(*w.partition))), before=5
    )
    out = over_blocks(df, spec, marks, keep_position=True)
    widest_cell = df.groupBy("g", F.window("ts", "4 hours")).count().agg(F.max("count")).first()[0]
    most = out.agg(F.max("in_block"), F.max("_group_rows")).first()
    assert most[0] <= 40 + 5 + 2 * widest_cell < most[1]


def test_null_group_and_time_are_kept(spark):
    data = [(None, 1, 1.0), (None, 2, 2.0), ("a", None, 3.0), ("a", 5, 4.0)]
    df = spark.createDataFrame(data, "g string, k int, v double")
    out = with_position(df, PanelSpec("k", ("g",), step=1, cell_steps=1, block_rows=1))
    got = {(r.g, r.k): (r._pos, r._group_rows) for r in out.collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), ("a", None): (1, 2), ("a", 5): (2, 2)}


def test_panel_without_groups(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(days=i), float(i)) for i in range(50)], "t timestamp_ntz, v double")
    spec = PanelSpec("t", step=86400, cell_steps=3, block_rows=7)
    out = over_blocks(df, spec, Feature(lambda d, w: d.withColumn("p", F.lag("v", 2).over(w.ordered)), before=2))
    assert {r.v: r.p for r in out.collect()} == {float(i): (float(i - 2) if i > 1 else None) for i in range(50)}


def test_tail_keeps_positions(spark, sf):
    df = source(spark, sf)
    spec = PanelSpec("ts", ("g",), ("event_id",), step=3600, cell_steps=5, block_rows=20)
    full = with_position(df, spec).filter("_pos > _group_rows - 7")
    tail = over_blocks(df, spec, keep_position=True, tail=7).filter("_pos > _group_rows - 7")
    assert full.exceptAll(tail).isEmpty() and tail.exceptAll(full).isEmpty()


@pytest.mark.parametrize("block_rows", [37, 100_000])
@pytest.mark.parametrize("span", [1, 2, 14, 50])
def test_recursive_mean_equals_pandas(spark, sf, block_rows, span):
    df = views.bars(spark, sf)
    spec = PanelSpec("ts", ("event_type",), step=3600, cell_steps=10, block_rows=block_rows)
    got = over_blocks(df, spec, ewm_mean("close", span, min_periods=span)).toPandas().sort_values(["event_type", "ts"])
    want = got.groupby("event_type")["close"].transform(lambda s: s.ewm(span=span, min_periods=span, adjust=False).mean())
    assert got[f"close_ewm_{span}"].isna().equals(want.isna())
    assert (got[f"close_ewm_{span}"] - want).abs().max() < 1e-10


@pytest.mark.parametrize("block_rows", [53, 100_000])
def test_rsi_equals_pandas(spark, sf, block_rows):
    spec = PanelSpec("ts", ("event_type",), step=3600, cell_steps=10, block_rows=block_rows)
    got = over_blocks(views.bars(spark, sf), spec, rsi("close", 14)).toPandas().sort_values(["event_type", "ts"])

    def one(p):
        step = p.diff()
        up = step.clip(lower=0).fillna(0).ewm(span=14, min_periods=14, adjust=False).mean()
        down = (-step).clip(lower=0).fillna(0).ewm(span=14, min_periods=14, adjust=False).mean()
        return (100 - 100 / (1 + up / down)).fillna(100)

    want = got.groupby("event_type")["close"].transform(one)
    assert (got["rsi_14"] - want).abs().max() < 1e-9


def test_recursive_mean_refuses_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None)], "g string, k int, v double")
    with pytest.raises(Exception, match="non-null"):
        over_blocks(df, PanelSpec("k", ("g",), step=1), ewm_mean("v", 3)).collect()


def test_counted_cells_give_one_shuffle_of_the_panel(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    spec = PanelSpec("ts", ("event_type",), ("event_id",), step=60, count_first=True)
    f = Feature(lambda d, w: d.withColumn("p", F.lag("value").over(w.ordered)), before=1)
    plan = over_blocks(df, spec, f)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BatchEvalPython" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # panel rows, and the small cell table


def test_dense_cells_are_narrowed(spark, sf):
    """The spec expects a row a day, the data has hundreds: counting first notices."""
    df = source(spark, sf)
    spec = PanelSpec("ts", ("g",), ("event_id",), step=3600, cell_steps=24 * 365, block_rows=30, count_first=True)
    cells = fit_cells(df, spec)
    assert cells.width < 24 * 30 * 3600 * 10**6 and cells.table.agg(F.max("_rows")).first()[0] <= 30
    got = with_position(df, spec)
    w = Window.partitionBy("g").orderBy("ts", "event_id")
    want = df.withColumn("_pos", F.row_number().over(w).cast("long"))
    cols = want.columns
    assert got.select(cols).exceptAll(want).isEmpty() and got.count() == df.count()


def blocks_of(df, spec, cells):
    """Rows of every block (a block is one task's work)."""
    placed = _placed_cells(cells, spec, 0, 0)
    home = F.floor(F.col("_cell_start") / spec.block_rows)
    return [r["rows"] for r in placed.groupBy(*spec.groups, home).agg(F.sum("_rows").alias("rows")).collect()]


@pytest.mark.parametrize("spacing,tie", [("60000000", ()), ("50", ()), ("0", ("n",)), ("null", ("n",))])
def test_a_bare_spec_divides_a_group_however_dense(spark, spacing, tie):
    """Minute rows, 20,000 rows within a second, at one moment, and without a time."""
    n, size = 20_000, 500
    df = spark.range(n).selectExpr(
        "'a' AS g", "id AS n", f"CAST(timestamp_micros(1700000000000000 + id * {spacing}) AS TIMESTAMP_NTZ) AS ts", "CAST(id % 7 AS DOUBLE) AS v"
    )
    spec = PanelSpec("ts", ("g",), tie, block_rows=size)
    cells = fit_cells(df, spec)
    assert max(blocks_of(df, spec, cells)) <= 2 * size
    feature = Feature(lambda d, w: d.withColumn("s", F.sum("v").over(w.trailing(3))), before=2)
    out = over_blocks(df, spec, feature, keep_position=True)
    assert out.filter("_pos <> n + 1 OR s <> v + if(n > 0, (n - 1) % 7, 0) + if(n > 1, (n - 2) % 7, 0)").count() == 0 and out.count() == n
