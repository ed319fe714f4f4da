import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.operators import evaluate as ev
from panelwright.sources.bucketed import read_bucketed, write_bucketed, write_forecasts
from panelwright.spec import PanelSpec

D0 = dt.datetime(2024, 1, 1)
SPEC = PanelSpec("date", ("symbol",))


def forecasts(spark, n, value, step=1):
    rows = [(s, D0 + dt.timedelta(days=i), "close", h, float(i * h)) for s in ("A", "B", None) for i in range(0, n, step) for h in (1, 2)]
    return spark.createDataFrame(rows, f"symbol string, date timestamp_ntz, target string, horizon int, {value} double").repartition(5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_join_without_moving_rows(spark, tmp_path):
    predicted, actual = forecasts(spark, 40, "prediction", 3), forecasts(spark, 50, "actual")
    for df, name in ((predicted, "p"), (actual, "a")):
        write_forecasts(df, str(tmp_path / name), SPEC, 6)
    p, a = (read_bucketed(spark, str(tmp_path / n)) for n in ("p", "a"))
    assert sorted(p.collect(), key=str) == sorted(predicted.collect(), key=str)
    want = ev.align(predicted, actual, SPEC)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ev.align(p, a, SPEC)
        assert "Exchange" not in plan(out) and "SelectedBucketsCount: 6 out of 6" in plan(out)
        assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty() and out.count() == 2 * 14 * 2
        assert "Exchange" in plan(want)
        # metrics per group need one exchange at most after that, of aggregated rows
        assert "Exchange" not in plan(out.groupBy("symbol", "date", "target", "horizon").agg(F.max("actual")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_table_is_replaced_and_stays_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (10, 3):
        write_bucketed(spark.range(n), path, ["id"], 2)
    assert read_bucketed(spark, path).count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name == "t"]


def test_empty_and_wrong_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    write_bucketed(spark.range(0), path, ["id"], 4)
    assert read_bucketed(spark, path).count() == 0
    with pytest.raises(ValueError, match="missing"):
        write_bucketed(spark.range(1), path, ["no"], 4)
    with pytest.raises(ValueError, match="bucket"):
        write_bucketed(spark.range(1), path, ["id"], 0)
