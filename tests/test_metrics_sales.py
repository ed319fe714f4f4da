import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.functions import arithmetic, calendar
from panelwright.operators import evaluate as ev
from panelwright.operators import sales
from panelwright.spec import PanelSpec

D0 = dt.datetime(2015, 1, 1)


def vectors(spark, actual, predicted):
    data = [("s", "y", 1, i, float(a), float(p)) for i, (a, p) in enumerate(zip(actual, predicted))]
    return spark.createDataFrame(data, "g string, target string, horizon int, t int, actual double, prediction double")


def test_sales_metrics_vector(spark):
    df = vectors(spark, [100, 200, 300, 0, 500], [110, 190, 310, 50, 480])
    r = df.agg(*ev.sales_metrics()).first()
    assert r.RMSPE == pytest.approx(0.061667, abs=1e-6) and r.MAE == 20.0


def test_all_zero_actuals(spark):
    df = vectors(spark, [0, 0], [1, 2])
    r = df.agg(*ev.sales_metrics()).first()
    assert (r.RMSPE, r.MAPE) == (0.0, 0.0)
    m = ev.regression_metrics(df).first()
    assert m.MAPE is None and m.R2 == float("-inf")
    assert ev.regression_metrics(vectors(spark, [0, 0], [0, 0])).first().R2 == 0.0


def test_no_rows_no_metrics(spark):
    r = ev.regression_metrics(vectors(spark, [], [])).first()
    assert all(v is None for v in r)


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(5)
    a, p = rng.normal(10, 3, 80), rng.normal(10, 3, 80)
    spec = PanelSpec("t", ("g",), step=1, cell_steps=4, block_rows=9)
    r = ev.regression_metrics(ev.with_direction(vectors(spark, a, p), spec)).first()
    hit = np.mean((np.diff(a) > 0) == (np.diff(p) > 0)) * 100
    want = [np.mean(abs(a - p)), np.mean((a - p) ** 2), np.sqrt(np.mean((a - p) ** 2)), np.mean(abs((a - p) / a)) * 100,
            1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum(), hit]
    assert list(r) == pytest.approx(want)


def test_direction_does_not_cross_series(spark):
    df = vectors(spark, [1, 2], [1, 2]).unionByName(vectors(spark, [9, 1], [1, 9]).withColumn("g", F.lit("z")))
    out = rows(ev.with_direction(df, PanelSpec("t", ("g",), step=1)), "g", "t")
    assert [r["direction_hit"] for r in out] == [None, 1, None, 0]


def test_levels_and_flat_form(spark):
    df = vectors(spark, [1, 2, 3], [1, 2, 4]).unionByName(vectors(spark, [5, 6], [5, 5]).withColumns({"g": F.lit("z"), "horizon": F.lit(2)}))
    wide = ev.metrics_by(ev.with_direction(df, PanelSpec("t", ("g",), step=1)), ["g"])
    levels = {(r.horizon, r.g): r.MAE for r in wide.collect()}
    assert levels[("overall", "overall")] == pytest.approx(0.4)
    assert set(levels) == {("overall", "overall"), ("1", "overall"), ("2", "overall"), ("overall", "s"), ("overall", "z"), ("1", "s"), ("2", "z")}
    flat = ev.flatten_metrics(wide, "test", ["g"])
    assert flat.columns == ["dataset", "group", "target", "horizon", "metric", "value"]
    assert flat.count() == 7 * 6 and {r.horizon for r in flat.collect()} == {"overall", "horizon_1", "horizon_2"}


def test_months_since_rules(spark):
    data = [(2014, 3), (2015, 9), (None, 3), (2014, None), (2014, 13), (2014, 0), (2015, 6)]
    df = spark.createDataFrame([(*d, dt.datetime(2015, 6, 10)) for d in data], "y int, m int, Date timestamp_ntz")
    assert [r[0] for r in df.select(arithmetic.months_since("y", "m", "Date")).collect()] == [15, 0, 999, 17, 999, 999, 0]


def test_promo_month_spelling(spark):
    df = spark.createDataFrame([("Jun,Sept", dt.datetime(2015, 9, 1)), (None, D0), ("Jan,Apr", D0)], "p string, Date timestamp_ntz")
    assert [r[0] for r in df.select(arithmetic.in_promo_month("p", "Date")).collect()] == [0, 0, 1]
    assert [r[0] for r in df.select(arithmetic.in_promo_month("p", "Date", {"Sept": "Sep"})).collect()] == [1, 0, 1]


def test_division_like_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(arithmetic.divide("a", "b")).collect()] == [math.inf, -math.inf, None, 2.0, None]


def test_train_and_test_get_the_same_columns(spark):
    train = spark.createDataFrame(
        [(1, D0, 5, 100.0, 10, 1, 1, "0", 1), (1, D0 + dt.timedelta(1), 6, 0.0, 0, 0, 0, "a", 0), (2, D0, 5, 50.0, 0, 1, 0, "0", 0)],
        "Store int, Date timestamp_ntz, DayOfWeek int, Sales double, Customers int, Open int, Promo int, StateHoliday string, SchoolHoliday int",
    )
    store = spark.createDataFrame(
        [(1, "a", "c", 100, 9, 2008, 1, 13.0, 2010.0, "Jan,Apr,Jul,Oct"), (2, "d", "a", None, None, None, 0, None, None, None)],
        "Store int, StoreType string, Assortment string, CompetitionDistance int, CompetitionOpenSinceMonth int, "
        "CompetitionOpenSinceYear int, Promo2 int, Promo2SinceWeek double, Promo2SinceYear double, PromoInterval string",
    )
    fitted = sales.fit_store_preprocess(train, store, store_bytes=200)
    a = fitted.transform(train)
    b = fitted.transform(train.drop("Sales", "Customers").withColumn("StateHoliday", F.lit("zzz")))
    only_train = {"Sales", "Customers", "SalesPerCustomer", "HasCustomerData"}
    assert set(a.columns) - set(b.columns) == only_train
    got = rows(a, "Store", "Date")
    assert len(got) == 2  # the closed day is gone
    assert [r["CompetitionDistance"] for r in got] == [100.0, 100.0]  # median of the training rows
    assert got[0]["MonthsSinceCompetition"] == 76 and got[1]["MonthsSinceCompetition"] == 999
    assert got[0]["MonthsSincePromo2"] == 999 and got[0]["IsPromoMonth"] == 1
    assert got[1]["SalesPerCustomer"] == 50.0 and got[1]["HasCustomerData"] == 0
    assert (got[0]["StoreType_a"], got[0]["StoreType_d"], got[0]["StateHoliday_0"], got[0]["StateHoliday_a"]) == (1, 0, 1, 0)


def test_date_features_depend_on_time_of_day(spark):
    days = spark.createDataFrame([(D0,), (D0 + dt.timedelta(days=2),)], "date timestamp_ntz")
    assert set(calendar.date_features(days, "date").columns) == {"date", "is_weekend"} | {f"{p}_{f}" for p in ("month", "day", "dayofweek") for f in ("sin", "cos")}
    clock = days.select((F.col("date") + F.expr("INTERVAL '1' HOUR")).alias("date"))
    assert {"hour_sin", "minute_cos"} <= set(calendar.date_features(clock, "date").columns)
    assert [r["is_weekend"] for r in rows(calendar.date_features(days, "date"), "date")] == [0, 1]


def test_future_business_days_skip_the_weekend(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 4),)], "date timestamp_ntz")
    for n in (1, 2, 7, 23):
        out = rows(calendar.future_timestamps(df, "date", n, "business_day"), "step")
        assert len(out) == n and all(r["future_ts"].weekday() < 5 for r in out)
    assert out[0]["future_ts"] == dt.datetime(2024, 1, 5) and out[1]["future_ts"] == dt.datetime(2024, 1, 8)


def test_metric_states_add_up(spark):
    """Every level equals its own rows' metrics, also far from zero, with zeros and nulls."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = []
    for s, base in (("A", 1e9), ("B", 1e9 + 50), (None, -3.0), ("D", 0.0)):
        for t in ("x", "y"):
            for h in (1, 2):
                for i in range(30 if s != "D" else 2):
                    a = 0.0 if s == "D" else base + float(rng.normal())
                    data.append((s, t, h, None if i == 7 else a, None if i == 9 else a + float(rng.normal()), None if i == 0 else int(i % 2)))
    df = spark.createDataFrame(data, "symbol string, target string, horizon int, actual double, prediction double, direction_hit int")
    got = ev.metrics_by(df, ["symbol"], rmspe=True)
    assert got.count() == 2 * (1 + 2) * (1 + 4)
    for r in got.collect():
        own = df.filter(F.col("target") == r.target)
        own = own if r.horizon == "overall" else own.filter(F.col("horizon") == int(r.horizon))
        own = own if r.symbol == "overall" else own.filter(F.col("symbol").eqNullSafe(F.lit(r.symbol).cast("string")))
        want = own.agg(*ev.regression_aggregates(), ev.rmspe("actual", "prediction").alias("RMSPE")).first()
        for m in (*ev.METRICS, "RMSPE"):
            # the squared deviations of values near 10^9 have nine digits less
            assert r[m] == (want[m] and pytest.approx(want[m], rel=1e-6 if m == "R2" else 1e-9)), (r, m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
