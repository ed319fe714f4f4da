import datetime as dt

import pytest

from conftest import rows
from panelwright.operators import clean
from panelwright.operators.resample import resample_ohlcv
from panelwright.spec import PanelSpec, detect_time_column, market, require_columns, timeframe

DAY = PanelSpec("date", ("symbol",))
D0 = dt.datetime(2023, 1, 2)


def test_daily_bad_prices_take_the_last_good_one_of_their_group(spark):
    data = [("A", D0 + dt.timedelta(days=i), float(c)) for i, c in enumerate([-50, 10, 0, 12])]
    data += [("B", D0 + dt.timedelta(days=i), float(c)) for i, c in enumerate([5, -1, -1, 7])]
    out = rows(clean.clean_ohlc_daily(spark.createDataFrame(data, "symbol string, date timestamp_ntz, close double"), DAY), "symbol", "date")
    assert [r["close"] for r in out] == [None, 10, 10, 12, 5, 5, 5, 7]


def test_daily_swaps_crossed_range_and_zeroes_negative_volume(spark):
    df = spark.createDataFrame([("A", D0, 8.0, 9.0, -3)], "symbol string, date timestamp_ntz, high double, low double, volume long")
    r = clean.clean_ohlc_daily(df, DAY).first()
    assert (r.high, r.low, r.volume) == (9.0, 8.0, 0)


def test_minute_bar_with_crossed_range_is_dropped(spark):
    schema = "timestamp timestamp_ntz, open double, high double, low double, close double, volume long"
    good, bad = (D0, 10.0, 11.0, 9.0, 10.5, 5), (D0 + dt.timedelta(minutes=1), 10.0, 8.0, 9.0, 10.5, 5)
    df = spark.createDataFrame([good, bad, good], schema)
    spec = PanelSpec("timestamp", step=60)
    assert clean.clean_ohlc_intraday(df, spec).count() == 1
    assert clean.fault_report(df).first().asDict()["bad_range"] == 1


@pytest.mark.parametrize("country,hours", [("US", range(10, 16)), ("INDIA", range(10, 16)), ("CRYPTO", range(8, 19))])
def test_market_hours_on_full_hours(spark, country, hours):
    data = [(dt.datetime(2023, 1, 1, h),) for h in range(8, 19)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz")
    assert [r["timestamp"].hour for r in rows(clean.filter_market_hours(df, "timestamp", country), "timestamp")] == list(hours)


def test_market_hours_borders_and_conversion(spark):
    data = [(dt.datetime(2023, 1, 3, 9, 29),), (dt.datetime(2023, 1, 3, 9, 30),), (dt.datetime(2023, 1, 3, 16, 0),)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz")
    assert [r["timestamp"].minute for r in rows(clean.filter_market_hours(df, "timestamp"), "timestamp")] == [30]
    utc = spark.createDataFrame([(dt.datetime(2023, 1, 3, 14, 30),), (dt.datetime(2023, 1, 3, 13, 0),)], "timestamp timestamp_ntz")
    assert clean.filter_market_hours(utc, "timestamp", "US", convert_from="UTC").count() == 1


def test_unknown_names_are_errors(spark):
    for f in (lambda: market("MARS"), lambda: timeframe("2min")):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), "nope")


def test_filter_composite_group(spark):
    df = spark.createDataFrame(
        [("AAPL", "Tech", 1), ("AAPL", "Finance", 2), ("GOOGL", "Tech", 3), ("GOOGL", "Finance", 4)], "symbol string, sector string, value int"
    )
    assert clean.filter_group(df, symbol="AAPL").count() == 2
    assert [r.value for r in clean.filter_group(df, symbol="GOOGL", sector="Finance").collect()] == [4]


def test_backward_fill_stays_in_its_group(spark):
    data = [("A", 1, None), ("A", 2, 5.0), ("A", 3, None), ("B", 1, None), ("B", 2, 7.0)]
    df = spark.createDataFrame(data, "g string, k int, v double")
    out = rows(clean.fill_backward_zero(df, PanelSpec("k", ("g",), step=1, cell_steps=1, block_rows=1)), "g", "k")
    assert [r["v"] for r in out] == [5.0, 5.0, 0.0, 7.0, 7.0]


def test_dedup_keeps_first_by_tiebreak(spark):
    df = spark.createDataFrame([("A", 1, 9, "late"), ("A", 1, 2, "first"), ("A", 2, 5, "only")], "g string, t int, id int, x string")
    out = rows(clean.dedup_bars(df, PanelSpec("t", ("g",), ("id",))), "t")
    assert [r["x"] for r in out] == ["first", "only"]


def test_limit_groups_applies_to_all_frames(spark):
    a = spark.createDataFrame([(3,), (1,), (2,), (1,)], "Store int")
    b = spark.createDataFrame([(1,), (3,), (9,)], "Store int")
    x, y = clean.limit_groups(a, "Store", 2, b)
    assert sorted(r.Store for r in x.collect()) == [1, 1, 2] and [r.Store for r in y.collect()] == [1]


def test_time_column_is_found_by_name():
    assert detect_time_column(["close", "Date", "date"]) == "date"
    assert detect_time_column(["close"]) is None


def test_bars_skip_nulls_and_empty_bars(spark):
    t = dt.datetime(2024, 1, 1, 9)
    data = [
        ("A", t, 1, None, 5.0, 4.0, 4.5, 1),
        ("A", t + dt.timedelta(minutes=1), 2, 4.2, 6.0, 4.0, None, 2),
        ("A", t + dt.timedelta(minutes=1), 3, 4.3, 6.5, 4.0, 5.5, None),
        ("A", t + dt.timedelta(minutes=20), 4, None, 6.0, 4.0, 5.0, 1),
        ("B", t + dt.timedelta(minutes=2), 5, 1.0, 1.0, 1.0, 1.0, 9),
    ]
    schema = "symbol string, ts timestamp_ntz, id int, open double, high double, low double, close double, volume long"
    out = rows(resample_ohlcv(spark.createDataFrame(data, schema), "5min", PanelSpec("ts", ("symbol",), ("id",))), "symbol")
    assert [(r["symbol"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out] == [
        ("A", 4.2, 6.5, 4.0, 5.5, 3),
        ("B", 1.0, 1.0, 1.0, 1.0, 9),
    ]
