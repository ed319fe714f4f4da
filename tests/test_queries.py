"""Registered queries against their SQL on the smallest tables. tools/check_oracle.py runs all
of them at any size."""

import pytest

duckdb = pytest.importorskip("duckdb")

from panelwright import catalog  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

# one query of every kind
CHOSEN = [
    "a1_read_time_series", "a2_read_ohlcv_daily", "a3_read_ohlcv_intraday", "a5_materialize", "a6_write_predictions", "a7_flatten_metrics",
    "a16_read_experiments", "b1_clean_ohlc_daily", "b2_clean_ohlc_intraday", "b3_filter_market_hours", "b8_fill_backward_zero", "c4_label_map",
    "d1_resample_faulty", "d2a_fit_scaler_standard", "d2c_fit_scaler_robust", "d10_profile_features", "d15_order_violations",
    "d17_quality_report", "e2_forward_returns_log", "e4_cumulative_return", "e11_technical_indicators", "e13_split_time_series",
    "e16_grouped_supervised_set", "e17_scale_global", "f2_best_experiments", "f4_latest_window", "g2_unseen_labels", "h3_date_features",
    "h11_store_preprocess", "h14_future_timestamps", "h21_prepare_categorical_inputs", "i4_return_forecast_features", "i6_predict",
    "i12_run_experiment",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, sf, con, name):
    n, finding = compare(spark, con, sf, catalog.queries()[name], catalog.oracle_sql()[name])
    assert not finding and n > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
