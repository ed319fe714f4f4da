"""Queries that run a user's own function along every group."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from panelwright.catalog.registry import R, query, rounded
from panelwright.catalog.views import BAR, BARS_SQL, STORE, STORE_DAILY_SQL, bars, store_daily
from panelwright.operators.grouped import apply_by_group, block_function
from panelwright.operators.rolling import bollinger_bands
from panelwright.plans.blocks import over_blocks

#: Small blocks, so that every group is cut many times.
SMALL = 50


def _bar_shape(rows):
    """A median of five closes, a mean around each row, and a weighted mean of three."""
    close = rows["close"]
    return rows.assign(
        median_5=close.rolling(5).median(),
        centred_3=close.rolling(3, center=True, min_periods=1).mean(),
        weighted_3=(3 * close + 2 * close.shift(1) + close.shift(2)) / 6,
    )


@query("j4_apply_by_group", f"""WITH {BARS_SQL}
SELECT event_type, ts, close, {R("CASE WHEN count(*) OVER w5 = 5 THEN median(close) OVER w5 END")} AS median_5,
 {R("avg(close) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")} AS centred_3,
 {R("(3 * close + 2 * lag(close) OVER w + lag(close, 2) OVER w) / 6")} AS weighted_3
FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts), w5 AS (PARTITION BY event_type ORDER BY ts ROWS 4 PRECEDING)""")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("event_type", "ts", "close")
    returns = "median_5 double, centred_3 double, weighted_3 double"
    return rounded(apply_by_group(b, replace(BAR, block_rows=SMALL), _bar_shape, returns, ["close"], before=4, after=1))


def _band_breaks(rows):
    """How many of the last seven closes lie outside their bands."""
    outside = (rows["close"] > rows["bb_upper"]) | (rows["close"] < rows["bb_lower"])
    return rows.assign(breaks_7=outside.astype("int64").rolling(7, min_periods=1).sum())


@query("j4_with_library_features", f"""WITH {BARS_SQL}, m AS (
  SELECT event_type, ts, close, avg(close) OVER w AS middle, stddev_samp(close) OVER w AS s, count(*) OVER w AS n FROM bars
  WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 19 PRECEDING)),
 o AS (SELECT *, CASE WHEN n = 20 AND (close > middle + 2 * s OR close < middle - 2 * s) THEN 1 ELSE 0 END AS outside FROM m)
SELECT event_type, ts, CAST(sum(outside) OVER (PARTITION BY event_type ORDER BY ts ROWS 6 PRECEDING) AS DOUBLE) AS breaks_7 FROM o""")
def j4_with_features(spark: SparkSession, sf: str) -> DataFrame:
    """The function reads the bands that the same ordered pass computes: 19 rows for a band, then 6
    for the count."""
    b = bars(spark, sf).select("event_type", "ts", "close")
    bands = bollinger_bands()
    own = block_function(_band_breaks, "breaks_7 double", ["close", "bb_upper", "bb_lower"], before=bands.before + 6)
    return over_blocks(b, replace(BAR, block_rows=SMALL), bands, own).select("event_type", "ts", "breaks_7")


def _surge(rows):
    """Sales against the largest of the seven days before."""
    return rows.assign(surge=rows["Sales"] / rows["Sales"].shift(1).rolling(7, min_periods=1).max())


@query("j4_apply_by_store", f"""WITH {STORE_DAILY_SQL}
SELECT Store, Date, Sales, {R("Sales / max(Sales) OVER (PARTITION BY Store ORDER BY Date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")} AS surge FROM store_daily""")
def j4_stores(spark: SparkSession, sf: str) -> DataFrame:
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    return rounded(apply_by_group(d, replace(STORE, block_rows=SMALL), _surge, "surge double", ["Sales"], before=7))
