"""Panels derived from the given tables, as Spark frames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.resample import resample_ohlcv
from panelwright.spec import PanelSpec

TICK = PanelSpec("ts", ("event_type",), ("event_id",), step=60, count_first=True)
BAR = PanelSpec("ts", ("event_type",), step=3600, count_first=True)
STORE = PanelSpec("Date", ("Store",), step=86400, count_first=True)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a tick: its value is the price, its volume is 1."""
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_type", "ts", "event_id",
        v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1).cast("long").alias("volume"),
    )


TICKS_SQL = """ticks AS (
  SELECT event_type, ts, event_id, value AS open, value AS high, value AS low, value AS close,
         CAST(1 AS BIGINT) AS volume FROM events)"""


def bars(spark: SparkSession, sf: str, tf: str = "1h") -> DataFrame:
    return resample_ohlcv(ticks(spark, sf), tf, TICK)


def bars_sql(minutes: int = 60, source: str = "ticks", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT event_type, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts,
           arg_min(open, (ts, event_id)) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, (ts, event_id)) FILTER (WHERE close IS NOT NULL) AS close,
           CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume
    FROM {source} GROUP BY 1, 2)
  WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL)"""


BARS_SQL = f"{TICKS_SQL},\n{bars_sql()}"


def faulty_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with faults put in by event number: bad prices, missing values, crossed ranges,
    negative volume and times shared by several ticks."""
    e = F.col("event_id")
    t = ticks(spark, sf)
    return t.withColumns(
        {
            "ts": F.when(e % 13 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts")),
            "open": F.when(e % 17 == 0, -F.col("open")).otherwise(F.col("open")),
            "close": F.when(e % 19 != 0, F.col("close")),
            "high": F.when(e % 23 == 0, F.col("low") - 1.0).otherwise(F.col("high")),
            "volume": F.when(e % 29 == 0, F.lit(-1).cast("long")).otherwise(F.col("volume")),
        }
    )


FAULTY_SQL = f"""{TICKS_SQL}, faulty AS (
  SELECT event_type, CASE WHEN event_id % 13 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts, event_id,
         CASE WHEN event_id % 17 = 0 THEN -open ELSE open END AS open,
         CASE WHEN event_id % 23 = 0 THEN low - 1.0 ELSE high END AS high, low,
         CASE WHEN event_id % 19 <> 0 THEN close END AS close,
         CASE WHEN event_id % 29 = 0 THEN CAST(-1 AS BIGINT) ELSE volume END AS volume FROM ticks)"""


def gappy_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars whose prices are missing or not positive at some hours."""
    h, d = F.hour("ts"), F.dayofmonth("ts")
    return bars(spark, sf).withColumns(
        {
            "open": F.when((h % 5) == 0, F.lit(-1.0)).otherwise(F.col("open")),
            "close": F.when((h >= 6) & (h <= 14), F.lit(0.0)).otherwise(F.col("close")),
            "high": F.when((d % 4) == 0, F.col("low") - 0.5).otherwise(F.col("high")),
            "volume": F.when((h % 7) == 0, -F.col("volume")).otherwise(F.col("volume")),
        }
    )


GAPPY_SQL = f"""{BARS_SQL}, gappy AS (
  SELECT event_type, ts, CASE WHEN hour(ts) % 5 = 0 THEN -1.0 ELSE open END AS open,
         CASE WHEN day(ts) % 4 = 0 THEN low - 0.5 ELSE high END AS high, low,
         CASE WHEN hour(ts) BETWEEN 6 AND 14 THEN 0.0 ELSE close END AS close,
         CASE WHEN hour(ts) % 7 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


def store_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sales per nation: a store is a nation, its sales the order totals."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey, "inner")
    daily = joined.groupBy(F.col("c_nationkey").alias("Store"), F.col("o_orderdate").alias("Date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("Sales"),
        F.count_distinct("o_custkey").cast("int").alias("Customers"),
    )
    day, month, dow = F.dayofmonth("Date"), F.month("Date"), F.weekday("Date")
    return daily.withColumns(
        {
            "Date": F.col("Date").cast("timestamp_ntz"),
            "DayOfWeek": dow + 1,
            "Open": F.when((dow == 6) & (F.col("Store") % 2 == 0), 0).otherwise(1),
            "Promo": F.when(day <= 14, 1).otherwise(0),
            "StateHoliday": F.when((month == 12) & (day == 25), "c").when(day == 1, "a").when(day == 15, "b").otherwise("0"),
            "SchoolHoliday": F.when(month.isin(7, 8), 1).otherwise(0),
        }
    )


STORE_DAILY_SQL = """store_daily AS (
  SELECT Store, Date, round(sum_price, 2) AS Sales, CAST(n AS INTEGER) AS Customers,
         CAST(isodow(Date) AS INTEGER) AS DayOfWeek,
         CASE WHEN isodow(Date) = 7 AND Store % 2 = 0 THEN 0 ELSE 1 END AS Open,
         CASE WHEN day(Date) <= 14 THEN 1 ELSE 0 END AS Promo,
         CASE WHEN month(Date) = 12 AND day(Date) = 25 THEN 'c' WHEN day(Date) = 1 THEN 'a'
              WHEN day(Date) = 15 THEN 'b' ELSE '0' END AS StateHoliday,
         CASE WHEN month(Date) IN (7, 8) THEN 1 ELSE 0 END AS SchoolHoliday
  FROM (SELECT c_nationkey AS Store, CAST(o_orderdate AS TIMESTAMP) AS Date, sum(o_totalprice) AS sum_price,
               count(DISTINCT o_custkey) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""


def store_dim(spark: SparkSession, sf: str) -> DataFrame:
    """One row per nation with store attributes computed from its number."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
        k.alias("Store"),
        F.substring(F.lit("abcd"), k % 4 + 1, F.lit(1)).alias("StoreType"),
        F.substring(F.lit("abc"), k % 3 + 1, F.lit(1)).alias("Assortment"),
        F.col("r_name").alias("Region"),
        F.when(k % 6 != 0, (k * 3701 % 60000 + 120).cast("double")).alias("CompetitionDistance"),
        F.when(k % 5 != 0, k % 14).alias("CompetitionOpenSinceMonth"),
        F.when(k % 7 != 0, k % 12 + 1990).alias("CompetitionOpenSinceYear"),
        (k % 2).alias("Promo2"),
        F.when(k % 2 == 1, (k * 5 % 53 + 1).cast("double")).alias("Promo2SinceWeek"),
        F.when(k % 2 == 1, (k % 6 + 1994).cast("double")).alias("Promo2SinceYear"),
        F.when(k % 4 == 1, "Jan,Apr,Jul,Oct").when(k % 4 == 3, "Mar,Jun,Sept,Dec").alias("PromoInterval"),
    )


STORE_DIM_SQL = """store_dim AS (
  SELECT n_nationkey AS Store, substr('abcd', n_nationkey % 4 + 1, 1) AS StoreType,
         substr('abc', n_nationkey % 3 + 1, 1) AS Assortment, r_name AS Region,
         CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey * 3701 % 60000 + 120 AS DOUBLE) END AS CompetitionDistance,
         CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 14 END AS CompetitionOpenSinceMonth,
         CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey % 12 + 1990 END AS CompetitionOpenSinceYear,
         n_nationkey % 2 AS Promo2,
         CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_nationkey * 5 % 53 + 1 AS DOUBLE) END AS Promo2SinceWeek,
         CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_nationkey % 6 + 1994 AS DOUBLE) END AS Promo2SinceYear,
         CASE n_nationkey % 4 WHEN 1 THEN 'Jan,Apr,Jul,Oct' WHEN 3 THEN 'Mar,Jun,Sept,Dec' END AS PromoInterval
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SALES_SQL = f"{STORE_DAILY_SQL},\n{STORE_DIM_SQL}"
