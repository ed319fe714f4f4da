"""Queries over ticks and bars: cleaning, resampling, windows, targets, splits, sequences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelwright.catalog.registry import R, query, rounded
from panelwright.catalog.views import (
    BAR, BARS_SQL, FAULTY_SQL, GAPPY_SQL, SALES_SQL, STORE, STORE_DAILY_SQL, TICK, TICKS_SQL,
    bars, bars_sql, faulty_ticks, gappy_bars, store_daily, table, ticks,
)
from panelwright.operators import clean, profile, resample, rolling, sequence, split, targets
from panelwright.plans.blocks import over_blocks
from panelwright.session import new_table_path
from panelwright.sources.readers import with_ingest_order
from panelwright.spec import MARKETS, TIMEFRAMES, PanelSpec, require_columns, timeframe

# --- flagship -----------------------------------------------------------------------------

FLAGSHIP_SQL = f"""WITH {BARS_SQL}, f AS (
  SELECT *, lead(close) OVER w AS nxt, avg(close) OVER r AS m, stddev_samp(close) OVER r AS s, count(close) OVER r AS k
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts),
                  r AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_type, ts, open, high, low, close, volume, nxt AS close_target_h1,
       {R("CASE WHEN k < 20 OR s IS NULL OR s = 0 THEN 0.5 ELSE (close - (m - 2 * s)) / (4 * s) END")} AS bb_position
FROM f WHERE nxt IS NOT NULL"""


@query("hourly_bars_with_target", FLAGSHIP_SQL)
def hourly_bars_with_target(spark, sf):
    """Hourly bars per event type with the next close and the 20-bar band position."""
    out = over_blocks(bars(spark, sf), BAR, rolling.bb_position("close", 20, 2.0), targets.shifted_targets(["close"], 1))
    return rounded(out.na.drop(subset=["close_target_h1"]))


# --- cleaning -----------------------------------------------------------------------------


@query("b1_clean_ohlc_daily", f"""WITH {GAPPY_SQL}, p AS (
  SELECT event_type, ts, volume, CASE WHEN open > 0 THEN open END AS o, CASE WHEN high > 0 THEN high END AS h,
         CASE WHEN low > 0 THEN low END AS l, CASE WHEN close > 0 THEN close END AS c FROM gappy), q AS (
  SELECT event_type, ts, volume, last_value(o IGNORE NULLS) OVER w AS o, last_value(h IGNORE NULLS) OVER w AS h,
         last_value(l IGNORE NULLS) OVER w AS l, last_value(c IGNORE NULLS) OVER w AS c
  FROM p WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, ts, o AS open, CASE WHEN h < l THEN l ELSE h END AS high, CASE WHEN h < l THEN h ELSE l END AS low,
       c AS close, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume FROM q""")
def b1(spark, sf):
    return clean.clean_ohlc_daily(gappy_bars(spark, sf), BAR)


_GOOD = """open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0
  AND NOT (high < low OR high < open OR high < close OR low > open OR low > close)"""


@query("b2_clean_ohlc_intraday", f"""WITH {FAULTY_SQL}
SELECT event_type, ts, event_id, open, high, low, close, volume FROM faulty WHERE {_GOOD}
QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1""")
def b2(spark, sf):
    return clean.clean_ohlc_intraday(faulty_ticks(spark, sf), TICK)


@query("b2_fault_report", f"""WITH {FAULTY_SQL}, f AS (
  SELECT open IS NULL OR open <= 0 AS bo, high IS NULL OR high <= 0 AS bh, low IS NULL OR low <= 0 AS bl,
         close IS NULL OR close <= 0 AS bc, volume IS NULL OR volume < 0 AS bv,
         coalesce(high < low OR high < open OR high < close OR low > open OR low > close, false) AS br FROM faulty)
SELECT count(*) AS rows_in, count(*) FILTER (bo) AS bad_open, count(*) FILTER (bh) AS bad_high,
       count(*) FILTER (bl) AS bad_low, count(*) FILTER (bc) AS bad_close, count(*) FILTER (bv) AS bad_volume,
       count(*) FILTER (br) AS bad_range, count(*) FILTER (NOT (bo OR bh OR bl OR bc OR bv OR br)) AS rows_kept FROM f""")
def b2_report(spark, sf):
    return clean.fault_report(faulty_ticks(spark, sf))


_SECOND = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"


@query("b3_filter_market_hours", f"""WITH {TICKS_SQL}, s AS (SELECT *, {_SECOND} AS t FROM ticks)
SELECT 'US' AS market, event_type, ts, event_id, close FROM s WHERE t >= 34200 AND t < 57600
UNION ALL SELECT 'INDIA', event_type, ts, event_id, close FROM s WHERE t >= 33300 AND t < 55800
UNION ALL SELECT 'CRYPTO', event_type, ts, event_id, close FROM s""")
def b3(spark, sf):
    t = ticks(spark, sf)
    out = None
    for m in MARKETS:
        part = clean.filter_market_hours(t, "ts", m).select(F.lit(m).alias("market"), "event_type", "ts", "event_id", "close")
        out = part if out is None else out.unionByName(part)
    return out


@query("b4_filter_rows", f"WITH {STORE_DAILY_SQL} SELECT * FROM store_daily WHERE Open = 1 AND Sales > 0")
def b4(spark, sf):
    return clean.filter_rows(store_daily(spark, sf), remove_closed=True, remove_zero_sales=True)


@query("b5_filter_group", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'F'""")
def b5(spark, sf):
    return clean.filter_group(table(spark, sf, "lineitem"), l_returnflag="A", l_linestatus="F").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


@query("b6_drop_null_targets", f"""WITH {BARS_SQL}, f AS (
  SELECT event_type, ts, close, lead(close, 1) OVER w AS close_target_h1, lead(close, 2) OVER w AS close_target_h2
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT * FROM f WHERE close_target_h1 IS NOT NULL AND close_target_h2 IS NOT NULL""")
def b6(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    shifted = targets.shift_targets(b, BAR, "close", 2, drop_incomplete=False)
    return clean.drop_null_targets(shifted, targets.target_names(["close"], 2))


@query("b7_drop_warmup", f"""WITH {BARS_SQL}, f AS (
  SELECT event_type, ts, close, avg(close) OVER r AS m, count(close) OVER r AS k, lead(close) OVER w AS nxt
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts),
       r AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_type, ts, {R("m")} AS close_rolling_mean_10, {R("(nxt - close) / close * 100")} AS return_1d
FROM f WHERE k = 10 AND nxt IS NOT NULL AND close <> 0""")
def b7(spark, sf):
    out = over_blocks(bars(spark, sf), BAR, rolling.rolling_features("close", [10]), targets.forward_returns("close", (1,)))
    return rounded(clean.drop_warmup(out, ["event_type", "ts"], ["close_rolling_mean_10", "return_1d"]))


@query("b8_fill_backward_zero", f"""WITH {GAPPY_SQL}, g AS (
  SELECT event_type, ts, CASE WHEN close > 0 THEN close END AS close, CASE WHEN hour(ts) % 7 <> 0 THEN volume END AS volume
  FROM gappy)
SELECT event_type, ts, coalesce(first_value(close IGNORE NULLS) OVER w, 0.0) AS close,
       coalesce(first_value(volume IGNORE NULLS) OVER w, 0) AS volume
FROM g WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def b8(spark, sf):
    g = gappy_bars(spark, sf).select(
        "event_type", "ts",
        F.when(F.col("close") > 0, F.col("close")).alias("close"),
        F.when(F.hour("ts") % 7 != 0, F.col("volume")).alias("volume"),
    )
    return clean.fill_backward_zero(g, BAR)


@query("b9_dedup_bars", f"""WITH {FAULTY_SQL}
SELECT event_type, ts, event_id, open, high, low, close, volume FROM faulty
QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1""")
def b9(spark, sf):
    return clean.dedup_bars(faulty_ticks(spark, sf), TICK)


@query("b10_fill_zero", f"""WITH {SALES_SQL}
SELECT Store, Date, Sales, coalesce(CompetitionDistance, 0.0) AS CompetitionDistance,
       coalesce(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth, coalesce(PromoInterval, '0') AS PromoInterval
FROM store_daily LEFT JOIN store_dim USING (Store)""")
def b10(spark, sf):
    from panelwright.catalog.views import store_dim
    from panelwright.operators.sales import merge_store_data

    merged = merge_store_data(store_daily(spark, sf), store_dim(spark, sf))
    return clean.fill_zero(
        merged.select("Store", "Date", "Sales", "CompetitionDistance", "CompetitionOpenSinceMonth", "PromoInterval")
    )


@query("b11_select_numeric_features", """SELECT l_shipdate, l_quantity, l_discount, l_tax, CAST(0.0 AS DOUBLE) AS l_margin
FROM lineitem""")
def b11(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    fitted = [*clean.numeric_features(li, [*keys, "l_extendedprice"]), "l_margin"]
    return clean.with_fitted_features(li, fitted).select("l_shipdate", *fitted)


@query("b12_limit_groups", f"""WITH {STORE_DAILY_SQL}
SELECT Store, Date, Sales FROM store_daily WHERE Store IN (SELECT DISTINCT Store FROM store_daily ORDER BY Store LIMIT 5)""")
def b12(spark, sf):
    return clean.limit_groups(store_daily(spark, sf), "Store", 5).select("Store", "Date", "Sales")


@query("b13_require_columns", f"""WITH {BARS_SQL}
SELECT event_type, CAST(count(*) AS BIGINT) AS bars, true AS refused FROM bars GROUP BY 1""")
def b13(spark, sf):
    """Complete bars pass; the same bars without two columns are refused by their names."""
    b = require_columns(bars(spark, sf), "event_type", "ts", "open", "high", "low", "close", "volume")
    try:
        require_columns(b.drop("low", "volume"), *b.columns)
        refused = False
    except ValueError as error:
        refused = "missing columns ['low', 'volume']" in str(error)
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("bars")).withColumn("refused", F.lit(refused))


@query("b14_validate_returns", f"""WITH {BARS_SQL}, f AS (
  SELECT (lead(close, 1) OVER w - close) / close AS r1, (lead(close, 5) OVER w - close) / close AS r5
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT count(*) AS rows, count(r1) AS return_1d_valid, count(r5) AS return_5d_valid,
       {R("count(r1) * 100.0 / count(*)")} AS return_1d_valid_pct, {R("count(r5) * 100.0 / count(*)")} AS return_5d_valid_pct
FROM f""")
def b14(spark, sf):
    out = over_blocks(bars(spark, sf), BAR, targets.forward_returns("close", (1, 5)))
    return rounded(targets.return_validity(out, [1, 5]))


# --- bars and windows ---------------------------------------------------------------------

for _tf, _minutes in (("1min", 1), ("5min", 5), ("15min", 15), ("1h", 60)):

    def _bars_of(spark, sf, tf=_tf):
        return bars(spark, sf, tf)

    query(f"d1_resample_ohlcv_{_tf}", f"WITH {TICKS_SQL},\n{bars_sql(_minutes)}\nSELECT * FROM bars")(_bars_of)


@query("d1_resample_faulty", f"WITH {FAULTY_SQL},\n{bars_sql(60, 'faulty')}\nSELECT * FROM bars")
def d1_faulty(spark, sf):
    """Missing prices and equal times: first / last skip nulls, ties go by event number."""
    return resample.resample_ohlcv(faulty_ticks(spark, sf), "1h", TICK)


@query("d7_group_sizes", f"""WITH {STORE_DAILY_SQL}
SELECT Store, count(*) AS rows FROM store_daily GROUP BY 1""")
def d7(spark, sf):
    return split.group_sizes(store_daily(spark, sf), ["Store"])


@query("d7_min_group_size", f"""WITH {STORE_DAILY_SQL}, s AS (SELECT count(*) AS n FROM store_daily GROUP BY Store)
SELECT min(n) AS min_rows, CAST(floor(min(n) * 0.2) AS BIGINT) AS val_size FROM s""")
def d7_min(spark, sf):
    return split.min_group_size(store_daily(spark, sf), ["Store"], 0.2)


@query("d14_return_stats", f"""WITH {BARS_SQL}, f AS (
  SELECT (lead(close, 1) OVER w - close) / close * 100 AS r1, (lead(close, 3) OVER w - close) / close * 100 AS r3
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts)), l AS (
  SELECT 'return_1d' AS "column", r1 AS v FROM f UNION ALL SELECT 'return_3d', r3 FROM f)
SELECT "column", count(v) AS valid, count(*) FILTER (v IS NULL) AS missing, {R("avg(v)", 4)} AS mean,
       {R("stddev_samp(v)", 4)} AS std, {R("min(v)", 4)} AS min, {R("max(v)", 4)} AS max FROM l GROUP BY 1""")
def d14(spark, sf):
    out = over_blocks(bars(spark, sf), BAR, targets.forward_returns("close", (1, 3)))
    return rounded(targets.return_stats(out, [1, 3]), 4)


@query("d15_order_violations", """WITH e AS (
  SELECT event_type, event_id, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL '2 days' ELSE ts END AS ts FROM events), f AS (
  SELECT event_type, ts < lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS back FROM e)
SELECT event_type, count(*) AS rows, count(*) FILTER (back) AS violations FROM f GROUP BY 1""")
def d15(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", "event_id",
        F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("INTERVAL '2' DAY")).otherwise(F.col("ts")).alias("ts"),
    )
    return profile.order_violations(e, "ts", PanelSpec("event_id", ("event_type",), step=1, cell_steps=100_000, count_first=True))


@query("d15_ingest_order", """WITH e AS (
  SELECT event_type, event_id, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL '2 days' ELSE ts END AS ts FROM events), f AS (
  SELECT event_type, ts < lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS back FROM e)
SELECT event_type, count(*) AS rows, count(*) FILTER (back) AS violations FROM f GROUP BY 1""")
def d15_ingest(spark, sf):
    """Written CSV files without an id: the order is that of the files and of the rows in them."""
    back = F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("INTERVAL '2' DAY")).otherwise(F.col("ts")).alias("ts")
    events, path = table(spark, sf, "events"), new_table_path(spark, "events")
    events.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select("event_type", back).write.csv(path)
    read = with_ingest_order(spark.read.schema("event_type string, ts timestamp_ntz").csv(path))
    return profile.order_violations(read, "ts", PanelSpec("_ingest", ("event_type",)))


@query("d16_weekend_count", """SELECT count(*) FILTER (isodow(ts) >= 6) AS weekend_rows, count(*) AS rows FROM events""")
def d16(spark, sf):
    return profile.weekend_count(table(spark, sf, "events"), "ts")


@query("d17_quality_report", f"""WITH {FAULTY_SQL}
SELECT count(*) AS rows, CAST(count(*) FILTER (close IS NULL) AS BIGINT) AS null_values,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, ts FROM faulty)) AS BIGINT) AS duplicate_keys FROM faulty""")
def d17(spark, sf):
    return profile.quality_report(faulty_ticks(spark, sf), TICK)


@query("e1_shift_targets", f"""WITH {BARS_SQL}, f AS (
  SELECT *, lead(close, 1) OVER w AS close_target_h1, lead(close, 2) OVER w AS close_target_h2,
         lead(close, 3) OVER w AS close_target_h3, lead(volume, 1) OVER w AS volume_target_h1,
         lead(volume, 2) OVER w AS volume_target_h2, lead(volume, 3) OVER w AS volume_target_h3
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT * FROM f WHERE close_target_h3 IS NOT NULL AND volume_target_h3 IS NOT NULL""")
def e1(spark, sf):
    return targets.shift_targets(bars(spark, sf), BAR, ["close", "volume"], 3)


@query("e1_shift_targets_two_keys", """WITH d AS (
  SELECT l_returnflag, l_linestatus, l_shipdate, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2, 3), f AS (
  SELECT *, lead(revenue) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate) AS revenue_target_h1 FROM d)
SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate, revenue, revenue_target_h1 FROM f
WHERE revenue_target_h1 IS NOT NULL""")
def e1_two(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_shipdate").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )
    spec = PanelSpec("l_shipdate", ("l_returnflag", "l_linestatus"), count_first=True)
    return targets.shift_targets(d, spec, "revenue", 1)


def _odd_prices(b):
    """The bars' closes, zero every sixth hour and negative three hours later."""
    hour = F.hour("ts") % 6
    return b.select("event_type", "ts", F.when(hour == 0, 0.0).when(hour == 3, -F.abs("close")).otherwise(F.col("close")).alias("close"))


def _ratio_sql(a, b):
    """Division with 0/0 null and x/0 infinite."""
    zero = f"CASE WHEN {a} > 0 THEN 'Infinity'::DOUBLE WHEN {a} < 0 THEN '-Infinity'::DOUBLE END"
    return f"CASE WHEN {b} = 0 THEN {zero} ELSE {a} / {b} END"


def _returns_sql(kind):
    ratio = _ratio_sql("(a{h} - close)", "close") if kind == "percentage" else _ratio_sql("a{h}", "close")
    log = "CASE WHEN r{h} = 0 THEN '-Infinity'::DOUBLE WHEN r{h} > 0 THEN ln(r{h}) END"
    value = "r{h} * 100" if kind == "percentage" else f"({log}) * 100"
    of = lambda text: ", ".join(text.format(h=h) for h in range(1, 6))
    return f"""WITH {BARS_SQL}, odd AS (
  SELECT event_type, ts, CASE hour(ts) % 6 WHEN 0 THEN 0.0::DOUBLE WHEN 3 THEN -abs(close) ELSE close END AS close FROM bars
), ahead AS (SELECT *, {of("lead(close, {h}) OVER w AS a{h}")} FROM odd WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
ratios AS (SELECT event_type, ts, close, {of(ratio + " AS r{h}")} FROM ahead)
SELECT event_type, ts, close, {of(R(value) + " AS return_{h}d")} FROM ratios"""


@query("e2_forward_returns", _returns_sql("percentage"))
def e2(spark, sf):
    return rounded(over_blocks(_odd_prices(bars(spark, sf)), BAR, targets.forward_returns("close")))


@query("e2_forward_returns_log", _returns_sql("log"))
def e2_log(spark, sf):
    return rounded(over_blocks(_odd_prices(bars(spark, sf)), BAR, targets.forward_returns("close", kind="log")))


@query("e3_return_columns", f"""WITH {BARS_SQL}, f AS (
  SELECT (lead(close, 1) OVER w - close) / close AS r1, (lead(close, 4) OVER w - close) / close AS r4 FROM bars
  WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT 'return_1d' AS "column", count(r1) AS valid FROM f UNION ALL SELECT 'return_4d', count(r4) FROM f""")
def e3(spark, sf):
    out = over_blocks(bars(spark, sf), BAR, targets.forward_returns("close", (1, 4)))
    names = targets.return_column_names([1, 4])
    wide = out.agg(*[F.count(c).alias(c) for c in names])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("valid")) for c in names])))


@query("e4_cumulative_return", f"""WITH {BARS_SQL}, f AS (
  SELECT event_type, ts, close, first_value(close) OVER (PARTITION BY event_type ORDER BY ts) AS p0 FROM bars)
SELECT event_type, ts, close, {R("(close - p0) / p0 * 100")} AS cumulative_return FROM f""")
def e4(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    return rounded(over_blocks(b, BAR, targets.cumulative_return("close")))


def _rolling_sql():
    cols = []
    for n in (3, 7, 14):
        for f, s in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append(f"{R(f'CASE WHEN count(close) OVER w{n} = {n} THEN {s}(close) OVER w{n} END')} AS close_rolling_{f}_{n}")
    wins = ", ".join(f"w{n} AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 7, 14))
    return f"WITH {BARS_SQL} SELECT event_type, ts, close, {', '.join(cols)} FROM bars WINDOW {wins}"


@query("e5_rolling_features", _rolling_sql())
def e5(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    return rounded(over_blocks(b, BAR, rolling.rolling_features("close", [3, 7, 14])))


@query("e6_ewm_mean", f"""WITH RECURSIVE {BARS_SQL}, n AS (
  SELECT event_type, ts, close, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM bars), y AS (
  SELECT event_type, ts, k, close, close AS m FROM n WHERE k = 1
  UNION ALL SELECT n.event_type, n.ts, n.k, n.close, y.m * (1 - 2.0e0 / 15) + n.close * (2.0e0 / 15)
  FROM y JOIN n ON n.event_type = y.event_type AND n.k = y.k + 1)
SELECT event_type, ts, close, {R("CASE WHEN k >= 14 THEN m END")} AS close_ewm_14 FROM y""")
def e6(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    return rounded(over_blocks(b, BAR, rolling.ewm_mean("close", 14, min_periods=14)))


_RSI_CTE = f"""{BARS_SQL}, d AS (
  SELECT *, close - lag(close) OVER (PARTITION BY event_type ORDER BY ts) AS step,
         row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM bars), g AS (
  SELECT *, CASE WHEN step > 0 THEN step ELSE 0.0 END AS gain, CASE WHEN step < 0 THEN -step ELSE 0.0 END AS loss FROM d), y AS (
  SELECT event_type, ts, k, gain AS ag, loss AS al FROM g WHERE k = 1
  UNION ALL SELECT g.event_type, g.ts, g.k, y.ag * (1 - 2.0e0 / 15) + g.gain * (2.0e0 / 15),
                   y.al * (1 - 2.0e0 / 15) + g.loss * (2.0e0 / 15)
  FROM y JOIN g ON g.event_type = y.event_type AND g.k = y.k + 1), rsi AS (
  SELECT event_type, ts, CASE WHEN k < 14 OR al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM y)"""


@query("e7_rsi", f"WITH RECURSIVE {_RSI_CTE} SELECT event_type, ts, close, {R('rsi_14')} AS rsi_14 FROM bars JOIN rsi USING (event_type, ts)")
def e7(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    return rounded(over_blocks(b, BAR, rolling.rsi("close", 14)))


@query("e8_bollinger_bands", f"""WITH {BARS_SQL}, f AS (
  SELECT event_type, ts, close, avg(close) OVER r AS m, stddev_samp(close) OVER r AS s, count(close) OVER r AS k
  FROM bars WINDOW r AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_type, ts, close, {R("CASE WHEN k = 20 THEN m + 2 * s END")} AS bb_upper, {R("CASE WHEN k = 20 THEN m END")} AS bb_middle,
       {R("CASE WHEN k = 20 THEN m - 2 * s END")} AS bb_lower FROM f""")
def e8(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    return rounded(over_blocks(b, BAR, rolling.bollinger_bands("close", 20, 2.0)))


_BB_CTE = """bb AS (
  SELECT event_type, ts, CASE WHEN k < 20 OR s = 0 THEN 0.5 ELSE (close - (m - 2 * s)) / (4 * s) END AS bb_position FROM (
    SELECT event_type, ts, close, avg(close) OVER r AS m, stddev_samp(close) OVER r AS s, count(close) OVER r AS k
    FROM bars WINDOW r AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"""
_VOL_CTE = """rv AS (
  SELECT event_type, ts, CASE WHEN k < 20 OR m = 0 THEN 1.0 ELSE volume / m END AS relative_volume FROM (
    SELECT event_type, ts, volume, avg(volume) OVER r AS m, count(volume) OVER r AS k
    FROM bars WINDOW r AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"""


@query("e9_bb_position", f"WITH {BARS_SQL}, {_BB_CTE} SELECT event_type, ts, close, {R('bb_position')} AS bb_position FROM bars JOIN bb USING (event_type, ts)")
def e9(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close")
    return rounded(over_blocks(b, BAR, rolling.bb_position("close", 20, 2.0)))


@query("e10_relative_volume", f"WITH {BARS_SQL}, {_VOL_CTE} SELECT event_type, ts, volume, {R('relative_volume')} AS relative_volume FROM bars JOIN rv USING (event_type, ts)")
def e10(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "volume")
    return rounded(over_blocks(b, BAR, rolling.relative_volume("volume", 20)))


_INDICATORS = f"""WITH RECURSIVE {_RSI_CTE}, {_BB_CTE}, {_VOL_CTE}, ind AS (
  SELECT b.*, relative_volume, CASE WHEN open = 0 THEN 0.0 ELSE (close - open) / open END AS intraday_momentum, rsi_14, bb_position
  FROM bars b JOIN rsi USING (event_type, ts) JOIN bb USING (event_type, ts) JOIN rv USING (event_type, ts))"""


@query("e11_technical_indicators", f"""{_INDICATORS}
SELECT event_type, ts, open, high, low, close, volume, {R("relative_volume")} AS relative_volume,
       {R("intraday_momentum")} AS intraday_momentum, {R("rsi_14")} AS rsi_14, {R("bb_position")} AS bb_position FROM ind""")
def e11(spark, sf):
    return rounded(rolling.technical_indicators(bars(spark, sf), BAR))


_SPLIT_SQL = """n AS (
  SELECT *, row_number() OVER (PARTITION BY Store ORDER BY Date DESC) AS back, count(*) OVER (PARTITION BY Store) AS n
  FROM store_daily), k AS (SELECT * FROM n WHERE n >= 14 + 21 + 2 * 5 + 10)"""


def _split_query(context: bool) -> str:
    parts = [
        "SELECT *, 'train' AS split, false AS is_context FROM k WHERE back > 35",
        "SELECT *, 'val', false FROM k WHERE back > 14 AND back <= 35",
        "SELECT *, 'test', false FROM k WHERE back <= 14",
    ]
    if context:
        parts += [
            "SELECT *, 'val', true FROM k WHERE back > 35 AND back <= 39",
            "SELECT *, 'test', true FROM k WHERE back > 14 AND back <= 18",
        ]
    return f"""WITH {STORE_DAILY_SQL}, {_SPLIT_SQL}, s AS ({' UNION ALL '.join(parts)})
SELECT Store, Date, Sales, split, is_context FROM s"""


@query("e13_split_time_series", _split_query(True))
def e13(spark, sf):
    return split.split_time_series(store_daily(spark, sf).select("Store", "Date", "Sales"), STORE, 14, 21, 5)


@query("e13_split_without_overlap", _split_query(False))
def e13_plain(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    return split.split_time_series(d, STORE, 14, 21, 5, include_overlap=False)


@query("d12_date_range", f"""WITH {STORE_DAILY_SQL}, {_SPLIT_SQL}, s AS (
  SELECT *, CASE WHEN back <= 14 THEN 'test' WHEN back <= 35 THEN 'val' ELSE 'train' END AS split FROM k)
SELECT split, count(*) AS rows, count(DISTINCT Store) AS groups, min(Date) AS first, max(Date) AS last FROM s GROUP BY 1""")
def d12(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    return split.split_summary(split.split_time_series(d, STORE, 14, 21, 5, include_overlap=False), "Store", "Date")


def _lags(cols, n):
    return ", ".join(f"lag(CAST({c} AS DOUBLE), {n - 1 - i}) OVER w AS {c}_{i}" for i in range(n) for c in cols)


def _window_columns(df, keys, cols, n, extra=()):
    return df.select(
        *keys, *[F.col("window")[i][j].alias(f"{c}_{i}") for i in range(n) for j, c in enumerate(cols)], *extra
    )


_SEQ_SQL = f"""WITH {BARS_SQL}, f AS (
  SELECT event_type, ts, {_lags(["close", "volume"], 5)}, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n,
         lead(close, 1) OVER w AS t1, lead(close, 2) OVER w AS t2
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY ts))"""


@query("e14_sequence_windows", f"{_SEQ_SQL} SELECT * EXCLUDE (k, n, t1, t2) FROM f WHERE k >= 5 AND n > 5")
def e14(spark, sf):
    w = sequence.sequence_windows(bars(spark, sf), BAR, ["close", "volume"], 5)
    return _window_columns(w, ["event_type", "ts"], ["close", "volume"], 5)


@query("e15_sequence_windows_cat", f"""{_SEQ_SQL}, c AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_code
  FROM (SELECT DISTINCT event_type FROM bars))
SELECT f.* EXCLUDE (k, n, t1, t2), event_type_code FROM f JOIN c USING (event_type) WHERE k >= 5 AND n > 5""")
def e15(spark, sf):
    from panelwright.operators.encode import fit_labels

    b = bars(spark, sf)
    coded = fit_labels(b, ["event_type"]).encode(b)
    w = sequence.sequence_windows(coded, BAR, ["close", "volume"], 5)
    return _window_columns(w, ["event_type", "ts"], ["close", "volume"], 5, ["event_type_code"])


@query("e16_grouped_supervised_set", f"""WITH {BARS_SQL}, s AS (
  SELECT *, lead(close, 1) OVER v AS t1, lead(close, 2) OVER v AS t2 FROM bars WINDOW v AS (PARTITION BY event_type ORDER BY ts)), f AS (
  SELECT event_type, ts, {_lags(["close", "volume"], 5)}, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n,
         t1 AS close_target_h1, t2 AS close_target_h2
  FROM s WHERE t2 IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT * EXCLUDE (k, n) FROM f WHERE k >= 5 AND n > 5""")
def e16(spark, sf):
    shifted = targets.shift_targets(bars(spark, sf), BAR, "close", 2)
    w = sequence.sequence_windows(shifted, BAR, ["close", "volume"], 5)
    return _window_columns(w, ["event_type", "ts"], ["close", "volume"], 5, ["close_target_h1", "close_target_h2"])


@query("f1_chronological_sort", f"""WITH {BARS_SQL}
SELECT event_type, ts, close, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS position FROM bars ORDER BY event_type, ts""")
def f1(spark, sf):
    b = over_blocks(bars(spark, sf).select("event_type", "ts", "close"), BAR, keep_position=True)
    return b.withColumnRenamed("_pos", "position").drop("_group_rows").orderBy("event_type", "ts")


@query("f4_latest_window", f"""{_SEQ_SQL} SELECT * EXCLUDE (k, n, t1, t2) FROM f WHERE k = n AND n > 5""")
def f4(spark, sf):
    w = sequence.latest_window(bars(spark, sf), BAR, ["close", "volume"], 5)
    return _window_columns(w, ["event_type", "ts"], ["close", "volume"], 5)


@query("g1_concat", f"""WITH {BARS_SQL}
SELECT event_type, ts, close, volume, 'bar' AS source FROM bars
UNION ALL SELECT event_type, ts, close, NULL, 'tick' FROM ticks""")
def g1(spark, sf):
    b = bars(spark, sf).select("event_type", "ts", "close", "volume", F.lit("bar").alias("source"))
    t = ticks(spark, sf).select("event_type", "ts", "close", F.lit("tick").alias("source"))
    return b.unionByName(t, allowMissingColumns=True)


@query("g3_missing_features", """SELECT 'l_margin' AS feature, count(*) AS rows FROM lineitem""")
def g3(spark, sf):
    li = table(spark, sf, "lineitem")
    lack = clean.missing_features(li, ["l_quantity", "l_margin", "l_tax"])
    return li.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*map(F.lit, lack))).alias("feature"), "rows")


def _metadata_sql():
    parts = []
    for tf, c in TIMEFRAMES.items():
        parts.append(
            f"""SELECT '{tf}' AS timeframe, event_type, CAST({c['sequence_length']} AS INTEGER) AS sequence_length, count(*) AS bars,
 CAST(CASE WHEN count(*) > {c['sequence_length']} THEN count(*) - {c['sequence_length']} + 1 ELSE 0 END AS BIGINT) AS windows
 FROM (SELECT DISTINCT event_type, time_bucket(INTERVAL '{c['seconds']} seconds', ts) FROM events) GROUP BY event_type"""
        )
    return " UNION ALL ".join(parts)


@query("h23_timeframe_metadata", _metadata_sql())
def h23(spark, sf):
    """Bars and lookback windows each timeframe offers with its recommended length."""
    out = None
    for tf in TIMEFRAMES:
        n = timeframe(tf)["sequence_length"]
        part = bars(spark, sf, tf).groupBy("event_type").agg(F.count(F.lit(1)).alias("bars"))
        part = part.select(
            F.lit(tf).alias("timeframe"), "event_type", F.lit(n).alias("sequence_length"), "bars",
            F.when(F.col("bars") > n, F.col("bars") - n + 1).otherwise(0).cast("long").alias("windows"),
        )
        out = part if out is None else out.unionByName(part)
    return out


_US_SQL = f"{TICKS_SQL}, us AS (SELECT * FROM ticks WHERE {_SECOND} >= 34200 AND {_SECOND} < 57600)"


@query("i1_prepare_intraday", f"WITH {_US_SQL},\n{bars_sql(15, 'us')}\nSELECT * FROM bars")
def i1(spark, sf):
    return resample.prepare_intraday(ticks(spark, sf), "15min", TICK, "US")


@query("i2_prepare_intraday_for_training", f"""WITH {_US_SQL},\n{bars_sql(60, 'us')}
SELECT *, CAST(12 AS INTEGER) AS sequence_length FROM bars""")
def i2(spark, sf):
    p = resample.prepare_intraday_for_training(ticks(spark, sf), "1h", TICK, "US")
    return p.frame.withColumn("sequence_length", F.lit(p.sequence_length))


@query("i2_prepare_minutes_with_gaps", f"""WITH {FAULTY_SQL}, us AS (
  SELECT event_type, ts, event_id, close, CASE WHEN event_id % 7 <> 0 THEN volume END AS volume FROM faulty WHERE {_SECOND} >= 34200 AND {_SECOND} < 57600)
SELECT event_type, ts, event_id, coalesce(first_value(close IGNORE NULLS) OVER w, 0.0) AS close,
       coalesce(first_value(volume IGNORE NULLS) OVER w, 0) AS volume, CAST(240 AS INTEGER) AS sequence_length
FROM us WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def i2_gaps(spark, sf):
    """Rows with missing prices and volumes, so that the fill has something to do."""
    gaps = faulty_ticks(spark, sf).select(
        "event_type", "ts", "event_id", "close", F.when(F.col("event_id") % 7 != 0, F.col("volume")).alias("volume")
    )
    p = resample.prepare_intraday_for_training(gaps, "1min", replace(TICK, block_rows=700), "US")
    return p.frame.withColumn("sequence_length", F.lit(p.sequence_length))


@query("i4_return_forecast_features", f"""{_INDICATORS}, r AS (
  SELECT *, (lead(close, 1) OVER w - close) / close * 100 AS return_1d, (lead(close, 2) OVER w - close) / close * 100 AS return_2d,
         (lead(close, 3) OVER w - close) / close * 100 AS return_3d FROM ind WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, ts, close, {R("relative_volume")} AS relative_volume, {R("intraday_momentum")} AS intraday_momentum,
       {R("rsi_14")} AS rsi_14, {R("bb_position")} AS bb_position, {R("return_1d")} AS return_1d, {R("return_2d")} AS return_2d,
       {R("return_3d")} AS return_3d FROM r WHERE return_3d IS NOT NULL""")
def i4(spark, sf):
    from panelwright.operators.forecast import return_forecast_features

    return rounded(return_forecast_features(bars(spark, sf), BAR, (1, 2, 3)))
