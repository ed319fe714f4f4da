"""Queries that write the given tables as raw files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.registry import query
from panelwright.catalog.views import SALES_SQL, STORE_DAILY_SQL, TICK, TICKS_SQL, store_daily, store_dim, table, ticks
from panelwright.operators import clean
from panelwright.session import new_table_path
from panelwright.sources import readers
from panelwright.sources.cache import materialize
from panelwright.sources.sinks import write_csv
from panelwright.spec import PanelSpec


def _as_csv(df, name):
    path = new_table_path(df.sparkSession, name)
    write_csv(df, path)
    return path


@query("a1_read_time_series", """SELECT date, event_type, value FROM (
  SELECT ts AS date, event_type, CASE WHEN event_id % 31 <> 0 THEN value END AS value FROM events)""")
def a1(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.col("ts").alias("date"), "event_type", F.when(F.col("event_id") % 31 != 0, F.col("value")).alias("value"))
    path = _as_csv(raw, "series")
    return readers.read_time_series(spark, path, "date", "date string, event_type string, value double")


@query("a1_read_parquet", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate, o_totalprice FROM orders")
def a1_parquet(spark, sf):
    out = readers.read_time_series(spark, f"{sf}/orders.parquet", "o_orderdate")
    return out.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("a2_read_ohlcv_daily", """WITH d AS (
  SELECT event_type AS symbol, date_trunc('day', ts) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 2) AS turnover
  FROM events GROUP BY 1, 2)
SELECT * FROM d WHERE day(date) % 7 <> 0""")
def a2(spark, sf):
    e = table(spark, sf, "events")
    order = F.struct("ts", "event_id")
    day = e.groupBy(F.col("event_type").alias("Symbol"), F.col("ts").cast("date").alias("Datetime")).agg(
        F.min_by("value", order).alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"),
        F.max_by("value", order).alias("Close"), F.count(F.lit(1)).alias("Volume"), F.round(F.sum("value"), 2).alias("Turnover"),
    )
    # unreadable closes on every seventh day, and a column of words
    words = F.when(F.dayofmonth("Datetime") % 7 == 0, F.lit("n/a")).otherwise(F.col("Close").cast("string"))
    raw = day.withColumn("Close", words).withColumn("Comment", F.concat(F.lit("day of "), F.col("Symbol")))
    path = _as_csv(raw, "daily")
    schema = ", ".join(f"{c} string" for c in raw.columns)
    return readers.read_ohlcv_daily(spark, path, "date", "Symbol", schema)


@query("a3_read_ohlcv_intraday", f"""WITH {TICKS_SQL}
SELECT event_type, ts AS timestamp, event_id, open, high, low, close, volume FROM ticks WHERE close > 0
QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1""")
def a3(spark, sf):
    """Offsets in the file, other column names, validation on."""
    local = F.date_format(F.col("ts") + F.expr("INTERVAL '330' MINUTE"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    t = ticks(spark, sf).select(
        "event_type", F.concat(local, F.lit("+05:30")).alias("Datetime"), "event_id", F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Vol"),
    )
    path = _as_csv(t, "minutes")
    schema = "event_type string, Datetime string, event_id long, Open double, High double, Low double, Close double, Vol long"
    spec = PanelSpec("timestamp", ("event_type",), ("event_id",), step=60)
    return readers.read_ohlcv_intraday(spark, path, spec, schema=schema)


# Forms in which the mixed file writes its times, with their DuckDB counterparts.
MIXED = [("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"), ("MM-dd-yyyy HH:mm:ss", "%m-%d-%Y %H:%M:%S"), ("yyyyMMdd HHmmss", "%Y%m%d %H%M%S")]


@query("a3_read_mixed_formats", f"""WITH written AS (
  SELECT event_id, event_type, value, CASE event_id % 4 {" ".join(f"WHEN {k} THEN strftime(ts, '{d}')" for k, (_, d) in enumerate(MIXED))}
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS text FROM events)
SELECT event_id, event_type AS symbol, CASE event_id % 4 {" ".join(f"WHEN {k} THEN strptime(text, '{d}')" for k, (_, d) in enumerate(MIXED))}
       ELSE strptime(text, '%Y-%m-%d %H:%M:%S') END AS timestamp, value AS close FROM written""")
def a3_mixed(spark, sf):
    """Day first with slashes, month first with dashes, digits alone, and ISO, in one column."""
    forms = [F.when(F.col("event_id") % 4 == k, F.date_format("ts", f)) for k, (f, _) in enumerate(MIXED)]
    raw = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("Symbol"), F.coalesce(*forms, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Datetime"),
        F.col("value").alias("Close"),
    )
    path = _as_csv(raw, "mixed")
    spec = PanelSpec("timestamp", ("symbol",), ("event_id",), step=60)
    schema = "event_id long, Symbol string, Datetime string, Close double"
    return readers.read_ohlcv_intraday(spark, path, spec, validate=False, schema=schema, formats=[f for f, _ in MIXED])


@query("a4_read_sales_tables", f"""WITH {SALES_SQL}
SELECT 'train' AS part, count(*) AS rows, count(DISTINCT Store) AS stores FROM store_daily WHERE Date < DATE '2001-01-01'
UNION ALL SELECT 'test', count(*), count(DISTINCT Store) FROM store_daily WHERE Date >= DATE '2001-01-01'
UNION ALL SELECT 'store', count(*), count(DISTINCT Store) FROM store_dim""")
def a4(spark, sf):
    d, cut = store_daily(spark, sf), F.lit("2001-01-01").cast("timestamp_ntz")
    folder = new_table_path(spark, "sales")
    parts = {"train": d.filter(F.col("Date") < cut), "test": d.filter(F.col("Date") >= cut).drop("Sales"), "store": store_dim(spark, sf)}
    for name, part in parts.items():
        write_csv(part, f"{folder}/{name}.csv")
    out = None
    for name, part in zip(parts, readers.read_sales_tables(spark, folder)):
        one = part.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("Store").alias("stores")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("a5_materialize", f"""WITH {STORE_DAILY_SQL}
SELECT Store, Date, Sales, Date >= DATE '2001-01-01' AS is_test FROM store_daily WHERE Open = 1""")
def a5(spark, sf):
    """Built once; the second call must read the stored tables, so it gets no builder."""
    base = new_table_path(spark, "datasets")
    config = {"version": "baseline_v1", "cache": {"enabled": True}}

    def build():
        d = clean.filter_rows(store_daily(spark, sf)).select("Store", "Date", "Sales")
        test = F.col("Date") >= F.lit("2001-01-01").cast("timestamp_ntz")
        return {"train": d.filter(~test), "test": d.filter(test)}

    def never():
        raise AssertionError("the stored tables should have been used")

    materialize(spark, base, config, build)
    again = materialize(spark, base, config, never)
    return again["train"].withColumn("is_test", F.lit(False)).unionByName(again["test"].withColumn("is_test", F.lit(True)))


@query("h18_normalize_names", """SELECT l_orderkey AS id, l_linenumber AS line, l_shipdate::TIMESTAMP AS timestamp,
l_extendedprice AS close, l_quantity AS volume FROM lineitem""")
def h18(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ID"), F.col("l_linenumber").alias("LINE"), F.col("l_shipdate").cast("timestamp_ntz").alias("Datetime"),
        F.col("l_extendedprice").alias("Close"), F.col("l_quantity").alias("Vol"),
    )
    return readers.normalize_names(readers.normalize_names(li, readers.INTRADAY_NAMES), lower=True)


@query("h22_utc_naive", """SELECT event_id, ts AS from_instant, ts AS from_text FROM events""")
def h22(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    local = F.date_format(F.col("ts") - F.expr("INTERVAL '5' HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned = e.select("event_id", F.col("ts").cast("timestamp").alias("from_instant"), F.concat(local, F.lit("-05:00")).alias("from_text"))
    return readers.as_time(readers.as_time(zoned, "from_instant"), "from_text")
