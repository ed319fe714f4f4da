"""Queries over calendars, store sales, scalers, encoders and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.registry import R, query, rounded
from panelwright.catalog.views import (
    BAR, BARS_SQL, SALES_SQL, STORE, STORE_DAILY_SQL, bars, store_daily, store_dim, table,
)
from panelwright.functions import arithmetic, calendar
from panelwright.operators import encode, profile, sales, scale
from panelwright.plans.lookup import key_lookup
from panelwright.plans.quantiles import exact_quantiles

# --- calendar -----------------------------------------------------------------------------

_PART_SQL = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)",
    "dayofweek": "isodow(ts) - 1", "quarter": "quarter(ts)",
}


@query("h1_date_parts", "SELECT event_id, ts, " + ", ".join(f"CAST({e} AS INTEGER) AS {p}" for p, e in _PART_SQL.items()) + " FROM events")
def h1(spark, sf):
    return calendar.date_parts(table(spark, sf, "events").select("event_id", "ts"), "ts")


def _cycle_sql(parts):
    out = []
    for p in parts:
        angle = f"2 * pi() * ({_PART_SQL[p]}) / {calendar.PERIODS[p]}"
        out += [f"{R(f'sin({angle})')} AS {p}_sin", f"{R(f'cos({angle})')} AS {p}_cos"]
    return ", ".join(out)


@query("h2_cyclical_features", f"""SELECT event_id, ts, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
CAST(quarter(ts) AS INTEGER) AS quarter, {_cycle_sql(["month", "dayofweek", "quarter"])},
CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events""")
def h2(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return rounded(calendar.cyclical_features(e, "ts", ["month", "dayofweek", "quarter"]))


@query("h3_date_features", f"""SELECT event_id, ts, {_cycle_sql(["month", "day", "dayofweek", "hour", "minute"])},
CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events""")
def h3(spark, sf):
    return rounded(calendar.date_features(table(spark, sf, "events").select("event_id", "ts"), "ts", has_time=True))


_LAST = f"{BARS_SQL}, l AS (SELECT event_type, max(ts) AS last_ts FROM bars GROUP BY 1)"


@query("h14_future_timestamps", f"""WITH {_LAST}, s AS (SELECT unnest(range(1, 6)) AS i), d AS (SELECT unnest(range(1, 12)) AS i), b AS (
  SELECT event_type, last_ts, last_ts + to_days(CAST(i AS INTEGER)) AS t FROM l, d WHERE isodow(last_ts + to_days(CAST(i AS INTEGER))) < 6)
SELECT 'bar' AS kind, event_type, last_ts, last_ts + to_hours(i) AS future_ts, CAST(i AS INTEGER) AS step FROM l, s
UNION ALL SELECT 'calendar_day', event_type, last_ts, last_ts + to_days(CAST(i AS INTEGER)), CAST(i AS INTEGER) FROM l, s
UNION ALL SELECT * FROM (SELECT 'business_day', event_type, last_ts, t,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY t) AS INTEGER) AS step FROM b) WHERE step <= 5""")
def h14(spark, sf):
    last = bars(spark, sf).groupBy("event_type").agg(F.max("ts").alias("last_ts"))
    out = None
    for kind in ("bar", "calendar_day", "business_day"):
        part = calendar.future_timestamps(last, "last_ts", 5, kind, 3600).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


# --- store sales --------------------------------------------------------------------------


def _months_sql(year, month):
    m = f"coalesce(CAST({month} AS INTEGER), 1)"
    gap = f"(year(Date) - CAST({year} AS INTEGER)) * 12 + month(Date) - {m}"
    return f"CAST(CASE WHEN {year} IS NULL OR {m} NOT BETWEEN 1 AND 12 THEN 999 WHEN {gap} < 0 THEN 0 ELSE {gap} END AS INTEGER)"


_COMPETITION = _months_sql("CompetitionOpenSinceYear", "CompetitionOpenSinceMonth")
_PROMO2 = _months_sql("Promo2SinceYear", "Promo2SinceWeek")
_IN_PROMO = "CASE WHEN list_contains(string_split(PromoInterval, ','), strftime(Date, '%b')) THEN 1 ELSE 0 END"
_MERGED = f"{SALES_SQL}, merged AS (SELECT * FROM store_daily LEFT JOIN store_dim USING (Store))"


def _merged(spark, sf):
    return sales.merge_store_data(store_daily(spark, sf), store_dim(spark, sf))


@query("c1_merge_store_data", f"WITH {_MERGED} SELECT * FROM merged")
def c1(spark, sf):
    return _merged(spark, sf)


@query("d8_impute_distance", f"""WITH {_MERGED}, f AS (SELECT quantile_cont(CompetitionDistance, 0.5) AS q, max(CompetitionDistance) AS m FROM merged)
SELECT Store, Date, coalesce(CompetitionDistance, q) AS by_median, coalesce(CompetitionDistance, m) AS by_max,
       coalesce(CompetitionDistance, 0.0) AS by_zero FROM merged, f""")
def d8(spark, sf):
    merged = _merged(spark, sf).select("Store", "Date", "CompetitionDistance")
    out = merged
    for method, name in (("median", "by_median"), ("max", "by_max"), ("zero", "by_zero")):
        fill = sales.distance_fill(merged, method)
        out = sales.impute_distance(out.withColumn(name, F.col("CompetitionDistance")), fill, name)
    return out.drop("CompetitionDistance")


@query("h4_months_since", f"WITH {_MERGED} SELECT Store, Date, {_COMPETITION} AS competition, {_PROMO2} AS promo2 FROM merged")
def h4(spark, sf):
    return _merged(spark, sf).select(
        "Store", "Date",
        arithmetic.months_since("CompetitionOpenSinceYear", "CompetitionOpenSinceMonth", "Date").alias("competition"),
        arithmetic.months_since("Promo2SinceYear", "Promo2SinceWeek", "Date").alias("promo2"),
    )


@query("h5_promo_month", f"""WITH {_MERGED}
SELECT Store, Date, {_IN_PROMO} AS plain,
       CASE WHEN list_contains(string_split(replace(PromoInterval, 'Sept', 'Sep'), ','), strftime(Date, '%b')) THEN 1 ELSE 0 END AS aliased
FROM merged""")
def h5(spark, sf):
    return _merged(spark, sf).select(
        "Store", "Date",
        arithmetic.in_promo_month("PromoInterval", "Date").alias("plain"),
        arithmetic.in_promo_month("PromoInterval", "Date", {"Sept": "Sep"}).alias("aliased"),
    )


def _dummies(column, values):
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS {column}_{v}" for v in values)


_ALL_DUMMIES = ", ".join([_dummies("StateHoliday", "0abc"), _dummies("StoreType", "abcd"), _dummies("Assortment", "abc")])
CATEGORIES = {"StateHoliday": list("0abc"), "StoreType": list("abcd"), "Assortment": list("abc")}


@query("h6_one_hot", f"WITH {_MERGED} SELECT Store, Date, {_ALL_DUMMIES} FROM merged")
def h6(spark, sf):
    merged = _merged(spark, sf).select("Store", "Date", *CATEGORIES)
    fitted = {c: encode.categories_of(merged, c) for c in CATEGORIES}
    return encode.one_hot(merged, fitted)


@query("h6_one_hot_vector", """WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT p_name || '/' || p_type AS label FROM part WHERE p_partkey % 3 <> 0))
SELECT p_partkey, CAST((SELECT count(*) FROM l) + 1 AS INTEGER) AS size, CAST(1 AS INTEGER) AS ones,
       CAST(coalesce(code, (SELECT count(*) FROM l)) AS INTEGER) AS position FROM part LEFT JOIN l ON p_name || '/' || p_type = label""")
def h6_vector(spark, sf):
    """More categories than there could be columns; those that were not fitted share a position."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_type").alias("article"))
    labels = encode.fit_labels(part.filter("p_partkey % 3 <> 0"), ["article"])
    out = encode.one_hot_vector(part, labels, "article", "vector")
    # a sparse vector's text: (size,[positions],[values])
    text = F.col("vector").cast("string")
    part_of = lambda pattern: F.regexp_extract(text, pattern, 1)
    return out.select(
        "p_partkey", part_of(r"^\((\d+),").cast("int").alias("size"), F.size(F.split(part_of(r",\[([^\]]*)\],"), ",")).alias("ones"),
        part_of(r",\[(\d+)").cast("int").alias("position"),
    )


@query("h7_intraday_momentum", f"""WITH {BARS_SQL}
SELECT event_type, ts, {R("CASE WHEN open = 0 AND close = open THEN 0 ELSE (close - open) / open END")} AS intraday_momentum FROM bars""")
def h7(spark, sf):
    return rounded(bars(spark, sf).select("event_type", "ts", arithmetic.intraday_momentum("open", "close").alias("intraday_momentum")))


_MEDIAN = "(SELECT quantile_cont(CompetitionDistance, 0.5) FROM merged)"


@query("h8_competition_features", f"""WITH {_MERGED}
SELECT Store, Date, coalesce(CompetitionDistance, {_MEDIAN}) AS CompetitionDistance, {_COMPETITION} AS MonthsSinceCompetition FROM merged""")
def h8(spark, sf):
    out = sales.competition_features(_merged(spark, sf), sales.SalesConfig())
    return out.select("Store", "Date", "CompetitionDistance", "MonthsSinceCompetition")


@query("h9_promotion_features", f"WITH {_MERGED} SELECT Store, Date, {_PROMO2} AS MonthsSincePromo2, {_IN_PROMO} AS IsPromoMonth FROM merged")
def h9(spark, sf):
    out = sales.promotion_features(_merged(spark, sf), sales.SalesConfig())
    return out.select("Store", "Date", "MonthsSincePromo2", "IsPromoMonth")


_QUIET = "CASE WHEN day(Date) % 10 = 0 THEN 0 ELSE Customers END"


@query("h10_sales_per_customer", f"""WITH {STORE_DAILY_SQL}, q AS (SELECT Store, Date, Sales, {_QUIET} AS Customers FROM store_daily)
SELECT *, Sales / CASE WHEN Customers = 0 THEN 1 ELSE Customers END AS SalesPerCustomer,
       CASE WHEN Customers > 0 THEN 1 ELSE 0 END AS HasCustomerData FROM q""")
def h10(spark, sf):
    quiet = F.when(F.dayofmonth("Date") % 10 == 0, 0).otherwise(F.col("Customers"))
    d = store_daily(spark, sf).select("Store", "Date", "Sales", quiet.alias("Customers"))
    return sales.domain_features(d, sales.SalesConfig())


@query("h11_store_preprocess", f"""WITH {_MERGED}
SELECT Store, Date, Sales, Customers, DayOfWeek, Open, Promo, SchoolHoliday, Region,
       coalesce(CompetitionDistance, {_MEDIAN}) AS CompetitionDistance,
       coalesce(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth, coalesce(CompetitionOpenSinceYear, 0) AS CompetitionOpenSinceYear,
       Promo2, coalesce(Promo2SinceWeek, 0.0) AS Promo2SinceWeek, coalesce(Promo2SinceYear, 0.0) AS Promo2SinceYear,
       coalesce(PromoInterval, '0') AS PromoInterval, {_COMPETITION} AS MonthsSinceCompetition, {_PROMO2} AS MonthsSincePromo2,
       {_IN_PROMO} AS IsPromoMonth, {_ALL_DUMMIES}, Sales / CASE WHEN Customers = 0 THEN 1 ELSE Customers END AS SalesPerCustomer,
       CASE WHEN Customers > 0 THEN 1 ELSE 0 END AS HasCustomerData FROM merged WHERE Open = 1""")
def h11(spark, sf):
    return sales.store_preprocess(store_daily(spark, sf), store_dim(spark, sf), sales.SalesConfig(), categories=CATEGORIES)


@query("h24_distance_bins", f"""WITH {_MERGED}, f AS (SELECT *, coalesce(CompetitionDistance, {_MEDIAN}) AS d, {_COMPETITION} AS m FROM merged)
SELECT Store, Date, CAST(CASE WHEN d >= 50000 THEN 4 WHEN d >= 10000 THEN 3 WHEN d >= 5000 THEN 2 WHEN d >= 1000 THEN 1
       WHEN d >= 0 THEN 0 END AS INTEGER) AS CompetitionDistanceBin, d * m AS CompetitionDistanceXMonths FROM f""")
def h24(spark, sf):
    config = sales.SalesConfig(distance_bins=(0, 1000, 5000, 10000, 50000), distance_interaction=True)
    out = sales.competition_features(_merged(spark, sf), config)
    return out.select("Store", "Date", "CompetitionDistanceBin", "CompetitionDistanceXMonths")


# --- scalers ------------------------------------------------------------------------------

_SCALES = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "maxabs": ("0.0", "max(abs({c}))"),
    "onlymax": ("0.0", "max({c})"),
}
_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scaler_sql(kind):
    center, width = _SCALES[kind]
    parts = []
    for c in _LINE_COLUMNS:
        w = width.format(c=c)
        parts.append(
            f"""SELECT l_returnflag, l_linestatus, '{c}' AS "column", {R(center.format(c=c), 4)} AS center,
 {R(f"CASE WHEN {w} = 0 THEN 1.0 ELSE {w} END", 4)} AS scale FROM lineitem GROUP BY 1, 2"""
        )
    return " UNION ALL ".join(parts)


for _id, _kind in (("d2a", "standard"), ("d2b", "minmax"), ("d2c", "robust"), ("d2d", "maxabs"), ("d2e", "onlymax")):

    def _scaler(spark, sf, kind=_kind):
        li = table(spark, sf, "lineitem")
        model = scale.fit_scaler(li, kind, _LINE_COLUMNS, ["l_returnflag", "l_linestatus"])
        return rounded(model.long(), 4)

    query(f"{_id}_fit_scaler_{_kind}", _scaler_sql(_kind))(_scaler)


@query("d2a_fit_scaler_global", f"""SELECT 'Sales' AS "column", {R("avg(Sales)", 2)} AS center, {R("stddev_pop(Sales)", 2)} AS scale
FROM store_daily UNION ALL SELECT 'Customers', {R("avg(Customers)", 2)}, {R("stddev_pop(Customers)", 2)} FROM store_daily"""
       .replace("SELECT 'Sales'", f"WITH {STORE_DAILY_SQL} SELECT 'Sales'", 1))
def d2_global(spark, sf):
    return rounded(scale.fit_scaler(store_daily(spark, sf), "standard", ["Sales", "Customers"]).long(), 2)


_STANDARD_CTE = f"""{STORE_DAILY_SQL}, p AS (SELECT Store, avg(Sales) AS m, stddev_pop(Sales) AS s FROM store_daily GROUP BY 1), z AS (
  SELECT d.Store, Date, Sales, m, CASE WHEN s = 0 THEN 1.0 ELSE s END AS s FROM store_daily d JOIN p USING (Store))"""


@query("c2_scaler_lookup", f"WITH {_STANDARD_CTE} SELECT Store, Date, {R('m', 2)} AS Sales__center, {R('s', 2)} AS Sales__scale FROM z")
def c2(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    model = scale.fit_scaler(d, "standard", ["Sales"], ["Store"]).materialize()
    return rounded(model.attach(d).drop("Sales"), 2)


@query("e17_scale", f"WITH {_STANDARD_CTE} SELECT Store, Date, {R('(Sales - m) / s')} AS Sales FROM z")
def e17(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    return rounded(scale.fit_scaler(d, "standard", ["Sales"], ["Store"]).materialize().transform(d))


@query("e17_inverse_scale", f"""WITH {STORE_DAILY_SQL}, q AS (
  SELECT Store, quantile_cont(Sales, 0.5) AS m, quantile_cont(Sales, 0.75) - quantile_cont(Sales, 0.25) AS s FROM store_daily GROUP BY 1)
SELECT d.Store, Date, {R('(Sales - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS Scaled, {R('Sales', 3)} AS Sales
FROM store_daily d JOIN q ON d.Store = q.Store""")
def e17_inverse(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    model = scale.fit_scaler(d, "robust", ["Sales"], ["Store"]).materialize()
    there = model.transform(d).withColumn("Scaled", F.round("Sales", 6))
    return model.inverse(there, {"Sales": "Sales"}).withColumn("Sales", F.round("Sales", 3))


@query("e17_scale_global", f"""WITH {STORE_DAILY_SQL}, p AS (SELECT min(Sales) AS lo, max(Sales) AS hi FROM store_daily)
SELECT Store, Date, {R("(Sales - lo) / (hi - lo)")} AS Sales FROM store_daily, p""")
def e17_global(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    return rounded(scale.fit_scaler(d, "minmax", ["Sales"]).transform(d))


# --- encoders and profiles ----------------------------------------------------------------


def _codes_sql(column, source):
    return f"""(SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM
 (SELECT DISTINCT coalesce(CAST({column} AS VARCHAR), 'nan') AS label FROM {source}))"""


@query("h13_label_encode", f"""SELECT p_partkey, b.code AS p_brand_code, t.code AS p_type_code, s.code AS p_size_code
FROM part JOIN {_codes_sql("p_brand", "part")} b ON p_brand = b.label JOIN {_codes_sql("p_type", "part")} t ON p_type = t.label
JOIN {_codes_sql("p_size", "part")} s ON CAST(p_size AS VARCHAR) = s.label""")
def h13(spark, sf):
    part = table(spark, sf, "part")
    labels = encode.fit_labels(part, ["p_brand", "p_type", "p_size"])
    out = labels.encode(part)
    return out.select("p_partkey", "p_brand_code", "p_type_code", "p_size_code")


@query("h13_label_encode_large", f"""SELECT c_custkey, b.code AS c_name_code, m.code AS c_mktsegment_code FROM customer
JOIN {_codes_sql("c_name", "customer")} b ON c_name = b.label JOIN {_codes_sql("c_mktsegment", "customer")} m ON c_mktsegment = m.label""")
def h13_large(spark, sf):
    """A dictionary as large as its table, numbered in range partitions."""
    customer = table(spark, sf, "customer")
    labels = encode.fit_labels(customer, ["c_name", "c_mktsegment"])
    return labels.encode(customer).select("c_custkey", "c_name_code", "c_mktsegment_code")


@query("c4_label_map", f"""SELECT p_partkey, p_brand AS decoded, code AS p_brand_code FROM part
JOIN {_codes_sql("p_brand", "part")} b ON p_brand = b.label""")
def c4(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    labels = encode.fit_labels(part, ["p_brand"])
    coded = labels.encode(part)
    return labels.decode(coded, "p_brand", "p_brand_code", "decoded").drop("p_brand")


@query("h12_group_key", """WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)
SELECT l_returnflag || '|' || l_linestatus AS group_key, count(*) AS rows FROM lineitem GROUP BY 1""")
def h12(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", encode.group_code(["l_returnflag", "l_linestatus"]))
    per_key = li.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    return per_key.select(F.concat_ws("|", "k.l_returnflag", "k.l_linestatus").alias("group_key"), "rows")


_NULLED = "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS p_type FROM part"


@query("h20_encode_with_null_code", f"""WITH p AS ({_NULLED}), c AS (
  SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type FROM p WHERE p_type IS NOT NULL))
SELECT p_partkey, coalesce(code, (SELECT CAST(count(*) AS INTEGER) FROM c)) AS p_type_code FROM p LEFT JOIN c USING (p_type)""")
def h20(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("p_type"))
    labels = encode.fit_labels(part, ["p_type"], null_label=None)
    return labels.encode(part, unseen="keep").select("p_partkey", "p_type_code")


@query("g2_unseen_labels", """SELECT 'customer' AS "column", CAST(c_custkey AS VARCHAR) AS label FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def g2(spark, sf):
    """Customers unknown to a map fitted on urgent pending orders."""
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    known = encode.fit_labels(orders.select(F.col("o_custkey").alias("customer")), ["customer"])
    return known.unseen(table(spark, sf, "customer").select(F.col("c_custkey").alias("customer")))


@query("d9_cardinality", """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS categories FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part""")
def d9(spark, sf):
    return profile.cardinality(table(spark, sf, "part"), ["p_brand", "p_type", "p_size", "p_name"])


_PROFILED = {
    "l_returnflag": "text", "l_linestatus": "text", "l_linenumber": "int", "l_suppkey": "int", "l_quantity": "real",
    "l_discount": "real", "l_extendedprice": "real",
}


def _profile_sql():
    parts = []
    for c, kind in _PROFILED.items():
        n = f"count(DISTINCT {c})"
        shown = n
        if kind == "text":
            label = "'categorical'"
        else:
            few = f"{n} BETWEEN 1 AND 20" + (f" AND NOT (max({c}) - min({c}) > {n} * 10)" if kind == "int" else "")
            label, shown = f"CASE WHEN {few} THEN 'categorical' ELSE 'numeric' END", f"CASE WHEN {few} THEN {n} END"
        parts.append(f"""SELECT '{c}' AS "column", {label} AS kind, {shown} AS categories FROM lineitem""")
    for f in ("sin", "cos"):
        angle = "2 * pi() * month(l_shipdate) / 12"
        parts.append(
            f"""SELECT 'month_{f}', 'seasonal', least(count(DISTINCT round({f}({angle}), 4) + 0.0), 100) FROM lineitem"""
        )
    return " UNION ALL ".join(parts)


def _profiled(spark, sf):
    li = table(spark, sf, "lineitem").select("l_shipdate", *_PROFILED)
    return calendar.cyclical_features(li, "l_shipdate", ["month"], keep_parts=False)


@query("d10_profile_features", _profile_sql())
def d10(spark, sf):
    return profile.profile_features(_profiled(spark, sf), exclude=["l_shipdate"])


@query("d11_seasonal_resolution", """SELECT count(DISTINCT (round(sin(2 * pi() * month(l_shipdate) / 12), 4) + 0.0,
round(cos(2 * pi() * month(l_shipdate) / 12), 4) + 0.0)) AS resolution FROM lineitem""")
def d11(spark, sf):
    sin, cos = profile.seasonal_pairs(["month_sin", "month_cos"])["month"]
    return profile.seasonal_resolution(_profiled(spark, sf), sin, cos)


_H, _A = "hour(ts)", "2 * pi() * hour(ts) / 24"


@query("h19_seasonal_bucket", f"""WITH a AS (SELECT event_id, {_A} + 0.01 AS x FROM events)
SELECT event_id, CAST(least(floor(((atan2(sin(x), cos(x)) + 2 * pi()) % (2 * pi())) / (2 * pi()) * 24), 23) AS INTEGER) AS hour_bucket,
       CAST(least(floor((sin(x) + 1) / 2 * 24), 23) AS INTEGER) AS sin_bucket FROM a""")
def h19(spark, sf):
    # a small shift keeps whole hours off the bucket borders
    angle = F.hour("ts") * F.lit(2 * 3.141592653589793) / 24 + F.lit(0.01)
    e = table(spark, sf, "events").select("event_id", F.sin(angle).alias("s"), F.cos(angle).alias("c"))
    return e.select(
        "event_id",
        arithmetic.angle_bucket("s", "c", 24).alias("hour_bucket"),
        arithmetic.unit_bucket("s", 24).alias("sin_bucket"),
    )


@query("h21_prepare_categorical_inputs", f"""WITH a AS (SELECT event_id, event_type, {_A} + 0.01 AS x FROM events), c AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM events)), k AS (
  SELECT least(count(DISTINCT round(sin(x), 4)), 100) AS ks, least(count(DISTINCT round(cos(x), 4)), 100) AS kc FROM a)
SELECT event_id, code AS event_type_code, CAST(least(floor((sin(x) + 1) / 2 * ks), ks - 1) AS INTEGER) AS hour_sin_code,
       CAST(least(floor((cos(x) + 1) / 2 * kc), kc - 1) AS INTEGER) AS hour_cos_code FROM a JOIN c USING (event_type), k""")
def h21(spark, sf):
    angle = F.hour("ts") * F.lit(2 * 3.141592653589793) / 24 + F.lit(0.01)
    e = table(spark, sf, "events").select("event_id", "event_type", F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"))
    found = {r["column"]: r for r in profile.profile_features(e, exclude=["event_id"]).collect()}
    categorical = {c: int(r["categories"]) for c, r in found.items() if r["kind"] != "numeric"}
    seasonal = [c for c, r in found.items() if r["kind"] == "seasonal"]
    labels = encode.fit_labels(e, [c for c in categorical if c not in seasonal], null_label=None)
    out = encode.categorical_inputs(e, categorical, seasonal, labels)
    return out.select("event_id", "event_type_code", "hour_sin_code", "hour_cos_code")


@query("d2c_exact_quantiles", f"""SELECT l_returnflag, 'l_extendedprice' AS "column", unnest([0.1, 0.5, 0.9])::DOUBLE AS probability,
{R("unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]))", 4)} AS value FROM lineitem GROUP BY 1""".replace(
    "(round(CAST(unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS DOUBLE), 4) + 0.0)",
    "unnest(list_transform(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]), lambda q: round(q, 4) + 0.0))"))
def d2_quantiles(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_extendedprice"], [0.1, 0.5, 0.9])
    return rounded(q, 4)
