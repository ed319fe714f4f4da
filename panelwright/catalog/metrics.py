"""Queries over predictions, errors, metrics and the experiment log."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.registry import R, query, rounded
from panelwright.catalog.views import STORE, STORE_DAILY_SQL, store_daily
from panelwright.functions import arithmetic
from panelwright.operators import evaluate as ev
from panelwright.operators import experiments as ex
from panelwright.operators import targets
from panelwright.plans.blocks import Feature, over_blocks
from panelwright.session import new_table_path
from panelwright.sources import sinks
from panelwright.sources.bucketed import read_bucketed, write_forecasts

HORIZON, BUCKETS = 3, 8


def shifted(spark, sf):
    d = store_daily(spark, sf).select("Store", "Date", "Sales")
    return targets.shift_targets(d, STORE, "Sales", HORIZON)


def aligned(spark, sf):
    """Persistence forecast of the next three days joined with what came."""
    s = shifted(spark, sf)
    predicted = ev.persistence_forecast(s, STORE, ["Sales"], HORIZON)
    return ev.align(predicted, ev.actuals_long(s, STORE, ["Sales"], HORIZON), STORE)


ALIGNED_SQL = f"""{STORE_DAILY_SQL}, shifted AS (
  SELECT * FROM (SELECT Store, Date, Sales, lead(Sales, 1) OVER w AS h1, lead(Sales, 2) OVER w AS h2, lead(Sales, 3) OVER w AS h3
    FROM store_daily WINDOW w AS (PARTITION BY Store ORDER BY Date)) WHERE h3 IS NOT NULL), aligned AS (
  SELECT Store, Date, 'Sales' AS target, CAST(1 AS INTEGER) AS horizon, Sales AS prediction, h1 AS actual FROM shifted
  UNION ALL SELECT Store, Date, 'Sales', 2, Sales, h2 FROM shifted UNION ALL SELECT Store, Date, 'Sales', 3, Sales, h3 FROM shifted), hits AS (
  SELECT *, CAST((actual - lag(actual) OVER v > 0) = (prediction - lag(prediction) OVER v > 0) AS INTEGER) AS direction_hit
  FROM aligned WINDOW v AS (PARTITION BY Store, target, horizon ORDER BY Date))"""

_METRICS_SQL = f"""{R("avg(abs(actual - prediction))", 2)} AS "MAE", {R("avg((actual - prediction) ** 2)", -1)} AS "MSE",
 {R("sqrt(avg((actual - prediction) ** 2))", 2)} AS "RMSE",
 {R("avg(CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) END) * 100")} AS "MAPE",
 {R("1 - sum((actual - prediction) ** 2) / (var_pop(actual) * count(*))")} AS "R2",
 {R("avg(direction_hit) * 100")} AS "Directional_Accuracy" """


def _tidy(df):
    digits = {"MAE": 2, "MSE": -1, "RMSE": 2}
    return df.withColumns({c: F.round(c, digits.get(c, 6)) for c in (*ev.METRICS, "RMSPE") if c in df.columns})


@query("c3_align", f"WITH {ALIGNED_SQL} SELECT * FROM aligned")
def c3(spark, sf):
    return aligned(spark, sf)


@query("c3_align_written", f"""WITH {STORE_DAILY_SQL}, m AS (
  SELECT Store, Date, avg(Sales) OVER (PARTITION BY Store ORDER BY Date ROWS 6 PRECEDING) AS prediction FROM store_daily),
 p AS (SELECT Store, Date, CAST(h AS INTEGER) AS horizon, prediction FROM m, (SELECT unnest([1, 2, 3]) AS h) WHERE year(Date) = 2000 OR Store = 7),
 a AS (SELECT Store, Date, CAST(h AS INTEGER) AS horizon, actual FROM (
  SELECT Store, Date, lead(Sales, 1) OVER w AS a1, lead(Sales, 2) OVER w AS a2, lead(Sales, 3) OVER w AS a3 FROM store_daily
  WINDOW w AS (PARTITION BY Store ORDER BY Date)), LATERAL (VALUES (1, a1), (2, a2), (3, a3)) AS v(h, actual) WHERE actual IS NOT NULL AND a3 IS NOT NULL)
SELECT Store, Date, 'Sales' AS target, horizon, {R("prediction")} AS prediction, actual FROM p JOIN a USING (Store, Date, horizon)""")
def c3_written(spark, sf):
    """Predictions that another job wrote, read back and aligned with the written actual values."""
    base, d = new_table_path(spark, "forecasts"), store_daily(spark, sf).select("Store", "Date", "Sales")
    mean = Feature(lambda x, w: x.withColumn("mean", F.avg("Sales").over(w.trailing(7))), before=6)
    some = over_blocks(d, STORE, mean).filter((F.year("Date") == 2000) | (F.col("Store") == 7))
    predicted = ev.persistence_forecast(some.withColumn("Sales", F.col("mean")), STORE, ["Sales"], HORIZON)
    write_forecasts(predicted, f"{base}/predicted", STORE, BUCKETS)
    write_forecasts(ev.actuals_long(shifted(spark, sf), STORE, ["Sales"], HORIZON), f"{base}/actual", STORE, BUCKETS)
    return rounded(ev.align(read_bucketed(spark, f"{base}/predicted"), read_bucketed(spark, f"{base}/actual"), STORE))


@query("e12_directional_accuracy", f"WITH {ALIGNED_SQL} SELECT * FROM hits")
def e12(spark, sf):
    return ev.with_direction(aligned(spark, sf), STORE)


@query("d3_regression_metrics", f"WITH {ALIGNED_SQL} SELECT {_METRICS_SQL} FROM hits")
def d3(spark, sf):
    return _tidy(ev.regression_metrics(ev.with_direction(aligned(spark, sf), STORE)))


_LEVELS = f"""SELECT target, CASE WHEN grouping(horizon) = 1 THEN 'overall' ELSE CAST(horizon AS VARCHAR) END AS horizon,
 CASE WHEN grouping(Store) = 1 THEN 'overall' ELSE CAST(Store AS VARCHAR) END AS Store, {_METRICS_SQL}
 FROM hits GROUP BY GROUPING SETS ((target), (target, horizon), (target, Store), (target, horizon, Store))"""


@query("d4_metrics_by", f"WITH {ALIGNED_SQL} {_LEVELS}")
def d4(spark, sf):
    return _tidy(ev.metrics_by(ev.with_direction(aligned(spark, sf), STORE), ["Store"]))


@query("a7_flatten_metrics", f"""WITH {ALIGNED_SQL}, m AS ({_LEVELS})
SELECT 'test' AS dataset, Store AS "group", target, CASE WHEN horizon = 'overall' THEN horizon ELSE 'horizon_' || horizon END AS horizon,
       metric, value FROM (UNPIVOT m ON "MAE", "MSE", "RMSE", "MAPE", "R2", "Directional_Accuracy" INTO NAME metric VALUE value)""")
def a7(spark, sf):
    wide = _tidy(ev.metrics_by(ev.with_direction(aligned(spark, sf), STORE), ["Store"]))
    return ev.flatten_metrics(wide, "test", ["Store"])


_ZEROED = "(SELECT Store, Date, horizon, CASE WHEN day(Date) % 9 = 0 THEN 0.0 ELSE actual END AS actual, prediction FROM aligned)"


def _zeroed(spark, sf):
    a = F.when(F.dayofmonth("Date") % 9 == 0, F.lit(0.0)).otherwise(F.col("actual"))
    return aligned(spark, sf).select("Store", "Date", "horizon", a.alias("actual"), "prediction")


@query("d5_rmspe", f"""WITH {ALIGNED_SQL}, z AS {_ZEROED}
SELECT Store, horizon, {R("coalesce(sqrt(avg(CASE WHEN actual <> 0 THEN ((actual - prediction) / actual) ** 2 END)), 0)")} AS "RMSPE" FROM z GROUP BY 1, 2""")
def d5(spark, sf):
    return rounded(_zeroed(spark, sf).groupBy("Store", "horizon").agg(ev.rmspe("actual", "prediction").alias("RMSPE")))


@query("d6_sales_metrics", f"""WITH {ALIGNED_SQL}, z AS {_ZEROED}
SELECT horizon, {R("coalesce(sqrt(avg(CASE WHEN actual <> 0 THEN ((actual - prediction) / actual) ** 2 END)), 0)", 4)} AS "RMSPE",
       {R("coalesce(avg(CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) END) * 100, 0)", 4)} AS "MAPE",
       {R("sqrt(avg((actual - prediction) ** 2))", 2)} AS "RMSE", {R("avg(abs(actual - prediction))", 2)} AS "MAE" FROM z GROUP BY 1""")
def d6(spark, sf):
    out = _zeroed(spark, sf).groupBy("horizon").agg(*ev.sales_metrics())
    return out.withColumns({"RMSPE": F.round("RMSPE", 4), "MAPE": F.round("MAPE", 4), "RMSE": F.round("RMSE", 2), "MAE": F.round("MAE", 2)})


_ERRORS = f"""{R("actual - prediction", 2)} AS error, {R("abs(actual - prediction)", 2)} AS abs_error,
 {R("CASE WHEN actual = 0 THEN 0 ELSE (actual - prediction) / actual * 100 END")} AS pct_error"""


@query("h15_error_columns", f"WITH {ALIGNED_SQL}, z AS {_ZEROED} SELECT Store, Date, horizon, {_ERRORS} FROM z")
def h15(spark, sf):
    e = arithmetic.error_columns("actual", "prediction")
    out = _zeroed(spark, sf).select("Store", "Date", "horizon", *[c.alias(n) for n, c in e.items()])
    return out.withColumns({"error": F.round("error", 2), "abs_error": F.round("abs_error", 2), "pct_error": F.round("pct_error", 6)})


@query("h16_rmspe_contribution", f"""WITH {ALIGNED_SQL}, z AS {_ZEROED}
SELECT Store, Date, horizon, {R("CASE WHEN actual = 0 THEN 0 ELSE ((actual - prediction) / actual) ** 2 END")} AS contribution FROM z""")
def h16(spark, sf):
    c = arithmetic.rmspe_contribution("actual", "prediction").alias("contribution")
    return rounded(_zeroed(spark, sf).select("Store", "Date", "horizon", c))


@query("h17_clip_lower", f"""WITH {ALIGNED_SQL}
SELECT Store, Date, horizon, {R("CASE WHEN prediction - 100000 < 0 THEN 0 ELSE prediction - 100000 END", 2)} AS clipped FROM aligned""")
def h17(spark, sf):
    c = arithmetic.clip_lower(F.col("prediction") - 100000.0).alias("clipped")
    return rounded(aligned(spark, sf).select("Store", "Date", "horizon", c), 2)


# --- written predictions ------------------------------------------------------------------


def _read(spark, path, schema):
    return spark.read.schema(schema).option("header", True).csv(path)


@query("a6_write_predictions", f"""WITH {ALIGNED_SQL}
SELECT Store, Date, h1 AS "Sales_actual_h1", Sales AS "Sales_pred_h1", h2 AS "Sales_actual_h2", Sales AS "Sales_pred_h2",
       h3 AS "Sales_actual_h3", Sales AS "Sales_pred_h3" FROM shifted""")
def a6(spark, sf):
    a = aligned(spark, sf)
    path = new_table_path(spark, "predictions")
    sinks.write_predictions(a, path, STORE, ["Sales"], HORIZON, metrics=ev.regression_metrics(a))
    cols = ", ".join(f"Sales_actual_h{h} double, Sales_pred_h{h} double" for h in range(1, HORIZON + 1))
    return _read(spark, f"{path}/predictions", f"Store int, Date timestamp_ntz, {cols}")


_CUT = "2000-01-01"
_PARTS_SQL = f"""{ALIGNED_SQL}, one AS (SELECT Store, Date, horizon, actual, prediction FROM aligned)"""


def _parts(spark, sf):
    """Predictions of every horizon before and after a day."""
    one = aligned(spark, sf).select("Store", "Date", "horizon", "actual", "prediction")
    cut = F.lit(_CUT).cast("timestamp_ntz")
    return one.filter(F.col("Date") < cut), one.filter(F.col("Date") >= cut)


@query("a8_write_predictions_with_split", f"""WITH {_PARTS_SQL}
SELECT Store, Date, horizon, actual, prediction, CASE WHEN Date < DATE '{_CUT}' THEN 'train' ELSE 'test' END AS dataset,
       {R("abs(actual - prediction)", 2)} AS error, {R("CASE WHEN actual <> 0 THEN abs(actual - prediction) / actual * 100 END")} AS error_pct FROM one""")
def a8(spark, sf):
    train, test = _parts(spark, sf)
    path = new_table_path(spark, "predictions-split")
    sinks.write_predictions_with_split(train, test, path, STORE)
    schema = "Store int, Date timestamp_ntz, horizon int, actual double, prediction double, dataset string, error double, error_pct double"
    return _read(spark, path, schema).withColumns({"error": F.round("error", 2), "error_pct": F.round("error_pct", 6)})


@query("a9_write_combined_intraday", f"""WITH {_PARTS_SQL}
SELECT Store, Date, horizon, actual, prediction, CASE WHEN Date < DATE '{_CUT}' THEN 'train' ELSE 'validation' END AS data_split FROM one
UNION ALL SELECT Store, max(Date) + INTERVAL '1 day', NULL, NULL, arg_max(Sales, Date), 'future' FROM store_daily GROUP BY Store""")
def a9(spark, sf):
    train, validation = _parts(spark, sf)
    last = store_daily(spark, sf).groupBy("Store").agg(
        (F.max("Date") + F.expr("INTERVAL '1' DAY")).alias("Date"), F.max_by("Sales", "Date").alias("prediction")
    )
    path = new_table_path(spark, "combined")
    sinks.write_combined_intraday({"train": train, "validation": validation, "future": last}, path, ev.regression_metrics(train))
    schema = "Store int, Date timestamp_ntz, horizon int, actual double, prediction double, data_split string"
    return _read(spark, f"{path}/predictions", schema)


@query("a10_write_submission", """SELECT CAST(o_orderkey AS INTEGER) AS "Id",
round(CASE WHEN o_totalprice - 100000 < 0 THEN 0 ELSE o_totalprice - 100000 END, 2) AS "Sales" FROM orders""")
def a10(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("prediction", F.round(F.col("o_totalprice") - 100000.0, 2))
    path = new_table_path(spark, "submission")
    sinks.write_submission(orders, path, "o_orderkey")
    return _read(spark, path, "Id int, Sales double")


_SALES_ERRORS = f"""Store, Date, horizon, actual AS "Actual_Sales", prediction AS "Predicted_Sales", {R("actual - prediction", 2)} AS "Error",
 {R("abs(actual - prediction)", 2)} AS "Abs_Error", {R("CASE WHEN actual = 0 THEN 0 ELSE (actual - prediction) / actual * 100 END")} AS "Pct_Error" """
_ERROR_SCHEMA = "Store int, Date timestamp_ntz, horizon int, Actual_Sales double, Predicted_Sales double, Error double, Abs_Error double, Pct_Error double"


def _round_errors(df):
    digits = {"Error": 2, "Abs_Error": 2, "Pct_Error": 6, "RMSPE_Contribution": 6}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


@query("a11_write_errors", f"""WITH {_PARTS_SQL} SELECT {_SALES_ERRORS}, 'val' AS "Dataset" FROM one""")
def a11(spark, sf):
    one = aligned(spark, sf)
    path = new_table_path(spark, "errors")
    sinks.write_errors(one, path, ["Store", "Date", "horizon"], "val")
    return _round_errors(_read(spark, path, f"{_ERROR_SCHEMA}, Dataset string"))


@query("a12_write_errors_rmspe", f"""WITH {_PARTS_SQL} SELECT {_SALES_ERRORS},
 {R("CASE WHEN actual = 0 THEN 0 ELSE ((actual - prediction) / actual) ** 2 END")} AS "RMSPE_Contribution" FROM one""")
def a12(spark, sf):
    one = aligned(spark, sf)
    path = new_table_path(spark, "errors-rmspe")
    sinks.write_errors_rmspe(one, path, ["Store", "Date", "horizon"])
    return _round_errors(_read(spark, path, f"{_ERROR_SCHEMA}, RMSPE_Contribution double"))


@query("a13_combine_predictions", f"""WITH {_PARTS_SQL}, c AS (
  SELECT CASE WHEN Date < DATE '{_CUT}' THEN 'train' ELSE 'val' END AS "Dataset" FROM one)
SELECT "Dataset", count(*) AS rows FROM c GROUP BY 1""")
def a13(spark, sf):
    train, val = _parts(spark, sf)
    paths = {"train": new_table_path(spark, "train"), "val": new_table_path(spark, "val")}
    sinks.write_errors(train, paths["train"], ["Store", "Date"], "train")
    sinks.write_errors_rmspe(val, paths["val"], ["Store", "Date"])  # carries no Dataset label
    paths["test"] = new_table_path(spark, "never-written")
    return sinks.split_counts(sinks.combine_predictions(spark, paths))


@query("a15_write_metrics_json", f"""WITH {ALIGNED_SQL}, m AS ({_LEVELS}) SELECT 'exp_001' AS experiment_id, * FROM m""")
def a15(spark, sf):
    wide = _tidy(ev.metrics_by(ev.with_direction(aligned(spark, sf), STORE), ["Store"]))
    path = new_table_path(spark, "metrics")
    sinks.write_metrics_json(wide, path, experiment_id="exp_001")
    cols = ", ".join(f"{m} double" for m in ev.METRICS)
    return spark.read.schema(f"experiment_id string, target string, horizon string, Store string, {cols}").json(path)


# --- experiment log -----------------------------------------------------------------------


def experiments(spark, sf):
    """One experiment per store and horizon: the persistence forecast, trained before 2000."""
    a = aligned(spark, sf).withColumn("is_train", F.col("Date") < F.lit(_CUT).cast("timestamp_ntz"))
    train, val = F.col("is_train"), ~F.col("is_train")
    ab, sq = F.abs(F.col("actual") - F.col("prediction")), F.pow(F.col("actual") - F.col("prediction"), F.lit(2.0))
    pct = F.pow((F.col("actual") - F.col("prediction")) / F.col("actual"), F.lit(2.0))

    def of(part, c):
        return F.avg(F.when(part, c))

    m = a.groupBy("Store", "horizon").agg(
        F.count_if(train).cast("int").alias("train_samples"), F.count_if(val).cast("int").alias("val_samples"),
        F.round(of(train, ab), 2).alias("train_mae"), F.round(F.sqrt(of(train, sq)), 2).alias("train_rmse"),
        F.round(F.sqrt(of(train, pct)), 4).alias("train_rmspe"),
        F.round(of(val, ab), 2).alias("val_mae"), F.round(F.sqrt(of(val, sq)), 2).alias("val_rmse"),
        F.round(F.sqrt(of(val, pct)), 4).alias("val_rmspe"),
    )
    number = F.col("Store") * HORIZON + F.col("horizon")
    return m.select(
        F.concat(F.lit("exp_"), F.lpad(number.cast("string"), 3, "0")).alias("experiment_id"),
        F.concat_ws(" ", F.lit("store"), F.col("Store").cast("string")).alias("experiment_name"),
        F.concat(F.lit("v"), (F.col("Store") % 7).cast("string")).alias("preprocessing_version"),
        F.lit("persistence").alias("model_type"),
        F.col("horizon").alias("prediction_horizon"),
        (F.col("horizon") * 5).alias("sequence_length"),
        (F.col("Store") + 10).alias("epochs"),
        F.round(F.col("train_samples") / 100.0, 2).alias("training_time_mins"),
        "train_samples", "val_samples", "train_mae", "train_rmse", "train_rmspe", "val_mae", "val_rmse", "val_rmspe",
    )


def _of(part, e):
    return f"avg(CASE WHEN {part} THEN {e} END)"


_T, _V = f"Date < DATE '{_CUT}'", f"Date >= DATE '{_CUT}'"
_AB, _SQ, _PC = "abs(actual - prediction)", "(actual - prediction) ** 2", "((actual - prediction) / actual) ** 2"
EXPERIMENTS_SQL = f"""{ALIGNED_SQL}, xm AS (
  SELECT Store, horizon, CAST(count(*) FILTER ({_T}) AS INTEGER) AS train_samples, CAST(count(*) FILTER ({_V}) AS INTEGER) AS val_samples,
    round({_of(_T, _AB)}, 2) AS train_mae, round(sqrt({_of(_T, _SQ)}), 2) AS train_rmse, round(sqrt({_of(_T, _PC)}), 4) AS train_rmspe,
    round({_of(_V, _AB)}, 2) AS val_mae, round(sqrt({_of(_V, _SQ)}), 2) AS val_rmse, round(sqrt({_of(_V, _PC)}), 4) AS val_rmspe
  FROM aligned GROUP BY 1, 2), experiments AS (
  SELECT 'exp_' || lpad(CAST(Store * {HORIZON} + horizon AS VARCHAR), 3, '0') AS experiment_id, 'store ' || Store AS experiment_name,
    'v' || (Store % 7) AS preprocessing_version, 'persistence' AS model_type, CAST(horizon AS INTEGER) AS prediction_horizon,
    CAST(horizon * 5 AS INTEGER) AS sequence_length, CAST(Store + 10 AS INTEGER) AS epochs,
    round(train_samples / 100, 2) AS training_time_mins, train_samples, val_samples, train_mae, train_rmse, train_rmspe,
    val_mae, val_rmse, val_rmspe FROM xm)"""
_LOGGED = [
    "experiment_id", "experiment_name", "preprocessing_version", "model_type", "prediction_horizon", "sequence_length", "epochs",
    "training_time_mins", "train_samples", "val_samples", "train_mae", "train_rmse", "train_rmspe", "val_mae", "val_rmse", "val_rmspe",
]


def _log(spark, sf):
    path = new_table_path(spark, "experiments")
    ex.append_experiments(experiments(spark, sf), path)
    return path


@query("a14_append_experiment", f"""WITH {EXPERIMENTS_SQL}
SELECT experiment_id, val_rmspe, notes FROM (SELECT experiment_id, val_rmspe, NULL AS notes FROM experiments
UNION ALL SELECT 'exp_900', min(val_rmspe), 'best again' FROM experiments)""")
def a14(spark, sf):
    path = _log(spark, sf)
    best = ex.read_experiments(spark, path).agg(F.min("val_rmspe")).first()[0]
    ex.append_experiment(spark, path, experiment_id="exp_900", val_rmspe=best, notes="best again")
    return ex.read_experiments(spark, path).select("experiment_id", "val_rmspe", "notes")


@query("a16_read_experiments", f"WITH {EXPERIMENTS_SQL} SELECT {', '.join(_LOGGED)} FROM experiments")
def a16(spark, sf):
    return ex.read_experiments(spark, _log(spark, sf)).select(*_LOGGED)


@query("c5_compare_experiments", f"""WITH {EXPERIMENTS_SQL}
SELECT experiment_id, experiment_name, val_rmspe, val_mae, val_rmse, train_rmspe, sequence_length, epochs, preprocessing_version,
       training_time_mins, train_samples, val_samples FROM experiments WHERE experiment_id IN ('exp_004', 'exp_010', 'exp_033')""")
def c5(spark, sf):
    return ex.compare_experiments(experiments(spark, sf), ["exp_004", "exp_010", "exp_033"])


def _mean_std(m, digits):
    return f"{R(f'avg({m})', digits)} AS {m}_mean, {R(f'stddev_samp({m})', digits)} AS {m}_std"


@query("d13_experiment_summary", f"""WITH {EXPERIMENTS_SQL}
SELECT count(*) AS experiments, min(val_rmspe) AS best_val_rmspe, arg_min(experiment_id, (val_rmspe, experiment_id)) AS best_experiment,
  {_mean_std("val_rmspe", 4)}, {_mean_std("val_mae", 4)}, {_mean_std("val_rmse", 4)}, {_mean_std("train_rmspe", 4)},
  {R("avg(training_time_mins)", 4)} AS avg_time_mins, {R("sum(training_time_mins)", 4)} AS total_time_mins FROM experiments""")
def d13(spark, sf):
    return rounded(ex.experiment_summary(experiments(spark, sf)), 4)


@query("d13_top_versions", f"""WITH {EXPERIMENTS_SQL}
SELECT preprocessing_version, count(*) AS experiments FROM experiments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def d13_versions(spark, sf):
    return ex.top_versions(experiments(spark, sf))


@query("f2_best_experiments", f"""WITH {EXPERIMENTS_SQL}
SELECT {', '.join(_LOGGED)}, CAST(row_number() OVER (ORDER BY val_rmspe, experiment_id) AS INTEGER) AS rank FROM experiments
QUALIFY rank <= 5""")
def f2(spark, sf):
    return ex.best_experiments(experiments(spark, sf), 5, "val_rmspe")


@query("f3_list_experiments", f"""WITH {EXPERIMENTS_SQL}
SELECT experiment_id, experiment_name, val_rmspe, val_mae, val_rmse, train_rmspe, epochs, sequence_length, preprocessing_version
FROM experiments ORDER BY val_rmspe, experiment_id""")
def f3(spark, sf):
    return ex.list_experiments(experiments(spark, sf))
