"""Queries that fit forecasters and score with them.

The linear forecaster on windows of two rows is ordinary least squares with two inputs, which
SQL can write down from covariances; so fitted coefficients, predictions and metrics are
checked end to end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.catalog.registry import R, query
from panelwright.catalog.views import BAR, BARS_SQL, STORE, STORE_DAILY_SQL, bars, store_daily
from panelwright.operators import split
from panelwright.operators.experiments import read_experiments, run_experiment
from panelwright.operators.forecast import ForecastConfig, PanelForecaster, PanelForecastModel, score_in_pandas
from panelwright.operators.evaluate import METRICS
from panelwright.plans.blocks import Feature, over_blocks, with_position
from panelwright.session import new_table_path


def _config(spec, target, horizon, per_group=True, **kw):
    return ForecastConfig(
        spec=spec, targets=(target,), horizon=horizon, sequence_length=2, features=(target,), encode_groups=False,
        scale_per_group=per_group, **kw,
    )


def _bars(spark, sf):
    return bars(spark, sf).select("event_type", "ts", "close")


def _ols_sql(panel: str, g: str, t: str, x: str, horizon: int, fit: str, score: str, prefix: str = "") -> str:
    """CTEs ending in ``pred(g, t, horizon, prediction)``: standard scaling per group, least
    squares on (previous, current) value, scaled back. ``fit`` rows have targets, ``score``
    rows are predicted."""
    hs = range(1, horizon + 1)
    p = prefix
    stats = ", ".join(f"avg(h{h}) AS m{h}, stddev_pop(h{h}) AS s{h}" for h in hs)
    scaled = ", ".join(f"(h{h} - m{h}) / s{h} AS y{h}" for h in hs)
    sums = ", ".join(f"covar_pop(x1, y{h}) AS c1_{h}, covar_pop(x2, y{h}) AS c2_{h}, avg(y{h}) AS a{h}" for h in hs)
    coefs = ", ".join(
        f"(c1_{h} * v22 - c2_{h} * v12) / (v11 * v22 - v12 * v12) AS b1_{h}, (c2_{h} * v11 - c1_{h} * v12) / (v11 * v22 - v12 * v12) AS b2_{h}"
        for h in hs
    )
    preds = " UNION ALL ".join(
        f"SELECT {g}, {t}, CAST({h} AS INTEGER) AS horizon, (a{h} - b1_{h} * e1 - b2_{h} * e2 + b1_{h} * x1 + b2_{h} * x2) * s{h} + m{h} AS prediction"
        f" FROM {p}sw, {p}coef WHERE x1 IS NOT NULL"
        for h in hs
    )
    return f"""{p}par AS (SELECT {g}, avg({x}) AS mx, stddev_pop({x}) AS sx, {stats} FROM {fit} GROUP BY 1),
 {p}fz AS (SELECT f.{g}, f.{t}, ({x} - mx) / sx AS z, {scaled} FROM {fit} f JOIN {p}par p USING ({g})),
 {p}fw AS (SELECT *, z AS x2, lag(z) OVER (PARTITION BY {g} ORDER BY {t}) AS x1 FROM {p}fz),
 {p}mom AS (SELECT var_pop(x1) AS v11, var_pop(x2) AS v22, covar_pop(x1, x2) AS v12, avg(x1) AS e1, avg(x2) AS e2, {sums}
   FROM {p}fw WHERE x1 IS NOT NULL), {p}coef AS (SELECT *, {coefs} FROM {p}mom),
 {p}sw AS (SELECT s.{g}, s.{t}, p.*  EXCLUDE ({g}), (s.{x} - mx) / sx AS x2,
   lag((s.{x} - mx) / sx) OVER (PARTITION BY s.{g} ORDER BY s.{t}) AS x1 FROM {score} s JOIN {p}par p ON s.{g} = p.{g}),
 {p}pred AS ({preds})"""


_SHIFT2 = f"""{BARS_SQL}, panel AS (SELECT event_type, ts, close FROM bars), fitted AS (
  SELECT * FROM (SELECT event_type, ts, close, lead(close, 1) OVER w AS h1, lead(close, 2) OVER w AS h2 FROM panel
  WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE h2 IS NOT NULL)"""
_ALL = _ols_sql("panel", "event_type", "ts", "close", 2, "fitted", "panel")
_WITH_TARGETS = _ols_sql("panel", "event_type", "ts", "close", 2, "fitted", "fitted")


def _predictions_sql(ctes):
    return f"""WITH {_SHIFT2}, {ctes} SELECT event_type, ts, 'close' AS target, horizon, {R("prediction", 4)} AS prediction FROM pred"""


def _round4(df):
    return df.withColumn("prediction", F.round("prediction", 4))


def _fit_bars(spark, sf):
    return PanelForecaster(_config(BAR, "close", 2)).fit(_bars(spark, sf))


@query("i3_prepare_data", f"""WITH {_SHIFT2}, {_WITH_TARGETS}
SELECT event_type, ts, close, {R("x1")} AS x_0, {R("x2")} AS x_1, {R("y1")} AS close_target_h1_scaled, {R("y2")} AS close_target_h2_scaled
FROM fw JOIN panel USING (event_type, ts) WHERE x1 IS NOT NULL""")
def i3(spark, sf):
    out = _fit_bars(spark, sf).prepare_data(_bars(spark, sf))
    return out.select(
        "event_type", "ts", "close",
        F.round(F.col("window")[0][0], 6).alias("x_0"), F.round(F.col("window")[1][0], 6).alias("x_1"),
        F.round("close_target_h1_scaled", 6).alias("close_target_h1_scaled"),
        F.round("close_target_h2_scaled", 6).alias("close_target_h2_scaled"),
    )


@query("i5_fit_forecaster", f"""WITH {_SHIFT2}, {_WITH_TARGETS}
SELECT 'close_target_h1' AS target, {R("b1_1")} AS previous, {R("b2_1")} AS current, {R("a1 - b1_1 * e1 - b2_1 * e2")} AS intercept FROM coef
UNION ALL SELECT 'close_target_h2', {R("b1_2")}, {R("b2_2")}, {R("a2 - b1_2 * e1 - b2_2 * e2")} FROM coef""")
def i5(spark, sf):
    model = _fit_bars(spark, sf)
    rows = [
        (name, float(round(m.coefficients[0], 6)), float(round(m.coefficients[1], 6)), float(round(m.intercept, 6)))
        for name, m in model.regressors.items()
    ]
    return spark.createDataFrame(rows, "target string, previous double, current double, intercept double")


_MANY = [(t, h) for t in ("close", "high") for h in (1, 2, 3)]


def _many_sql() -> str:
    """Least squares with a mark per category equals least squares within the categories."""
    leads = ", ".join(f"lead({t}, {h}) OVER w AS {t}{h}" for t, h in _MANY)
    means = ", ".join(f"avg({c}) OVER (PARTITION BY event_type) AS m_{c}" for c in ["close", "volume", *[f"{t}{h}" for t, h in _MANY]])
    sums = ", ".join(f"sum(x1 * ({t}{h} - m_{t}{h})) AS c1_{t}{h}, sum(x2 * ({t}{h} - m_{t}{h})) AS c2_{t}{h}" for t, h in _MANY)
    rows = " UNION ALL ".join(
        f"""SELECT event_type, ts, '{t}' AS target, CAST({h} AS INTEGER) AS horizon, m_{t}{h}
 + x1 * (c1_{t}{h} * v22 - c2_{t}{h} * v12) / (v11 * v22 - v12 * v12) + x2 * (c2_{t}{h} * v11 - c1_{t}{h} * v12) / (v11 * v22 - v12 * v12) AS prediction
 FROM d, s"""
        for t, h in _MANY
    )
    return f"""WITH {BARS_SQL}, f AS (SELECT * FROM (SELECT event_type, ts, close, volume, {leads} FROM bars
  WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE close3 IS NOT NULL AND high3 IS NOT NULL),
 m AS (SELECT *, {means} FROM f), d AS (SELECT *, close - m_close AS x1, volume - m_volume AS x2 FROM m),
 s AS (SELECT sum(x1 * x1) AS v11, sum(x2 * x2) AS v22, sum(x1 * x2) AS v12, {sums} FROM d)
SELECT event_type, ts, target, horizon, {R("prediction", 4)} AS prediction FROM ({rows})"""


@query("i5_fit_many_targets", _many_sql())
def i5_many(spark, sf):
    """Two targets at three horizons from two features and a mark per event type, fitted in one
    pass over the rows."""
    b = bars(spark, sf).select("event_type", "ts", "close", "high", "volume")
    c = ForecastConfig(
        spec=BAR, targets=("close", "high"), horizon=3, sequence_length=1, features=("close", "volume"), scale_per_group=False
    )
    return _round4(PanelForecaster(c).fit(b).predict(b))


_ROUNDS, _PATIENCE, _GAIN = 60, 5, 1e-4


def _rounds_sql() -> str:
    """Gradient steps as a recursive query: each round's weights, loss, and the best so far."""
    n1, n2 = "b1 + (c1 - v11 * b1 - v12 * b2) / (v11 + v22)", "b2 + (c2 - v12 * b1 - v22 * b2) / (v11 + v22)"
    return f"""WITH RECURSIVE {STORE_DAILY_SQL}, trend AS (
  SELECT Store, Date, Sales, avg(Sales) OVER (PARTITION BY Store ORDER BY Date ROWS 6 PRECEDING) AS Trend FROM store_daily),
 n AS (SELECT Store, Date, Sales, Trend, row_number() OVER (PARTITION BY Store ORDER BY Date DESC) AS back, count(*) OVER (PARTITION BY Store) AS n FROM trend),
 tr AS (SELECT * FROM (SELECT *, lead(Trend) OVER (PARTITION BY Store ORDER BY Date) AS h1 FROM n WHERE n >= 44 AND back > 30) WHERE h1 IS NOT NULL),
 va AS (SELECT * FROM (SELECT *, lead(Trend) OVER (PARTITION BY Store ORDER BY Date) AS h1 FROM n WHERE n >= 44 AND back <= 31) WHERE h1 IS NOT NULL),
 par AS (SELECT Store, avg(Sales) AS m1, stddev_pop(Sales) AS s1, avg(Trend) AS m2, stddev_pop(Trend) AS s2,
   avg(h1) AS my, stddev_pop(h1) AS sy FROM tr GROUP BY 1),
 zt AS (SELECT (Sales - m1) / s1 AS x1, (Trend - m2) / s2 AS x2, (h1 - my) / sy AS y FROM tr JOIN par USING (Store)),
 zv AS (SELECT (Sales - m1) / s1 AS x1, (Trend - m2) / s2 AS x2, (h1 - my) / sy AS y FROM va JOIN par USING (Store)),
 mom AS (SELECT var_pop(x1) AS v11, var_pop(x2) AS v22, covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2,
   avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay FROM zt),
 held AS (SELECT * FROM zv, (SELECT a1, a2, ay FROM mom)),
 hm AS (SELECT avg((y - ay) ** 2) AS vyy, avg((y - ay) * (x1 - a1)) AS cy1, avg((y - ay) * (x2 - a2)) AS cy2, avg((x1 - a1) ** 2) AS w11,
   avg((x1 - a1) * (x2 - a2)) AS w12, avg((x2 - a2) ** 2) AS w22 FROM held),
 step AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2, loss, loss AS best, 0 AS kept FROM (SELECT vyy AS loss FROM hm)
  UNION ALL
  SELECT k, b1, b2, loss, CASE WHEN loss < best - {_GAIN} THEN loss ELSE best END, CASE WHEN loss < best - {_GAIN} THEN k ELSE kept END FROM (
   SELECT k + 1 AS k, {n1} AS b1, {n2} AS b2, best, kept,
    vyy - 2 * (b1n * cy1 + b2n * cy2) + b1n * b1n * w11 + 2 * b1n * b2n * w12 + b2n * b2n * w22 AS loss
   FROM (SELECT step.*, mom.*, hm.*, {n1} AS b1n, {n2} AS b2n FROM step, mom, hm WHERE k < {_ROUNDS} AND k - kept < {_PATIENCE})))
SELECT CAST(max(k) AS INTEGER) AS rounds, CAST(max(kept) AS INTEGER) AS best_round, {R("min(best)")} AS val_loss,
 {R("max(b1) FILTER (WHERE k = (SELECT max(kept) FROM step))")} AS weight_sales, {R("max(b2) FILTER (WHERE k = (SELECT max(kept) FROM step))")} AS weight_trend FROM step"""


@query("i5_fit_with_validation", _rounds_sql())
def i5_validation(spark, sf):
    """Rounds that end when the loss on held-out rows does; the best round is kept."""
    trend = Feature(lambda d, w: d.withColumn("Trend", F.avg("Sales").over(w.trailing(7))), before=6)
    labelled = split.split_time_series(over_blocks(_sales(spark, sf), STORE, trend), STORE, test_size=0, val_size=30, sequence_length=2)
    train, val = (labelled.filter(F.col("split") == s).drop("split", "is_context") for s in ("train", "val"))
    c = ForecastConfig(
        spec=STORE, targets=("Trend",), sequence_length=1, features=("Sales", "Trend"), encode_groups=False, rounds=_ROUNDS, patience=_PATIENCE,
        least_gain=_GAIN,
    )
    model = PanelForecaster(c).fit(train, val)
    (course,), (own,) = model.history.values(), model.regressors.values()
    row = (len(course.losses) - 1, course.kept, round(course.losses[course.kept], 6), *[float(round(w, 6)) for w in own.coefficients])
    return spark.createDataFrame([row], "rounds int, best_round int, val_loss double, weight_sales double, weight_trend double")


@query("i6_predict", _predictions_sql(_ALL))
def i6(spark, sf):
    b = _bars(spark, sf)
    return _round4(_fit_bars(spark, sf).predict(b, inference=True))


@query("i6_score_in_pandas", f"""WITH {_SHIFT2}, {_ALL}
SELECT event_type, ts, 'close' AS target, CAST(1 AS INTEGER) AS horizon, {R("(x1 + x2) / 2")} AS prediction FROM sw WHERE x1 IS NOT NULL""")
def i6_pandas(spark, sf):
    """A user's own model: the mean of the scaled window, scored in Arrow batches."""
    prepared = _fit_bars(spark, sf).prepare_data(_bars(spark, sf), inference=True)
    out = score_in_pandas(prepared, ["event_type", "ts"], lambda x: np.stack(x.to_numpy()).mean(axis=1), "close")
    return out.withColumn("prediction", F.round("prediction", 6))


@query("i7_predict_from_features", _predictions_sql(_WITH_TARGETS))
def i7(spark, sf):
    model = _fit_bars(spark, sf)
    return _round4(model.predict_prepared(model.prepare_data(_bars(spark, sf))))


@query("a17_saved_model_predictions", _predictions_sql(_WITH_TARGETS))
def a17(spark, sf):
    path = new_table_path(spark, "model")
    _fit_bars(spark, sf).save(path)
    return _round4(PanelForecastModel.load(spark, path).predict(_bars(spark, sf)))


def _metrics(group, rmspe=False):
    a = "actual - prediction"
    extra = f""", {R(f"coalesce(sqrt(avg(CASE WHEN actual <> 0 THEN (({a}) / actual) ** 2 END)), 0)", 4)} AS "RMSPE" """ if rmspe else ""
    return f"""{R(f"avg(abs({a}))", 4)} AS "MAE", {R(f"avg(({a}) ** 2)", 3)} AS "MSE", {R(f"sqrt(avg(({a}) ** 2))", 4)} AS "RMSE",
 {R(f"avg(CASE WHEN actual <> 0 THEN abs(({a}) / actual) END) * 100", 3)} AS "MAPE",
 {R(f"1 - sum(({a}) ** 2) / (var_pop(actual) * count(*))", 5)} AS "R2", {R("avg(hit) * 100", 4)} AS "Directional_Accuracy"{extra}"""


_DIGITS = {"MAE": 4, "MSE": 3, "RMSE": 4, "MAPE": 3, "R2": 5, "Directional_Accuracy": 4, "RMSPE": 4}


def _round_metrics(df):
    return df.withColumns({c: F.round(c, n) for c, n in _DIGITS.items() if c in df.columns})


_ACTUAL2 = """act AS (SELECT event_type, ts, 1 AS horizon, h1 AS actual FROM fitted UNION ALL SELECT event_type, ts, 2, h2 FROM fitted),
 al AS (SELECT event_type, ts, 'close' AS target, horizon, actual, prediction FROM pred JOIN act USING (event_type, ts, horizon)),
 hits AS (SELECT *, CAST((actual - lag(actual) OVER v > 0) = (prediction - lag(prediction) OVER v > 0) AS INTEGER) AS hit FROM al
   WINDOW v AS (PARTITION BY event_type, horizon ORDER BY ts))"""
_H = "CASE WHEN grouping(horizon) = 1 THEN 'overall' ELSE CAST(horizon AS VARCHAR) END AS horizon"


@query("i8_evaluate", f"""WITH {_SHIFT2}, {_WITH_TARGETS}, {_ACTUAL2}
SELECT target, {_H}, CASE WHEN grouping(event_type) = 1 THEN 'overall' ELSE event_type END AS event_type, {_metrics("event_type")}
FROM hits GROUP BY GROUPING SETS ((target), (target, horizon), (target, event_type), (target, horizon, event_type))""")
def i8(spark, sf):
    return _round_metrics(_fit_bars(spark, sf).evaluate(_bars(spark, sf), per_group=True))


@query("i7_evaluate_from_features", f"""WITH {_SHIFT2}, {_WITH_TARGETS}, {_ACTUAL2}
SELECT target, {_H}, {_metrics("")} FROM hits GROUP BY GROUPING SETS ((target), (target, horizon))""")
def i7_evaluate(spark, sf):
    model = _fit_bars(spark, sf)
    return _round_metrics(model.evaluate_prepared(model.prepare_data(_bars(spark, sf))))


_SALES1 = f"""{STORE_DAILY_SQL}, fitted AS (
  SELECT * FROM (SELECT Store, Date, Sales, lead(Sales, 1) OVER (PARTITION BY Store ORDER BY Date) AS h1 FROM store_daily) WHERE h1 IS NOT NULL),
 {_ols_sql("store_daily", "Store", "Date", "Sales", 1, "fitted", "fitted")},
 al AS (SELECT Store, Date, 'Sales' AS target, horizon, h1 AS actual, prediction FROM pred JOIN fitted USING (Store, Date)),
 hits AS (SELECT *, CAST((actual - lag(actual) OVER v > 0) = (prediction - lag(prediction) OVER v > 0) AS INTEGER) AS hit FROM al
   WINDOW v AS (PARTITION BY Store ORDER BY Date))"""


def _sales(spark, sf):
    return store_daily(spark, sf).select("Store", "Date", "Sales")


@query("i9_evaluate_rmspe", f"""WITH {_SALES1}
SELECT target, {_H}, {R("avg(abs(actual - prediction))", 1)} AS "MAE", {R("sqrt(avg((actual - prediction) ** 2))", 1)} AS "RMSE",
       {R("coalesce(sqrt(avg(CASE WHEN actual <> 0 THEN ((actual - prediction) / actual) ** 2 END)), 0)", 4)} AS "RMSPE",
       {R("avg(hit) * 100", 4)} AS "Directional_Accuracy" FROM hits GROUP BY GROUPING SETS ((target), (target, horizon))""")
def i9(spark, sf):
    d = _sales(spark, sf)
    out = PanelForecaster(_config(STORE, "Sales", 1)).fit(d).evaluate_sales(d)
    return out.select(
        "target", "horizon", F.round("MAE", 1).alias("MAE"), F.round("RMSE", 1).alias("RMSE"),
        F.round("RMSPE", 4).alias("RMSPE"), F.round("Directional_Accuracy", 4).alias("Directional_Accuracy"),
    )


@query("i10_predict_with_keys", f"""WITH {_SALES1} SELECT Store, Date, {R("prediction", 1)} AS prediction FROM pred""")
def i10(spark, sf):
    d = _sales(spark, sf)
    out = PanelForecaster(_config(STORE, "Sales", 1)).fit(d).predict(d)
    return out.select("Store", "Date", F.round("prediction", 1).alias("prediction"))


@query("i11_predict_next", f"""WITH {_SHIFT2}, {_ALL}, last AS (SELECT event_type, max(ts) AS ts FROM panel GROUP BY 1)
SELECT event_type, ts, horizon AS step, ts + to_hours(horizon) AS future_ts, 'close' AS target, {R("prediction", 4)} AS prediction
FROM pred JOIN last USING (event_type, ts)""")
def i11(spark, sf):
    b = _bars(spark, sf)
    return _round4(_fit_bars(spark, sf).predict_next(b, 2, "bar", 3600))


@query("i11_predict_beyond_horizon", f"""WITH RECURSIVE {_SHIFT2}, {_ALL}, last AS (SELECT event_type, max(ts) AS ts FROM panel GROUP BY 1),
 roll AS (
  SELECT event_type, ts, 0 AS k, x1, x2 FROM sw JOIN last USING (event_type, ts)
  UNION ALL
  SELECT event_type, ts, k + 1, (p1 - mx) / sx, (p2 - mx) / sx FROM (
   SELECT r.*, par.mx, par.sx, (a1 - b1_1 * e1 - b2_1 * e2 + b1_1 * x1 + b2_1 * x2) * s1 + m1 AS p1,
    (a2 - b1_2 * e1 - b2_2 * e2 + b1_2 * x1 + b2_2 * x2) * s2 + m2 AS p2
   FROM roll r JOIN par USING (event_type), coef WHERE k < 3)),
 steps AS (SELECT event_type, ts, 2 * k - 1 AS step, x1 * sx + mx AS prediction FROM roll JOIN par USING (event_type) WHERE k > 0
  UNION ALL SELECT event_type, ts, 2 * k, x2 * sx + mx FROM roll JOIN par USING (event_type) WHERE k > 0)
SELECT event_type, ts, CAST(step AS INTEGER) AS step, ts + to_hours(step) AS future_ts, 'close' AS target, {R("prediction", 4)} AS prediction FROM steps""")
def i11_beyond(spark, sf):
    """Three times the horizon: the model goes on from what it predicted."""
    b = _bars(spark, sf)
    return _round4(_fit_bars(spark, sf).predict_next(b, 6, "bar", 3600, roll=True))


@query("b15_require_inference_inputs", f"""WITH {BARS_SQL}, f AS (
  SELECT * FROM (SELECT volume, lead(close) OVER (PARTITION BY event_type ORDER BY ts) AS y FROM bars) WHERE y IS NOT NULL)
SELECT event_type, ts, 'close' AS target, CAST(1 AS INTEGER) AS horizon,
       {R("(SELECT regr_intercept(y, volume) FROM f) + (SELECT regr_slope(y, volume) FROM f) * volume", 4)} AS prediction FROM bars""")
def b15(spark, sf):
    """Scoring needs the features only: the frame to score has no target column."""
    c = ForecastConfig(
        spec=BAR, targets=("close",), sequence_length=1, features=("volume",), encode_groups=False, scale_per_group=False
    )
    model = PanelForecaster(c).fit(bars(spark, sf))
    return _round4(model.predict(bars(spark, sf).select("event_type", "ts", "volume"), inference=True))


def _experiment_sql():
    rows = f"""{STORE_DAILY_SQL}, n AS (
  SELECT Store, Date, Sales, row_number() OVER (PARTITION BY Store ORDER BY Date DESC) AS back, count(*) OVER (PARTITION BY Store) AS n FROM store_daily),
 tr AS (SELECT Store, Date, Sales FROM n WHERE n >= 44 AND back > 30), va AS (SELECT Store, Date, Sales FROM n WHERE n >= 44 AND back <= 31),
 ftr AS (SELECT * FROM (SELECT *, lead(Sales) OVER (PARTITION BY Store ORDER BY Date) AS h1 FROM tr) WHERE h1 IS NOT NULL),
 fva AS (SELECT * FROM (SELECT *, lead(Sales) OVER (PARTITION BY Store ORDER BY Date) AS h1 FROM va) WHERE h1 IS NOT NULL)"""
    one = _ols_sql("tr", "Store", "Date", "Sales", 1, "ftr", "ftr", "t_")
    two = _ols_sql("va", "Store", "Date", "Sales", 1, "ftr", "fva", "v_")

    def numbers(label, pred, act):
        e = f"SELECT h1 AS a, prediction AS p FROM {pred} JOIN {act} USING (Store, Date)"
        return f"""{label}_m AS (SELECT {R("avg(abs(a - p))", 1)} AS {label}_mae, {R("sqrt(avg((a - p) ** 2))", 1)} AS {label}_rmse,
 {R("sqrt(avg(CASE WHEN a <> 0 THEN ((a - p) / a) ** 2 END))", 4)} AS {label}_rmspe FROM ({e}))"""

    return f"""WITH {rows}, {one}, {two}, {numbers("train", "t_pred", "ftr")}, {numbers("val", "v_pred", "fva")}
SELECT 'exp_001' AS experiment_id, 'linear baseline' AS experiment_name, 'linear' AS model_type, CAST(2 AS INTEGER) AS sequence_length,
 CAST((SELECT count(*) FROM tr) AS INTEGER) AS train_samples, CAST((SELECT count(*) FROM va) AS INTEGER) AS val_samples, *
FROM train_m, val_m"""


@query("i12_run_experiment", _experiment_sql())
def i12(spark, sf):
    """Split, fit, evaluate, write and log one run; the row that was logged is read back."""
    labelled = split.split_time_series(_sales(spark, sf), STORE, test_size=0, val_size=30, sequence_length=2)
    train = labelled.filter("split = 'train'").drop("split", "is_context")
    val = labelled.filter("split = 'val'").drop("split", "is_context")
    base = new_table_path(spark, "runs")
    run_experiment(
        spark, train, val, _config(STORE, "Sales", 1), log_path=f"{base}/log", out_path=base, name="linear baseline"
    )
    log = read_experiments(spark, f"{base}/log")
    one = {f"{s}_{m}": 1 for s in ("train", "val") for m in ("mae", "rmse")} | {"train_rmspe": 4, "val_rmspe": 4}
    return log.select(
        "experiment_id", "experiment_name", "model_type", "sequence_length", "train_samples", "val_samples",
        *[F.round(c, n).alias(c) for c, n in one.items()],
    )


def _experiment_test_sql():
    rows = f"""{STORE_DAILY_SQL}, n AS (
  SELECT Store, Date, Sales, row_number() OVER (PARTITION BY Store ORDER BY Date DESC) AS back, count(*) OVER (PARTITION BY Store) AS n FROM store_daily),
 tr AS (SELECT Store, Date, Sales FROM n WHERE n >= 90 AND back > 60), te AS (SELECT Store, Date, Sales FROM n WHERE n >= 90 AND back <= 31),
 ftr AS (SELECT * FROM (SELECT *, lead(Sales) OVER (PARTITION BY Store ORDER BY Date) AS h1 FROM tr) WHERE h1 IS NOT NULL)"""
    return f"""WITH {rows}, {_ols_sql("tr", "Store", "Date", "Sales", 1, "ftr", "te", "t_")}
SELECT 'exp_001' AS experiment_id, 'sales.yaml' AS config_file, (SELECT CAST(count(*) AS INTEGER) FROM te) AS test_samples,
 Store, Date, {R("prediction", 1)} AS prediction FROM t_pred"""


@query("i12_experiment_test_rows", _experiment_test_sql())
def i12_test(spark, sf):
    """Test rows carry no sales of the future: they are scored, written and logged; the logged file
    is read back."""
    counted = with_position(_sales(spark, sf), STORE).withColumn("back", F.col("_group_rows") - F.col("_pos")).filter("_group_rows >= 90")
    train, val, test = (counted.filter(c).select("Store", "Date", "Sales") for c in ("back >= 60", "back < 61 AND back >= 30", "back < 31"))
    base = new_table_path(spark, "runs")
    config = _config(STORE, "Sales", 1)
    run_experiment(
        spark, train, val, config, log_path=f"{base}/log", out_path=base, name="with test rows", test=test, config_file="sales.yaml"
    )
    log = read_experiments(spark, f"{base}/log").select("experiment_id", "config_file", "test_samples", "test_predictions_file")
    (row,) = log.collect()
    found = spark.read.option("header", True).schema("Store int, Date timestamp_ntz, target string, horizon int, prediction double").csv(row.test_predictions_file)
    logged = [F.lit(row[c]).alias(c) for c in ("experiment_id", "config_file", "test_samples")]
    return found.select(*logged, "Store", "Date", F.round("prediction", 1).alias("prediction"))
