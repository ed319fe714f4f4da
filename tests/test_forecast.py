import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.operators import forecast as fc
from panelwright.operators.experiments import append_experiment, next_experiment_id, read_experiments
from panelwright.spec import PanelSpec

D0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    data = []
    for s, base in zip("AB", (10.0, 500.0)):
        x = base
        for i in range(60):
            x = 0.8 * x + 0.2 * base + rng.normal(0, 1)
            data.append((s, D0 + dt.timedelta(days=i), float(x), float(rng.normal(0, 5)), float(i % 5)))
    return spark.createDataFrame(data, "symbol string, date timestamp_ntz, close double, f1 double, f2 double").cache()


SPEC = PanelSpec("date", ("symbol",), cell_steps=8, block_rows=17)


def config(**kw):
    base = dict(spec=SPEC, targets=("close",), horizon=2, sequence_length=3, use_target_history=True)
    return fc.ForecastConfig(**{**base, **kw})


@pytest.fixture(scope="module")
def model(panel):
    return fc.PanelForecaster(config()).fit(panel)


def test_linear_forecast_equals_least_squares(panel, model):
    """Same windows, codes and per-group scaling in numpy."""
    pdf = panel.toPandas().sort_values(["symbol", "date"])
    xs, ys, keys, back = [], [], [], []
    for code, (s, part) in enumerate(pdf.groupby("symbol")):
        part = part.reset_index(drop=True)
        part["h1"], part["h2"] = part.close.shift(-1), part.close.shift(-2)
        part = part.dropna()
        z = {c: (part[c].to_numpy() - part[c].mean()) / part[c].std(ddof=0) for c in ("close", "f1", "f2", "h1", "h2")}
        for i in range(2, len(part)):
            w = [z[c][j] for j in range(i - 2, i + 1) for c in ("close", "f1", "f2")]
            xs.append([*w, code, 1.0])
            ys.append([z["h1"][i], z["h2"][i]])
            keys.append((s, part.date[i].to_pydatetime()))
            back.append([(part[h].mean(), part[h].std(ddof=0)) for h in ("h1", "h2")])
    b, *_ = np.linalg.lstsq(np.array(xs), np.array(ys), rcond=None)
    p = np.array(xs) @ b
    want = {(*k, h + 1): p[i, h] * back[i][h][1] + back[i][h][0] for i, k in enumerate(keys) for h in (0, 1)}
    got = {(r.symbol, r.date, r.horizon): r.prediction for r in model.predict(panel).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_inference_reaches_the_last_row(panel, model):
    seen = model.predict(panel).agg(F.max("date")).first()[0]
    ahead = model.predict(panel, inference=True).agg(F.max("date")).first()[0]
    assert (ahead - seen).days == 2


def test_predict_next_is_the_last_inference_row(panel, model):
    last = panel.agg(F.max("date")).first()[0]
    want = {(r.symbol, r.horizon): r.prediction for r in model.predict(panel, inference=True).filter(F.col("date") == last).collect()}
    out = model.predict_next(panel, 2, "calendar_day").collect()
    assert {(r.symbol, r.step): r.prediction for r in out} == pytest.approx(want)
    assert {(r.step, r.future_ts - last) for r in out} == {(1, dt.timedelta(1)), (2, dt.timedelta(2))}
    with pytest.raises(ValueError, match="steps ahead"):
        model.predict_next(panel, 3)


def test_training_needs_targets_inference_does_not(panel):
    m = fc.PanelForecaster(config(use_target_history=False)).fit(panel)
    blind = panel.drop("close")
    assert m.predict(blind, inference=True).count() == 2 * 58 * 2
    with pytest.raises(ValueError, match="missing"):
        m.predict(blind)


def test_missing_feature_counts_as_zero(panel, model):
    a = model.predict(panel.drop("f2"), inference=True)
    b = model.predict(panel.withColumn("f2", F.lit(0.0)), inference=True)
    assert a.exceptAll(b).isEmpty()


def test_new_group_is_an_error(panel, model):
    with pytest.raises(Exception, match="unseen label|without fitted scaler"):
        model.predict(panel.withColumn("symbol", F.lit("C")), inference=True).collect()


def test_saved_model_predicts_the_same(panel, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = fc.PanelForecastModel.load(panel.sparkSession, str(tmp_path / "m"))
    assert again.config == model.config
    a, b = model.predict(panel), again.predict(panel)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_evaluation_has_all_levels(panel, model):
    out = model.evaluate(panel, per_group=True)
    assert {(r.horizon, r.symbol) for r in out.collect()} == {(h, s) for h in ("overall", "1", "2") for s in ("overall", "A", "B")}
    prepared = model.prepare_data(panel)
    assert model.evaluate_prepared(prepared).filter("horizon = 'overall'").first().MAE == pytest.approx(
        out.filter("horizon = 'overall' and symbol = 'overall'").first().MAE
    )


def test_hooks_dates_and_other_regressors(panel):
    hook = lambda d: d.withColumn("f3", F.col("f1") * F.col("f2"))
    fc.register_regressor("small_gbt", lambda f, y, p: fc.GBTRegressor(featuresCol=f, labelCol=y, predictionCol=p, maxIter=2, maxDepth=2))
    assert {"gbt", "random_forest", "linear"} <= set(fc.available_regressors())
    for name in ("small_gbt", "random_forest"):
        m = fc.PanelForecaster(config(horizon=1, regressor=name, hooks=(hook,), date_cycles=False, scaler="robust")).fit(panel)
        assert "f3" in m.features and "month_sin" in m.features
        assert m.predict(panel).filter(F.col("prediction").isNull()).isEmpty()
    fc.unregister_regressor("small_gbt")


def test_regressor_registry(panel):
    fc.register_regressor("shrunk", lambda f, y, p: fc.LinearRegression(featuresCol=f, labelCol=y, predictionCol=p, regParam=100.0))
    assert "shrunk" in fc.available_regressors()
    m = fc.PanelForecaster(config(horizon=1, regressor="shrunk", scale_per_group=False)).fit(panel)
    assert m.predict(panel).count() == 2 * 57
    fc.unregister_regressor("shrunk")
    assert "shrunk" not in fc.available_regressors()


def test_experiment_ids_count_up(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_experiments(spark, path).count() == 0
    for score in (0.2, 0.17):
        i = next_experiment_id(read_experiments(spark, path))
        append_experiment(spark, path, experiment_id=i, val_rmspe=score)
    out = rows(read_experiments(spark, path), "experiment_id")
    assert [(r["experiment_id"], r["val_rmspe"]) for r in out] == [("exp_001", 0.2), ("exp_002", 0.17)]
    with pytest.raises(ValueError, match="no such"):
        append_experiment(spark, path, colour="red")


def test_linear_regressor_takes_more_inputs_than_the_normal_equation(spark):
    """240 rows of 18 features, the lookback of minute bars: 4,320 inputs."""
    from pyspark.ml.functions import array_to_vector

    values = F.array(*[((F.col("id") * (k % 97 + 1)) % 11).cast("double") for k in range(240 * 18)])
    train = spark.range(12).select(array_to_vector(values).alias("features"), F.col("id").cast("double").alias("y"))
    model = fc._REGRESSORS["linear"]("features", "y", "p").fit(train)
    assert model.numFeatures == 4320 and model.transform(train).count() == 12


@pytest.fixture(scope="module")
def shops(spark):
    """Three shops whose level depends on the shop in no order of their names."""
    rng = np.random.default_rng(4)
    level = {"a": 5.0, "b": -20.0, "c": 11.0}
    data = []
    for s, base in level.items():
        x = rng.normal(0, 1, 80)
        for i in range(80):
            data.append((s, D0 + dt.timedelta(days=i), float(base + 0.2 * x[i] - 2 * x[i - 1] + 0.1 * rng.normal()), float(x[i]), float(rng.normal())))
    return spark.createDataFrame(data, "symbol string, date timestamp_ntz, y double, x double, z double").cache()


def test_categories_are_marks_and_not_slopes(shops):
    c = config(targets=("y",), horizon=1, sequence_length=2, features=("x", "z"), scale_per_group=False)
    m = fc.PanelForecaster(c).fit(shops)
    pdf = shops.toPandas().sort_values(["symbol", "date"])
    xs, ys = [], []
    for s, part in pdf.groupby("symbol"):
        part = part.reset_index(drop=True)
        for i in range(1, 79):
            xs.append([part.x[i - 1], part.z[i - 1], part.x[i], part.z[i], s == "a", s == "b", s == "c"])
            ys.append(part.y[i + 1])
    x = np.array(xs, float)
    want = x @ np.linalg.lstsq(x, np.array(ys), rcond=None)[0]
    got = [r.prediction for r in m.predict(shops).orderBy("symbol", "date").collect()]
    assert got == pytest.approx(want.tolist(), abs=1e-8)
    prepared = m.predict_prepared(m.prepare_data(shops)).orderBy("symbol", "date").collect()
    assert [r.prediction for r in prepared] == pytest.approx(got, abs=1e-8)


def test_one_pass_serves_all_targets_and_horizons(shops, monkeypatch):
    plans = []
    real = fc.ls.moments

    def watched(df, spec, design, targets):
        plans.append(targets)
        return real(df, spec, design, targets)

    monkeypatch.setattr(fc.ls, "moments", watched)
    c = config(targets=("y", "z"), horizon=3, sequence_length=4, features=("x", "z"))
    m = fc.PanelForecaster(c).fit(shops)
    assert len(plans) == 1 and len(plans[0]) == 6 and len(m.regressors) == 6
    text = m.predict(shops)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "collect_list" not in text


def test_blocks_do_not_show(spark, shops):
    found = []
    for rows_of_block in (1, 7, 10_000):
        spec = PanelSpec("date", ("symbol",), cell_steps=2, step=86400, block_rows=rows_of_block)
        c = config(spec=spec, targets=("y",), sequence_length=5, features=("x", "z"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3" if rows_of_block == 7 else "10000")
        try:
            m = fc.PanelForecaster(c).fit(shops)
            found.append([r.prediction for r in m.predict(shops, inference=True).orderBy("symbol", "date", "horizon").collect()])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[0]) == 3 * 76 * 2
    assert found[1] == pytest.approx(found[0], abs=1e-9) and found[2] == pytest.approx(found[0], abs=1e-9)


def test_held_out_rows_end_the_rounds(shops):
    c = config(targets=("y",), horizon=1, sequence_length=2, features=("x", "z"), encode_groups=False, rounds=400, patience=6)
    train, val = shops.filter(F.col("date") < D0 + dt.timedelta(days=60)), shops.filter(F.col("date") >= D0 + dt.timedelta(days=58))
    m = fc.PanelForecaster(c).fit(train, val)
    course = m.history["y_target_h1"]
    assert min(course.losses) >= course.losses[course.kept] - c.least_gain
    assert len(course.losses) - 1 in (course.kept + c.patience, c.rounds)
    # the loss that was kept is the mean square of the scaled errors on the held-out rows
    scaled = m.prepare(fc.shift_targets(val, SPEC, ["y"], 1), True)
    own = m.regressors["y_target_h1"].transform(scaled).agg(F.avg(F.pow(F.col("y_target_h1_raw") - F.col("y_target_h1_scaled"), F.lit(2.0)))).first()[0]
    assert own == pytest.approx(course.losses[course.kept], rel=1e-9)


def test_boosted_rounds_stop_on_held_out_rows(shops):
    fc.register_regressor("stumps", lambda f, y, p: fc.GBTRegressor(featuresCol=f, labelCol=y, predictionCol=p, maxDepth=1, stepSize=0.5, seed=7), fc.GBTRegressionModel)
    try:
        c = config(targets=("y",), horizon=1, sequence_length=1, features=("x", "z"), encode_groups=False, regressor="stumps", rounds=12, patience=2)
        train, val = shops.filter(F.col("date") < D0 + dt.timedelta(days=50)), shops.filter(F.col("date") >= D0 + dt.timedelta(days=50))
        m = fc.PanelForecaster(c).fit(train, val)
    finally:
        fc.unregister_regressor("stumps")
    course = m.history["y_target_h1"]
    assert m.regressors["y_target_h1"].getNumTrees == course.kept <= 12
    assert course.losses[course.kept - 1] <= min(course.losses) + c.least_gain


def test_rounds_need_a_regressor_that_has_them(shops):
    with pytest.raises(ValueError, match="by rounds"):
        fc.PanelForecaster(config(targets=("y",), features=("x",), regressor="random_forest")).fit(shops, shops)


def test_no_window_to_learn_from(shops):
    with pytest.raises(ValueError, match="no complete window"):
        fc.PanelForecaster(config(targets=("y",), features=("x",), sequence_length=500)).fit(shops)


def rolled(model, window, n, calendar):
    """Plain recursion for one group: ``window`` holds unscaled rows of the model's features."""
    params = {r["symbol"]: r for r in model.scaler.params.collect()}
    out = {}
    for symbol, (rows_, last) in window.items():
        p, rows_ = params[symbol], [dict(r) for r in rows_]
        for done in range(0, n, 2):
            x = [(r[f] - p[f"{f}__center"]) / p[f"{f}__scale"] for r in rows_[-3:] for f in model.features]
            ahead = []
            for h in (1, 2):
                m = model.regressors[f"close_target_h{h}"]
                y = float(np.dot(m.coefficients, x)) + m.intercept
                value = y * p[f"close_target_h{h}__scale"] + p[f"close_target_h{h}__center"]
                out[symbol, done + h] = value
                ahead.append({**rows_[-1], "close": value, **calendar(last + dt.timedelta(days=done + h))})
            rows_ += ahead
    return {k: v for k, v in out.items() if k[1] <= n}


def test_rolling_beyond_the_horizon(spark, panel):
    c = config(encode_groups=False, date_cycles=False, features=("close", "f1", "dayofweek_sin"))
    m = fc.PanelForecaster(c).fit(panel)
    pdf = panel.toPandas().sort_values("date")
    sin = lambda t: {"dayofweek_sin": float(np.sin(2 * np.pi * t.weekday() / 7))}
    window = {
        s: ([{"close": r.close, "f1": r.f1, **sin(r.date)} for r in part.itertuples()][-3:], part.date.iloc[-1].to_pydatetime())
        for s, part in pdf.groupby("symbol")
    }
    want = rolled(m, window, 7, sin)
    got = m.predict_next(panel, 7, "calendar_day", roll=True).collect()
    assert {(r.symbol, r.step): r.prediction for r in got} == pytest.approx(want, abs=1e-8) and len(got) == 14
    # known values of the steps ahead
    days = [(s, last + dt.timedelta(days=k), 100.0) for s, (_, last) in window.items() for k in (1, 2, 3)]
    future = spark.createDataFrame(days, "symbol string, date timestamp_ntz, f1 double")
    told = {(r.symbol, r.step): r.prediction for r in m.predict_next(panel, 7, "calendar_day", roll=True, future=future).collect()}
    assert all(told[k] == pytest.approx(want[k], abs=1e-8) for k in want if k[1] <= 2)
    assert all(abs(told[k] - want[k]) > 1e-3 for k in want if k[1] in (3, 4))


def test_rolling_with_trees_and_without_groups(panel):
    one = panel.filter("symbol = 'A'").drop("symbol")
    c = config(spec=PanelSpec("date"), regressor="random_forest", scale_per_group=False, encode_groups=False)
    out = fc.PanelForecaster(c).fit(one).predict_next(one, 5, "calendar_day", roll=True).orderBy("step").collect()
    assert [r.step for r in out] == [1, 2, 3, 4, 5] and all(np.isfinite(r.prediction) for r in out)
