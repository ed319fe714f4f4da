"""Fitting direct multi-horizon forecasters on lookback windows and scoring with them.

The linear forecaster is fitted for all targets and horizons in one pass over the blocks of the
panel and scores block by block (see ``least_squares``); others are one MLlib regressor per
target and horizon. All preparation is lazy, only the fitted parameters (label codes, scales,
coefficients) are materialised.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import and_

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendar import date_features, future_timestamps
from panelwright.operators import evaluate as ev
from panelwright.operators import least_squares as ls
from panelwright.operators.clean import numeric_features, with_fitted_features
from panelwright.operators.encode import LabelMap, fit_labels
from panelwright.operators.rolling import technical_features
from panelwright.operators.scale import ScalerModel, center, fit_scaler, scale_of
from panelwright.operators.sequence import latest_window, sequence_windows
from panelwright.operators.targets import (
    forward_returns,
    return_column_names,
    shift_targets,
    target_name,
    target_names,
)
from panelwright.plans.blocks import over_blocks
from panelwright.plans.lookup import bytes_of
from panelwright.session import cut_lineage
from panelwright.spec import OHLCV, PanelSpec, require_columns

#: More inputs than this (their products are a square table) are left to MLlib's iterative solver.
ONE_PASS_INPUTS = 4096

# name -> (features column, label column, prediction column) -> estimator
_REGRESSORS: dict[str, Callable] = {}
_LOADERS = {}


def register_regressor(name: str, build: Callable, loader=None) -> None:
    _REGRESSORS[name] = build
    if loader is not None:
        _LOADERS[name] = loader


def unregister_regressor(name: str) -> None:
    _REGRESSORS.pop(name, None)
    _LOADERS.pop(name, None)


def available_regressors() -> list[str]:
    return sorted(_REGRESSORS)


def _linear(features: str, label: str, prediction: str):
    return LinearRegression(
        featuresCol=features, labelCol=label, predictionCol=prediction, solver="auto", regParam=0.0, standardization=False
    )


register_regressor("linear", _linear, LinearRegressionModel)
register_regressor(
    "gbt", lambda f, y, p: GBTRegressor(featuresCol=f, labelCol=y, predictionCol=p, maxIter=20, seed=7), GBTRegressionModel
)
register_regressor(
    "random_forest",
    lambda f, y, p: RandomForestRegressor(featuresCol=f, labelCol=y, predictionCol=p, seed=7),
    RandomForestRegressionModel,
)


@dataclass(frozen=True)
class ForecastConfig:
    """Settings of a forecaster. ``hooks`` are ``DataFrame -> DataFrame`` functions that add
    domain features first."""

    spec: PanelSpec
    targets: tuple[str, ...]
    horizon: int = 1
    sequence_length: int = 5
    categorical: tuple[str, ...] = ()
    encode_groups: bool = True
    scaler: str = "standard"
    scale_per_group: bool = True
    use_target_history: bool = False
    date_cycles: bool | None = None  # True: with time of day, False: dates only, None: none
    regressor: str = "linear"
    features: tuple[str, ...] | None = None
    rounds: int = 200  # of a fit with held-out rows, at most
    patience: int = 10  # rounds without a gain on the held-out rows that end such a fit
    least_gain: float = 1e-6  # of the loss (mean square of scaled errors), to count as one
    hooks: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=(), compare=False)

    @property
    def encoded(self) -> list[str]:
        own = list(self.spec.groups) if self.encode_groups else []
        return list(dict.fromkeys([*self.categorical, *own]))


def base_features(df: DataFrame, config: ForecastConfig) -> DataFrame:
    for hook in config.hooks:
        df = df.transform(hook)
    if config.date_cycles is not None:
        df = date_features(df, config.spec.time, has_time=config.date_cycles)
    return df


def choose_features(df: DataFrame, config: ForecastConfig) -> list[str]:
    """Numeric columns that are no key, category, or target (targets only with
    ``use_target_history``)."""
    if config.features is not None:
        return list(config.features)
    exclude = [*config.spec.groups, *config.spec.order, *config.encoded]
    if not config.use_target_history:
        exclude += config.targets
    return numeric_features(df, exclude)


def _vector(config: ForecastConfig, codes: list[str]):
    """Flattened window and category codes; missing scaled values count as 0."""
    flat = F.transform(F.flatten("window"), lambda x: F.coalesce(x, F.lit(0.0)))
    if codes:
        flat = F.concat(flat, F.array(*[F.col(c).cast("double") for c in codes]))
    return array_to_vector(flat)


@dataclass(frozen=True)
class PanelForecaster:
    config: ForecastConfig

    def _panel(self, df: DataFrame) -> DataFrame:
        c = self.config
        require_columns(df, *c.spec.keys)
        return shift_targets(base_features(df, c), c.spec, list(c.targets), c.horizon)

    def fit(self, df: DataFrame, val_df: DataFrame | None = None) -> "PanelForecastModel":
        """Fit on ``df``. With held-out rows ``val_df`` the fit goes by rounds (gradient steps of
        the linear forecaster, trees of ``gbt``), at most ``config.rounds`` of them: it ends when
        ``config.patience`` rounds have not lowered the loss on the held-out rows, and the best
        round is kept (``model.history``)."""
        frames = [self._panel(d).persist(StorageLevel.MEMORY_AND_DISK) for d in (df, val_df) if d is not None]
        try:
            return self.fit_prepared(*frames)
        finally:
            for frame in frames:
                frame.unpersist()

    def fit_prepared(self, panel: DataFrame, val_panel: DataFrame | None = None) -> "PanelForecastModel":
        """Fit on a panel that already has its features and shifted targets. Codes and scales are
        learnt on the training rows alone."""
        c = self.config
        names = target_names(list(c.targets), c.horizon)
        require_columns(panel, *names)
        groups = list(c.spec.groups) if c.scale_per_group else []
        labels = fit_labels(panel, c.encoded) if c.encoded else None
        features = choose_features(panel, c)
        if not features:
            raise ValueError("no numeric feature is left to learn from")
        scaler = fit_scaler(panel, c.scaler, [*features, *names], groups).materialize()
        model = PanelForecastModel(c, tuple(features), labels, scaler, {})
        if c.regressor == "linear":
            design = model.design()
            if design.width <= ONE_PASS_INPUTS:
                return self._fit_linear(model, design, panel, val_panel)
            if val_panel is not None:
                raise ValueError(f"{design.width} inputs are too many for rounds on held-out rows ({ONE_PASS_INPUTS})")
        return self._fit_by_target(model, panel, val_panel)

    def _fit_linear(self, model, design: ls.Design, panel: DataFrame, val_panel: DataFrame | None) -> "PanelForecastModel":
        """All targets and horizons from one pass over the rows."""
        c, names = self.config, model.targets
        scaled = [f"{n}_scaled" for n in names]
        sums = ls.moments(model._encoded_scaled(panel, True)[0], c.spec, design, scaled)
        if val_panel is None:
            return replace(model, regressors=ls.by_target(design, sums.solved(), names))
        held_out = ls.moments(model._encoded_scaled(val_panel, True, unseen="null")[0], c.spec, design, scaled)
        weights, course = ls.descend(sums, held_out, c.rounds, c.patience, c.least_gain)
        return replace(model, regressors=ls.by_target(design, weights, names), history={n: course for n in names})

    def _fit_by_target(self, model, panel: DataFrame, val_panel: DataFrame | None) -> "PanelForecastModel":
        c, names = self.config, model.targets

        def windows(d):
            return model.prepare(d, with_targets=True).select("features", *[f"{n}_scaled" for n in names]).persist(StorageLevel.MEMORY_AND_DISK)

        train = windows(panel)
        val = windows(val_panel) if val_panel is not None else None
        fitted, history = {}, {}
        try:
            for n in names:
                estimator = _REGRESSORS[c.regressor]("features", f"{n}_scaled", f"{n}_raw")
                if val is None:
                    fitted[n] = estimator.fit(train)
                else:
                    fitted[n], history[n] = _by_rounds(estimator, train, val, c)
        finally:
            train.unpersist()
            if val is not None:
                val.unpersist()
        return replace(model, regressors=fitted, history=history)


def _by_rounds(estimator, train: DataFrame, val: DataFrame, config: ForecastConfig):
    """A boosted regressor with as many rounds as serve the held-out rows, and its losses there. Trees
    are grown ``patience`` or more at a time; those of a round do not depend on later ones."""
    if not hasattr(estimator, "setMaxIter") or not estimator.hasParam("lossType"):
        raise ValueError("only the linear and boosted regressors are fitted by rounds")
    rounds, patience = config.rounds, config.patience
    grown = min(rounds, max(2 * patience, 8))
    while True:
        model = estimator.copy({estimator.maxIter: grown}).fit(train)
        losses = model.evaluateEachIteration(val, "squared")
        best, kept = float("inf"), 0
        for k, loss in enumerate(losses):
            if loss < best - config.least_gain:
                best, kept = loss, k
            elif k - kept >= patience:
                losses = losses[: k + 1]
                break
        if len(losses) < grown or grown >= rounds:
            break
        grown = min(rounds, 2 * grown)
    if kept + 1 < grown:
        model = estimator.copy({estimator.maxIter: kept + 1}).fit(train)
    return model, ls.Rounds(tuple(losses), kept + 1)


@dataclass(frozen=True)
class PanelForecastModel:
    config: ForecastConfig
    features: tuple[str, ...]
    labels: LabelMap | None
    scaler: ScalerModel
    regressors: dict
    history: dict = field(default_factory=dict)  # of each target, if it was fitted by rounds

    @property
    def targets(self) -> list[str]:
        return target_names(list(self.config.targets), self.config.horizon)

    def design(self) -> ls.Design:
        """Inputs of the linear forecaster; each category is a mark of its own."""
        codes, sizes = (), ()
        if self.labels is not None:
            counts = {r["column"]: r["categories"] for r in self.labels.cardinalities().collect()}  # a row per column
            codes = tuple(f"{c}_code" for c in self.labels.columns)
            sizes = tuple(counts.get(c, 0) for c in self.labels.columns)
        return ls.Design(tuple(f"{f}_scaled" for f in self.features), self.config.sequence_length, codes, sizes)

    def _linear(self) -> tuple[ls.Design, np.ndarray] | None:
        """Design and weights of all targets, if the forecaster is the one-pass linear one."""
        models = [self.regressors.get(n) for n in self.targets]
        if not models or not all(isinstance(m, ls.LinearWeights) for m in models):
            return None
        codes = tuple(f"{c}_code" for c in self.labels.columns) if self.labels is not None else ()
        sizes = tuple(map(len, models[0].categories))
        design = ls.Design(tuple(f"{f}_scaled" for f in self.features), self.config.sequence_length, codes, sizes)
        return design, np.stack([np.concatenate([m.coefficients, *m.categories, [m.intercept]]) for m in models], axis=1)

    def _encoded_scaled(self, df: DataFrame, with_targets: bool = False, unseen: str = "error") -> tuple[DataFrame, list[str], list[str]]:
        df = with_fitted_features(df, list(self.features))
        codes = []
        if self.labels is not None:
            df = self.labels.encode(df, suffix="_code", unseen=unseen)
            codes = [f"{c}_code" for c in self.labels.columns]
        columns = [*self.features, *(self.targets if with_targets else [])]
        df = self.scaler.transform(df, columns, suffix="_scaled")
        return df, [f"{c}_scaled" for c in self.features], codes

    def prepare(self, panel: DataFrame, with_targets: bool) -> DataFrame:
        """Encode, scale and cut windows: keys, unscaled columns, ``window``, codes and the
        ``features`` vector, plus scaled targets when learning or testing."""
        c = self.config
        df, scaled, codes = self._encoded_scaled(panel, with_targets)
        out = sequence_windows(df, c.spec, scaled, c.sequence_length)
        return out.withColumn("features", _vector(c, codes)).drop(*scaled)

    def prepare_data(self, df: DataFrame, inference: bool = False) -> DataFrame:
        """From raw rows to windows. Without ``inference`` rows need complete targets."""
        c = self.config
        panel = base_features(df, c)
        if not inference:
            panel = shift_targets(panel, c.spec, list(c.targets), c.horizon)
        return self.prepare(panel, with_targets=not inference)

    def predict_prepared(self, prepared: DataFrame, actual: bool = False) -> DataFrame:
        """Score prepared windows: ``(group..., time, target, horizon, prediction)`` on the
        original scale; ``actual`` adds what came, from the targets that stand on the same rows,
        and leaves out rows where nothing did."""
        c = self.config
        came = self.targets if actual else []
        scored = prepared.select(*c.spec.keys, "features", *came)
        for n in self.targets:
            scored = self.regressors[n].transform(scored)
        return self._unscaled(scored.drop("features"), actual)

    def _unscaled(self, scored: DataFrame, actual: bool) -> DataFrame:
        """Long form of scored rows, on the original scale."""
        c = self.config
        back = self.scaler.inverse(scored, {f"{n}_raw": n for n in self.targets})

        def row(t: str, h: int):
            name = target_name(t, h)
            cells = [F.lit(t).alias("target"), F.lit(h).alias("horizon"), F.col(f"{name}_raw").alias("prediction")]
            return F.struct(*cells, *([F.col(name).cast("double").alias("actual")] if actual else []))

        out = back.select(*c.spec.keys, F.inline(F.array(*[row(t, h) for t in c.targets for h in range(1, c.horizon + 1)])))
        return out.filter(F.col("actual").isNotNull()) if actual else out

    def predict(self, df: DataFrame, inference: bool = False) -> DataFrame:
        return self._scored(df, inference, False)

    def _scored(self, df: DataFrame, inference: bool, actual: bool) -> DataFrame:
        """From raw rows to predictions; the linear forecaster builds no windows."""
        c, linear = self.config, self._linear()
        if linear is None:
            return self.predict_prepared(self.prepare_data(df, inference), actual)
        panel = base_features(df, c)
        if not inference:
            panel = shift_targets(panel, c.spec, list(c.targets), c.horizon)
        rows = self._encoded_scaled(panel)[0]
        raw = [f"{n}_raw" for n in self.targets]
        return self._unscaled(ls.scores(rows, c.spec, *linear, raw, self.targets if actual else []), actual)

    def actuals(self, df: DataFrame) -> DataFrame:
        c = self.config
        panel = shift_targets(base_features(df, c), c.spec, list(c.targets), c.horizon)
        return ev.actuals_long(panel, c.spec, list(c.targets), c.horizon)

    def evaluate(self, df: DataFrame, per_group: bool = False, predictions: DataFrame | None = None) -> DataFrame:
        """Metrics of the forecasts of ``df``; only predictions from outside are joined to what came."""
        if predictions is not None:
            return ev.evaluate(predictions, self.actuals(df), self.config.spec, per_group)
        return ev.evaluate_aligned(self.predicted_and_actual(df), self.config.spec, per_group)

    def evaluate_prepared(self, prepared: DataFrame, per_group: bool = False) -> DataFrame:
        """Evaluate windows that already carry their shifted targets."""
        return ev.evaluate_aligned(self.predict_prepared(prepared, actual=True), self.config.spec, per_group)

    def evaluate_sales(self, df: DataFrame, per_group: bool = False) -> DataFrame:
        return ev.sales_levels(self.predicted_and_actual(df), self.config.spec, per_group)

    def predicted_and_actual(self, df: DataFrame) -> DataFrame:
        """Predictions beside what came, from one preparation of the rows."""
        return self._scored(df, False, True)

    def predict_next(
        self,
        df: DataFrame,
        n: int | None = None,
        kind: str = "bar",
        seconds: int | None = None,
        roll: bool = False,
        future: DataFrame | None = None,
    ) -> DataFrame:
        """Next ``n`` values of every target for every group from its newest window:
        ``(group..., last time, step, future time, target, prediction)``.

        The model itself looks as far as its horizon. With ``roll`` it goes on from there: what it
        predicted becomes the newest rows of the window, horizon after horizon. In those rows a
        target that is a feature is its prediction, calendar features are those of the future
        time, columns of ``future`` (by group and time) are what it says, and any other feature
        repeats its last value. A group is one row throughout: its window."""
        c = self.config
        n = n or c.horizon
        if n > c.horizon and not roll:
            raise ValueError(f"the model looks {c.horizon} steps ahead, not {n}; roll=True goes on from its predictions")
        scaled_panel, scaled, codes = self._encoded_scaled(base_features(df, c))
        newest = latest_window(scaled_panel, c.spec, scaled, c.sequence_length, last_columns=tuple(codes))
        seconds = seconds or c.spec.step or 86400
        when = future_timestamps(newest.select(*c.spec.keys), c.spec.time, n, kind, seconds)
        if n <= c.horizon:
            prepared = newest.withColumn("features", _vector(c, codes))
            steps = self.predict_prepared(prepared).withColumnRenamed("horizon", "step").filter(F.col("step") <= n)
        else:
            newest = cut_lineage(newest)  # a row per group
            when = future_timestamps(newest.select(*c.spec.keys), c.spec.time, n, kind, seconds)
            steps = self._rolled(newest, codes, n, self._known_ahead(when, future))
        return when.join(steps, [*c.spec.keys, "step"], "inner")

    def _known_ahead(self, when: DataFrame, future: DataFrame | None) -> DataFrame | None:
        """Features known for the steps ahead, scaled, as ``_ahead``: a map by step of each group
        from feature to value; a missing value is left to the last known one."""
        c = self.config
        time = c.spec.time
        rows = when.select(*c.spec.groups, "step", F.col("future_ts").alias(time))
        known: list[str] = []
        if c.date_cycles is not None:
            rows = date_features(rows, time, has_time=c.date_cycles)
            known = [f for f in self.features if f in rows.columns]
        if future is not None:
            given = [f for f in self.features if f in future.columns and f not in known]
            table = future.select(*c.spec.groups, time, *given)
            match = reduce(and_, [rows[k].eqNullSafe(table[k]) for k in (*c.spec.groups, time)])
            rows = rows.join(table, match, "left").select(*[rows[k] for k in rows.columns], *given)
            known += given
        if not known:
            return None
        rows = self.scaler.transform(rows, known)
        values = F.map_from_arrays(F.array(*[F.lit(f) for f in known]), F.array(*[F.col(f).cast("double") for f in known]))
        entry = F.struct(F.col("step").alias("key"), values.alias("value"))
        return rows.groupBy(*c.spec.groups).agg(F.map_from_entries(F.collect_list(entry)).alias("_ahead"))

    def _rolled(self, newest: DataFrame, codes: list[str], n: int, ahead: DataFrame | None) -> DataFrame:
        """Predictions of ``n`` steps, a horizon at a time; each turn is written, so that no plan
        grows with ``n``."""
        c = self.config
        state = self.scaler.attach(newest)
        if ahead is not None and c.spec.groups:
            table = ahead.select(*[F.col(g).alias(f"_of_{g}") for g in c.spec.groups], "_ahead")
            match = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in c.spec.groups])
            state = state.join(table, match, "left").drop(*[f"_of_{g}" for g in c.spec.groups])
        elif ahead is not None:
            state = state.withColumn("_ahead", ahead.scalar())
        parts = []
        for done in range(0, n, c.horizon):
            now = state.withColumn("features", _vector(c, codes))
            for name in self.targets:
                now = self.regressors[name].transform(now)
            raw = {name: F.col(f"{name}_raw") * F.col(scale_of(name)) + F.col(center(name)) for name in self.targets}
            now = cut_lineage(now.withColumns({f"_next_{name}": v for name, v in raw.items()}).drop("features", *[f"{t}_raw" for t in self.targets]))
            steps = [
                F.struct(F.lit(t).alias("target"), F.lit(done + h).alias("step"), F.col(f"_next_{target_name(t, h)}").alias("prediction"))
                for t in c.targets
                for h in range(1, c.horizon + 1)
            ]
            parts.append(now.select(*c.spec.keys, F.inline(F.array(*steps))))
            last = F.element_at("window", -1)
            rows = []
            for h in range(1, c.horizon + 1):
                cells = []
                for k, f in enumerate(self.features):
                    cell = last[k]
                    if f in c.targets:
                        cell = (F.col(f"_next_{target_name(f, h)}") - F.col(center(f))) / F.col(scale_of(f))
                    elif ahead is not None:
                        cell = F.coalesce(F.col("_ahead")[done + h][f], cell)
                    cells.append(cell)
                rows.append(F.array(*cells))
            window = F.slice(F.concat("window", F.array(*rows)), -c.sequence_length, c.sequence_length)
            state = now.withColumn("window", window).drop(*[f"_next_{t}" for t in self.targets])
        return reduce(DataFrame.unionByName, parts).filter(F.col("step") <= n)

    def save(self, path: str) -> None:
        """Parameter tables as parquet, regressors in their own format, settings as JSON.
        Hooks are code and must be given again when loading."""
        c = self.config
        spark = self.scaler.params.sparkSession
        settings = {k: v for k, v in asdict(replace(c, hooks=())).items() if k not in ("hooks", "spec")}
        doc = {"config": settings, "spec": asdict(c.spec), "features": list(self.features), "one_pass": self._linear() is not None}
        spark.createDataFrame([(json.dumps(doc),)], "value string").write.mode("overwrite").text(f"{path}/settings")
        self.scaler.params.write.mode("overwrite").parquet(f"{path}/scaler")
        if self.labels is not None:
            self.labels.table.write.mode("overwrite").parquet(f"{path}/labels")
        linear = self._linear()
        if linear is not None:
            rows = [(n, m.coefficients.tolist(), [w.tolist() for w in m.categories], m.intercept) for n, m in self.regressors.items()]
            spark.createDataFrame(rows, _WEIGHTS).write.mode("overwrite").parquet(f"{path}/weights")
            return
        for name, model in self.regressors.items():
            model.write().overwrite().save(f"{path}/regressors/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, hooks: tuple = ()) -> "PanelForecastModel":
        doc = json.loads(spark.read.text(f"{path}/settings").first()[0])
        spec = PanelSpec(**doc["spec"])
        settings = {k: tuple(v) if isinstance(v, list) else v for k, v in doc["config"].items()}
        c = ForecastConfig(spec=spec, hooks=hooks, **settings)
        groups = tuple(spec.groups) if c.scale_per_group else ()
        names = target_names(list(c.targets), c.horizon)

        def table(part):
            t = spark.read.parquet(f"{path}/{part}")
            return t, bytes_of(t)

        params, size = table("scaler")
        labels = None
        if c.encoded:
            t, _ = table("labels")
            labels = LabelMap(tuple(c.encoded), t).sized()
        if doc["one_pass"]:
            regressors = {
                r["target"]: ls.LinearWeights(
                    np.array(r["coefficients"]), tuple(map(np.array, r["categories"])), r["intercept"], "features", f"{r['target']}_raw"
                )
                for r in spark.read.parquet(f"{path}/weights").collect()  # a row per target and horizon
            }
        else:
            loader = _LOADERS[c.regressor]
            regressors = {n: loader.load(f"{path}/regressors/{n}") for n in names}
        return PanelForecastModel(
            c,
            tuple(doc["features"]),
            labels,
            ScalerModel(c.scaler, (*doc["features"], *names), groups, params, size),
            regressors,
        )


_WEIGHTS = "target string, coefficients array<double>, categories array<array<double>>, intercept double"


def return_forecast_features(df: DataFrame, spec: PanelSpec, horizons=(1, 2, 3, 4, 5)) -> DataFrame:
    """Indicators and forward returns in one pass, reduced to the inputs of a return model;
    rows in the warm-up or without a complete future are dropped."""
    require_columns(df, *OHLCV)
    out = over_blocks(df, spec, *technical_features(fill_warmup=True), forward_returns("close", tuple(horizons)))
    inputs = ["close", "relative_volume", "intraday_momentum", "rsi_14", "bb_position"]
    returns = return_column_names(list(horizons))
    return out.select(spec.time, *spec.groups, *inputs, *returns).na.drop(subset=[*inputs, *returns])


def score_in_pandas(prepared: DataFrame, keys: list[str], score: Callable, target: str, horizon: int = 1) -> DataFrame:
    """Score windows with a user's own model, batch by batch: ``score`` gets a pandas series
    of flattened windows and returns one prediction per window."""
    flat = prepared.select(*keys, F.flatten("window").alias("_x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields if f.name != "_x")
    schema = f"{fields}, target string, horizon int, prediction double"

    def run(batches: Iterable):
        for pdf in batches:
            out = pdf[keys].copy()
            out["target"], out["horizon"] = target, horizon
            out["prediction"] = score(pdf["_x"])
            yield out

    return flat.mapInPandas(run, schema)
