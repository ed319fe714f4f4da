"""Experiment log: one wide row per run, and the questions asked of it."""

from __future__ import annotations

import time as clock
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources import commit

# Columns of the experiment log, in file order.
SCHEMA = (
    "experiment_id string, experiment_name string, timestamp string, config_file string, "
    "preprocessing_version string, model_type string, d_token int, n_layers int, n_heads int, "
    "pooling_type string, sequence_length int, prediction_horizon int, scaler_type string, epochs int, "
    "batch_size int, learning_rate double, train_samples int, val_samples int, test_samples int, "
    "train_mae double, train_rmse double, train_rmspe double, val_mae double, val_rmse double, "
    "val_rmspe double, training_time_mins double, best_epoch int, train_predictions_file string, "
    "val_predictions_file string, test_predictions_file string, model_path string, notes string"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]

# What the listings show.
LIST_COLUMNS = (
    "experiment_id", "experiment_name", "timestamp", "val_rmspe", "val_mae", "val_rmse", "train_rmspe",
    "epochs", "d_token", "n_layers", "sequence_length", "preprocessing_version",
)
SUMMARY_METRICS = ("val_rmspe", "val_mae", "val_rmse", "train_rmspe")
COMPARE_COLUMNS = (
    "experiment_id", "experiment_name", "timestamp", "config_file", "val_rmspe", "val_mae", "val_rmse",
    "train_rmspe", "d_token", "n_layers", "n_heads", "sequence_length", "epochs", "batch_size",
    "learning_rate", "preprocessing_version", "training_time_mins", "best_epoch", "train_samples", "val_samples",
)


def _path_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path).schema
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return False
        raise


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """The log, or an empty frame of the same columns if there is none yet."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


def append_experiments(rows: DataFrame, path: str) -> None:
    """Append rows to the log; missing columns are null."""
    fields = dict(part.split() for part in SCHEMA.split(", "))
    full = rows.select(
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]
    )
    full.write.mode("append").option("header", True).csv(path)


def append_experiment(spark: SparkSession, path: str, **values) -> None:
    unknown = set(values) - set(COLUMNS)
    if unknown:
        raise ValueError(f"no such experiment columns: {sorted(unknown)}")
    row = spark.createDataFrame([tuple(values.get(c) for c in COLUMNS)], SCHEMA)
    append_experiments(row, path)


def next_experiment_id(df: DataFrame) -> str:
    """exp_001, exp_002, ...: one above the highest number in the log."""
    number = F.expr("try_cast(nullif(regexp_extract(experiment_id, '^exp_([0-9]+)$', 1), '') as int)")
    top = df.agg(F.max(number)).first()[0]
    return f"exp_{(top or 0) + 1:03d}"


def claim_experiment_id(spark: SparkSession, path: str) -> str:
    """An id no other run has: one above the highest in the log, or the next one after it that no
    run at work has claimed (below ``path/_ids``)."""
    number = int(next_experiment_id(read_experiments(spark, path)).removeprefix("exp_"))
    while not commit.claim(spark, f"{path}/_ids/exp_{number:03d}"):
        number += 1
    return f"exp_{number:03d}"


def list_experiments(df: DataFrame, sort_by: str = "val_rmspe") -> DataFrame:
    shown = [c for c in LIST_COLUMNS if c in df.columns]
    out = df.orderBy(F.col(sort_by).asc_nulls_last(), "experiment_id") if sort_by in df.columns else df
    return out.select(*shown)


def best_experiments(df: DataFrame, n: int = 5, metric: str = "val_rmspe") -> DataFrame:
    """The ``n`` smallest values of a metric, ranked. Ranking runs on the ``n`` rows kept."""
    if metric not in df.columns:
        raise ValueError(f"no metric {metric!r}")
    order = [F.col(metric).asc_nulls_last(), F.col("experiment_id")]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def compare_experiments(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.filter(F.col("experiment_id").isin(*ids)).select(*[c for c in COMPARE_COLUMNS if c in df.columns])


def experiment_summary(df: DataFrame) -> DataFrame:
    """Count, best run, mean and sample std of the metrics, total and average time."""
    metrics = [m for m in SUMMARY_METRICS if m in df.columns]
    aggs = [F.count(F.lit(1)).alias("experiments")]
    if "val_rmspe" in metrics:
        order = F.when(F.col("val_rmspe").isNotNull(), F.struct("val_rmspe", "experiment_id"))
        aggs += [F.min("val_rmspe").alias("best_val_rmspe"), F.min_by("experiment_id", order).alias("best_experiment")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    if "training_time_mins" in df.columns:
        aggs += [F.avg("training_time_mins").alias("avg_time_mins"), F.sum("training_time_mins").alias("total_time_mins")]
    return df.agg(*aggs)


def top_versions(df: DataFrame, n: int = 5) -> DataFrame:
    counts = df.groupBy("preprocessing_version").agg(F.count(F.lit(1)).alias("experiments"))
    return counts.orderBy(F.desc("experiments"), "preprocessing_version").limit(n)


def run_experiment(
    spark: SparkSession, train: DataFrame, val: DataFrame, config, *, log_path: str, out_path: str, name: str,
    test: DataFrame | None = None, stop_early: bool = False, **notes,
) -> str:
    """Fit, evaluate and log one run; predictions, metrics and model go below ``out_path``. ``test``
    rows need no targets: they are scored, and their predictions written, beside those of the
    other rows. With ``stop_early`` the fit goes by rounds against the validation rows, and the
    best round is logged. Runs at the same time get ids of their own."""
    from panelwright.operators.evaluate import OVERALL, sales_levels
    from panelwright.operators.forecast import PanelForecaster
    from panelwright.sources.sinks import write_csv, write_errors_rmspe, write_metrics_json

    experiment_id = claim_experiment_id(spark, log_path)
    train, val = (d.persist(StorageLevel.MEMORY_AND_DISK) for d in (train, val))
    started = clock.time()
    model = PanelForecaster(config).fit(train, val if stop_early else None)
    minutes = (clock.time() - started) / 60
    base = f"{out_path}/{experiment_id}"
    values, files = {}, {}
    metrics = {}
    for label, frame in (("train", train), ("val", val)):
        aligned = model.predicted_and_actual(frame).persist(StorageLevel.MEMORY_AND_DISK)
        files[label] = f"{base}/{label}_predictions"
        write_errors_rmspe(aligned, files[label], list(config.spec.keys))
        metrics[label] = sales_levels(aligned, config.spec).collect()  # a row per target and horizon
        aligned.unpersist()
        row = next(r for r in metrics[label] if r["horizon"] == OVERALL and r["target"] == config.targets[0])
        values.update({f"{label}_mae": row["MAE"], f"{label}_rmse": row["RMSE"], f"{label}_rmspe": row["RMSPE"]})
        values[f"{label}_samples"] = frame.count()
    if test is not None:
        files["test"] = f"{base}/test_predictions"
        write_csv(model.predict(test, inference=True), files["test"])
        values["test_samples"] = test.count()
    if model.history:
        values["best_epoch"] = max(course.kept for course in model.history.values())
        values["epochs"] = config.rounds
    model.save(f"{base}/model")
    rows = [{"dataset": label, **r.asDict()} for label, found in metrics.items() for r in found]
    write_metrics_json(spark.createDataFrame(rows), f"{base}/metrics", experiment_id=experiment_id, experiment_name=name)
    append_experiment(
        spark,
        log_path,
        experiment_id=experiment_id,
        experiment_name=name,
        timestamp=datetime.now().strftime("%Y-%m-%d %H:%M:%S"),
        model_type=config.regressor,
        sequence_length=config.sequence_length,
        prediction_horizon=config.horizon,
        scaler_type=config.scaler,
        training_time_mins=minutes,
        train_predictions_file=files["train"],
        val_predictions_file=files["val"],
        test_predictions_file=files.get("test"),
        model_path=f"{base}/model",
        **values,
        **notes,
    )
    train.unpersist()
    val.unpersist()
    return experiment_id
