"""Writing predictions, errors, metrics and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.arithmetic import clip_lower, error_columns, rmspe_contribution
from panelwright.spec import PanelSpec


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; times keep their microseconds."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", stamp).csv(path)


def wide_predictions(aligned: DataFrame, spec: PanelSpec, targets: list[str], horizon: int) -> DataFrame:
    """One row per key with ``{target}_actual_h{h}`` and ``{target}_pred_h{h}``."""
    aggs = []
    for t in targets:
        for h in range(1, horizon + 1):
            here = (F.col("target") == t) & (F.col("horizon") == h)
            aggs.append(F.max(F.when(here, F.col("actual"))).alias(f"{t}_actual_h{h}"))
            aggs.append(F.max(F.when(here, F.col("prediction"))).alias(f"{t}_pred_h{h}"))
    return aligned.groupBy(*spec.keys).agg(*aggs)


def write_predictions(
    aligned: DataFrame, path: str, spec: PanelSpec, targets: list[str], horizon: int, metrics: DataFrame | None = None
) -> None:
    """``predictions`` sorted by group and time, and ``metrics`` beside it."""
    write_csv(wide_predictions(aligned, spec, targets, horizon).orderBy(*spec.keys), f"{path}/predictions")
    if metrics is not None:
        write_csv(metrics, f"{path}/metrics")


def predictions_with_split(train: DataFrame, test: DataFrame, spec: PanelSpec) -> DataFrame:
    """Train and test rows with their label, absolute and percentage error (null where the
    actual value is 0)."""
    both = train.withColumn("dataset", F.lit("train")).unionByName(test.withColumn("dataset", F.lit("test")))
    a, p = F.col("actual"), F.col("prediction")
    return both.withColumns(
        {
            "error": F.abs(a - p),
            "error_pct": F.when(a != 0, F.try_divide(F.abs(a - p), a) * 100.0),
        }
    )


def write_predictions_with_split(train: DataFrame, test: DataFrame, path: str, spec: PanelSpec) -> None:
    write_csv(predictions_with_split(train, test, spec).orderBy(spec.time, *spec.groups), path)


def combined_intraday(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the given parts (train, validation, test, future), each labelled
    ``data_split``; columns a part lacks are null."""
    out = None
    for label, part in parts.items():
        part = part.withColumn("data_split", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no part given")
    return out


def write_combined_intraday(parts: dict[str, DataFrame], path: str, metrics: DataFrame | None = None) -> None:
    write_csv(combined_intraday(parts), f"{path}/predictions")
    if metrics is not None:
        write_csv(metrics, f"{path}/metrics")


def submission(df: DataFrame, id_column: str = "Id", prediction: str = "prediction") -> DataFrame:
    return df.select(F.col(id_column).cast("int").alias("Id"), clip_lower(prediction).alias("Sales"))


def write_submission(df: DataFrame, path: str, id_column: str = "Id", prediction: str = "prediction") -> None:
    write_csv(submission(df, id_column, prediction), path)


def errors_table(aligned: DataFrame, keys: list[str], dataset: str | None = None, contribution: bool = False) -> DataFrame:
    """Sales error table. Without an ``actual`` column only the predictions are kept."""
    if "actual" not in aligned.columns:
        return aligned.select(*keys, F.col("prediction").alias("Predicted_Sales"))
    e = error_columns("actual", "prediction", zero_actual=0.0)
    cols = [
        F.col("actual").alias("Actual_Sales"),
        F.col("prediction").alias("Predicted_Sales"),
        e["error"].alias("Error"),
        e["abs_error"].alias("Abs_Error"),
        e["pct_error"].alias("Pct_Error"),
    ]
    if contribution:
        cols.append(rmspe_contribution("actual", "prediction").alias("RMSPE_Contribution"))
    if dataset is not None:
        cols.append(F.lit(dataset).alias("Dataset"))
    return aligned.select(*keys, *cols)


def write_errors(aligned: DataFrame, path: str, keys: list[str], dataset: str) -> None:
    write_csv(errors_table(aligned, keys, dataset), path)


def write_errors_rmspe(aligned: DataFrame, path: str, keys: list[str]) -> None:
    write_csv(errors_table(aligned, keys, contribution=True), path)


def combine_predictions(spark: SparkSession, paths: dict[str, str | None], schema=None) -> DataFrame:
    """Union of the existing split files; a missing ``Dataset`` label is added."""
    from panelwright.operators.experiments import _path_exists
    from panelwright.sources.readers import read_table

    out = None
    for label, path in paths.items():
        if not path or not _path_exists(spark, path):
            continue
        part = read_table(spark, path, schema, fmt="csv")
        if "Dataset" not in part.columns:
            part = part.withColumn("Dataset", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no prediction files found")
    return out


def split_counts(combined: DataFrame) -> DataFrame:
    return combined.groupBy("Dataset").agg(F.count(F.lit(1)).alias("rows"))


def metrics_documents(metrics: DataFrame, **info: str) -> DataFrame:
    """One JSON text per metric row, with the run's details."""
    details = [F.lit(v).alias(k) for k, v in info.items()]
    return metrics.select(F.to_json(F.struct(*details, *metrics.columns)).alias("value"))


def write_metrics_json(metrics: DataFrame, path: str, **info: str) -> None:
    metrics_documents(metrics, **info).write.mode("overwrite").text(path)
