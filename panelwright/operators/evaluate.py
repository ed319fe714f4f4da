"""Joining predictions with actual values and measuring the error.

Long form throughout: one row per (group..., time, target, horizon).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.arithmetic import col
from panelwright.operators.targets import target_name
from panelwright.plans.blocks import BlockFrame, Feature, over_blocks
from panelwright.session import cut_lineage
from panelwright.spec import PanelSpec, require_columns

METRICS = ("MAE", "MSE", "RMSE", "MAPE", "R2", "Directional_Accuracy")
OVERALL = "overall"


def actuals_long(df: DataFrame, spec: PanelSpec, targets: list[str], horizon: int, value: str = "actual") -> DataFrame:
    """Shifted target columns as rows; missing values are left out."""
    return _melt(df, spec, {(t, h): F.col(target_name(t, h)) for t in targets for h in range(1, horizon + 1)}, value)


def persistence_forecast(df: DataFrame, spec: PanelSpec, targets: list[str], horizon: int) -> DataFrame:
    """Predicts every horizon with the current value."""
    return _melt(df, spec, {(t, h): F.col(t) for t in targets for h in range(1, horizon + 1)}, "prediction")


def _melt(df: DataFrame, spec: PanelSpec, cells: dict[tuple[str, int], Column], value: str) -> DataFrame:
    rows = [
        F.struct(F.lit(t).alias("target"), F.lit(h).alias("horizon"), c.cast("double").alias(value))
        for (t, h), c in cells.items()
    ]
    return df.select(*spec.keys, F.inline(F.array(*rows))).filter(F.col(value).isNotNull())


def align(predictions: DataFrame, actuals: DataFrame, spec: PanelSpec) -> DataFrame:
    """Inner join on (group..., time, target, horizon). The key is as fine as the rows, so no
    group is gathered anywhere."""
    return predictions.join(actuals, [*spec.keys, "target", "horizon"], "inner")


def with_direction(df: DataFrame, spec: PanelSpec, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """Adds ``direction_hit``: 1 if actual and prediction both rise (or both do not) against
    the previous row of the same group, target and horizon, null for the first row. With
    ``count_first`` the rows are written once to the shared folder, since counting and
    ordering would otherwise both run the forecast."""
    if spec.count_first:
        df = cut_lineage(df)
    series = spec.with_groups(*spec.groups, *[c for c in ("target", "horizon") if c in df.columns])

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        up = F.col(actual) - F.lag(actual).over(w.ordered) > 0
        pred_up = F.col(predicted) - F.lag(predicted).over(w.ordered) > 0
        return d.withColumn("direction_hit", (up == pred_up).cast("int"))

    return over_blocks(df, series, Feature(build, before=1))


def regression_aggregates(actual: str = "actual", predicted: str = "prediction", direction: bool = True) -> list[Column]:
    """MAE, MSE, RMSE, MAPE (zero actuals left out), R2 and directional accuracy. Over no
    rows everything is null."""
    a, p = F.col(actual), F.col(predicted)
    sq = F.pow(a - p, F.lit(2.0))
    n, res = F.count(a), F.sum(sq)
    total = F.var_pop(a) * n
    r2 = F.when(total == 0, F.when(res == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))).otherwise(
        1.0 - F.try_divide(res, total)
    )
    out = [
        F.avg(F.abs(a - p)).alias("MAE"),
        F.avg(sq).alias("MSE"),
        F.sqrt(F.avg(sq)).alias("RMSE"),
        (F.avg(F.when(a != 0, F.abs(F.try_divide(a - p, a)))) * 100.0).alias("MAPE"),
        r2.alias("R2"),
    ]
    if direction:
        out.append((F.avg("direction_hit") * 100.0).alias("Directional_Accuracy"))
    return out


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row of metrics over all rows; directional accuracy only if ``direction_hit`` is
    there (see ``with_direction``)."""
    return df.agg(*regression_aggregates(actual, predicted, "direction_hit" in df.columns))


#: What a set of rows adds to its metrics; the states of two sets add up to that of their union.
_SUMS = ("_n", "_abs", "_sq", "_pct", "_pcts", "_hit", "_hits", "_rel")


def _states(df: DataFrame, keys: list[str]) -> DataFrame:
    """One mergeable state per ``keys``: counts, sums, and mean and squared deviations of the actual
    values."""
    a, p = F.col("actual"), F.col("prediction")
    both = F.when(a.isNotNull() & p.isNotNull(), a - p)
    share = F.when(a != 0, F.try_divide(both, a))
    hit = F.col("direction_hit") if "direction_hit" in df.columns else F.lit(None).cast("int")
    return df.groupBy(*keys).agg(
        F.count(a).alias("_rows"), F.avg(a).alias("_mean"), (F.var_pop(a) * F.count(a)).alias("_m2"),
        F.count(both).alias("_n"), F.sum(F.abs(both)).alias("_abs"), F.sum(both * both).alias("_sq"),
        F.sum(F.abs(share)).alias("_pct"), F.count(share).alias("_pcts"), F.sum(hit).alias("_hit"), F.count(hit).alias("_hits"),
        F.sum(share * share).alias("_rel"),
    )


def _merged(states: DataFrame, level: list[str], by_group: bool) -> DataFrame:
    """States of a coarser level. Deviations are taken from the level's own mean, so that large
    values do not swallow them. A group has a state per horizon, which a window holds; the means
    of the other levels are a row per target and horizon and are broadcast."""
    rows, total = F.col("_rows") * F.col("_mean"), F.col("_rows")
    if by_group:
        own = Window.partitionBy(*level)
        placed = states.withColumn("_centre", F.try_divide(F.sum(rows).over(own), F.sum(total).over(own)))
    else:
        centre = states.groupBy(*[F.col(c).alias(f"_of_{c}") for c in level]).agg(F.try_divide(F.sum(rows), F.sum(total)).alias("_centre"))
        match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in level])
        placed = states.join(F.broadcast(centre), match)
    away = F.col("_mean") - F.col("_centre")
    m2 = F.sum("_m2") + F.sum(F.col("_rows") * away * away)
    return placed.groupBy(*level).agg(F.sum("_rows").alias("_rows"), m2.alias("_m2"), *[F.sum(c).alias(c) for c in _SUMS])


def _metrics_of(direction: bool, rmspe: bool) -> list[Column]:
    mse = F.try_divide(F.col("_sq"), F.col("_n"))
    total, res = F.col("_m2"), F.col("_sq")
    r2 = F.when(total == 0, F.when(res == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))).otherwise(1.0 - F.try_divide(res, total))
    out = [
        F.try_divide(F.col("_abs"), F.col("_n")).alias("MAE"), mse.alias("MSE"), F.sqrt(mse).alias("RMSE"),
        (F.try_divide(F.col("_pct"), F.col("_pcts")) * 100.0).alias("MAPE"), r2.alias("R2"),
    ]
    if direction:
        out.append((F.try_divide(F.col("_hit").cast("double"), F.col("_hits")) * 100.0).alias("Directional_Accuracy"))
    if rmspe:
        out.append(F.coalesce(F.sqrt(F.try_divide(F.col("_rel"), F.col("_pcts"))), F.lit(0.0)).alias("RMSPE"))
    return out


def metrics_by(df: DataFrame, groups: list[str], rmspe: bool = False) -> DataFrame:
    """Metrics per target at four levels: overall, per horizon, per group, per group and horizon.
    Levels that are summed over show ``overall``. The rows are aggregated once, at the finest
    level; the other levels add up its states."""
    require_columns(df, "target", "horizon", *groups)
    keys = ["target", "horizon", *groups]
    levels = [["target"], ["target", "horizon"], ["target", *groups], keys]
    fine = _states(df, keys)
    names = _metrics_of("direction_hit" in df.columns, rmspe)

    def shown(level: list[str]) -> DataFrame:
        states = fine if level == keys else _merged(fine, level, len(level) > 1 and level[-1] in groups)
        cells = [F.col(c).cast("string").alias(c) if c in level else F.lit(OVERALL).alias(c) for c in keys if c != "target"]
        return states.select("target", *cells, *names)

    return reduce(DataFrame.unionByName, map(shown, levels if groups else levels[:2]))


def flatten_metrics(df: DataFrame, dataset: str, groups: list[str], metrics=METRICS) -> DataFrame:
    """Wide metrics as rows ``(dataset, group, target, horizon, metric, value)``; horizons are
    written ``overall`` or ``horizon_h``, composite groups joined by a bar."""
    names = [m for m in metrics if m in df.columns]
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    group = F.concat_ws("|", *groups) if groups else F.lit(OVERALL)
    if groups:
        is_all = F.col(groups[0]) == OVERALL
        group = F.when(is_all, F.lit(OVERALL)).otherwise(group)
    horizon = F.col("horizon").cast("string")
    horizon = F.when(horizon == OVERALL, horizon).otherwise(F.concat(F.lit("horizon_"), horizon))
    return df.select(
        F.lit(dataset).alias("dataset"),
        group.alias("group"),
        "target",
        horizon.alias("horizon"),
        F.inline(F.array(*cells)),
    )


def rmspe(actual: Column | str, predicted: Column | str, exclude_zeros: bool = True) -> Column:
    """Root mean square percentage error as a fraction; 0 if every actual is 0."""
    a, p = col(actual), col(predicted)
    share = F.try_divide(a - p, a)
    if exclude_zeros:
        share = F.when(a != 0, share)
    return F.coalesce(F.sqrt(F.avg(F.pow(share, F.lit(2.0)))), F.lit(0.0))


def mape(actual: Column | str, predicted: Column | str) -> Column:
    """Mean absolute percentage error in percent; 0 if every actual is 0."""
    a, p = col(actual), col(predicted)
    return F.coalesce(F.avg(F.when(a != 0, F.abs(F.try_divide(a - p, a)))) * 100.0, F.lit(0.0))


def rmse(actual: Column | str, predicted: Column | str) -> Column:
    return F.sqrt(F.avg(F.pow(col(actual) - col(predicted), F.lit(2.0))))


def mae(actual: Column | str, predicted: Column | str) -> Column:
    return F.avg(F.abs(col(actual) - col(predicted)))


def sales_metrics(actual: str = "actual", predicted: str = "prediction") -> list[Column]:
    return [
        rmspe(actual, predicted).alias("RMSPE"),
        mape(actual, predicted).alias("MAPE"),
        rmse(actual, predicted).alias("RMSE"),
        mae(actual, predicted).alias("MAE"),
    ]


def evaluate(predictions: DataFrame, actuals: DataFrame, spec: PanelSpec, per_group: bool = False) -> DataFrame:
    """Aligned predictions -> metrics per target and horizon, and per group if wanted."""
    return evaluate_aligned(align(predictions, actuals, spec), spec, per_group)


def evaluate_aligned(aligned: DataFrame, spec: PanelSpec, per_group: bool = False) -> DataFrame:
    """Rows with prediction and actual -> metrics per target and horizon, and per group if wanted."""
    return metrics_by(with_direction(aligned, spec), list(spec.groups) if per_group else [])


def sales_levels(aligned: DataFrame, spec: PanelSpec, per_group: bool = False) -> DataFrame:
    """All levels of ``metrics_by`` with RMSPE in the same aggregate."""
    return metrics_by(with_direction(aligned, spec), list(spec.groups) if per_group else [], rmspe=True)
