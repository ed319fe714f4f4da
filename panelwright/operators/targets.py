"""Future values as targets, and returns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.arithmetic import divide
from panelwright.plans.blocks import BlockFrame, CellTable, Feature, over_blocks
from panelwright.spec import PanelSpec, require_columns


def target_name(target: str, horizon: int) -> str:
    return f"{target}_target_h{horizon}"


def target_names(targets: list[str], horizon: int) -> list[str]:
    return [target_name(t, h) for t in targets for h in range(1, horizon + 1)]


def shifted_targets(targets: list[str], horizon: int) -> Feature:
    """Value of each target 1..horizon rows ahead in its group."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        return d.withColumns(
            {target_name(t, h): F.lead(t, h).over(w.ordered) for t in targets for h in range(1, horizon + 1)}
        )

    return Feature(build, after=horizon)


def shift_targets(
    df: DataFrame,
    spec: PanelSpec,
    targets: str | list[str],
    horizon: int = 1,
    drop_incomplete: bool = True,
    cells: CellTable | None = None,
) -> DataFrame:
    """Adds the shifted targets; rows that miss any of them are dropped by default. Rows
    without a group key belong to no series and are dropped too."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    require_columns(df, *spec.groups, *spec.order, *targets)
    if spec.groups:
        df = df.filter(reduce(and_, [F.col(g).isNotNull() for g in spec.groups]))
    out = over_blocks(df, spec, shifted_targets(targets, horizon), cells=cells)
    return out.na.drop(subset=target_names(targets, horizon)) if drop_incomplete else out


def return_column_names(horizons: list[int]) -> list[str]:
    return [f"return_{h}d" for h in horizons]


def forward_returns(price: str = "close", horizons=(1, 2, 3, 4, 5), kind: str = "percentage") -> Feature:
    """Return in percent from holding ``h`` rows ahead: simple or logarithmic."""
    if kind not in ("percentage", "log"):
        raise ValueError(f"unknown return kind {kind!r}; use percentage or log")

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        ahead = {f"_ahead_{h}": F.lead(price, h).over(w.ordered) for h in horizons}
        d = d.withColumns(ahead)
        now = F.col(price)
        new = {}
        for h, name in zip(horizons, return_column_names(horizons)):
            then = F.col(f"_ahead_{h}")
            new[name] = divide(then - now, now) * 100.0 if kind == "percentage" else _log(divide(then, now)) * 100.0
        return d.withColumns(new).drop(*ahead)

    return Feature(build, after=max(horizons))


def _log(ratio):
    """Natural logarithm; log(0) is minus infinity, a negative ratio has none."""
    return F.when(ratio == 0, F.lit(float("-inf"))).when(ratio > 0, F.ln(ratio))


def cumulative_return(price: str = "close") -> Feature:
    """Return in percent since the first row of the group."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        first = w.first_value(price)
        return d.withColumn("cumulative_return", divide(F.col(price) - first, first) * 100.0)

    return Feature(build, carry_first=(price,))


def return_validity(df: DataFrame, horizons: list[int]) -> DataFrame:
    """Share of rows with a value, per return column, in one aggregate."""
    names = return_column_names(horizons)
    require_columns(df, *names)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"{c}_valid") for c in names],
        *[F.try_divide(F.count(c) * 100.0, F.count(F.lit(1))).alias(f"{c}_valid_pct") for c in names],
    )


def validate_returns(df: DataFrame, horizons: list[int]) -> bool:
    """Raises unless every return column has values in at least 10 % of the rows."""
    row = return_validity(df, horizons).first()
    for c in return_column_names(horizons):
        if row[f"{c}_valid"] == 0:
            raise ValueError(f"{c} has no values")
        if row[f"{c}_valid_pct"] < 10:
            raise ValueError(f"{c} has values in only {row[f'{c}_valid_pct']:.1f} % of the rows")
    return True


def return_stats(df: DataFrame, horizons: list[int]) -> DataFrame:
    """Valid and missing rows per horizon with mean, sample std, min and max."""
    names = return_column_names(horizons)
    require_columns(df, *names)
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])))
    v = "value"
    return stacked.groupBy("column").agg(
        F.count(v).alias("valid"),
        F.count_if(F.col(v).isNull()).alias("missing"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
