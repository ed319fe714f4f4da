"""Tumbling bars per group and the preparation chain for minute data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.clean import fill_backward_zero, filter_market_hours
from panelwright.spec import PanelSpec, require_columns, timeframe


def _order(spec: PanelSpec) -> Column:
    return F.struct(*spec.order) if spec.tiebreak else F.col(spec.time)


def _first(name: str, spec: PanelSpec) -> Column:
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), _order(spec)))


def _last(name: str, spec: PanelSpec) -> Column:
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), _order(spec)))


def bar_aggregates(columns, spec: PanelSpec) -> list[Column]:
    aggs = [
        _first("open", spec).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        _last("close", spec).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
    ]
    if "open_interest" in columns:
        aggs.append(_last("open_interest", spec).alias("open_interest"))
    return aggs


def resample_ohlcv(df: DataFrame, tf: str, spec: PanelSpec, extra_aggs: list[Column] = ()) -> DataFrame:
    """OHLCV bars of one timeframe per group; bars with any missing value are dropped and
    empty bars never appear. Equal times are ordered by the tiebreak columns. One shuffle on
    (group, bar) after a map-side combine, so a hot group spreads over its bars. Without a
    tiebreak (times unique per group) the aggregate runs on hashes and needs no sort."""
    seconds = timeframe(tf)["seconds"]
    require_columns(df, *spec.groups, *spec.order, "open", "high", "low", "close", "volume")
    bar = F.window(F.col(spec.time).cast("timestamp_ntz"), f"{seconds} seconds").start
    aggs = bar_aggregates(df.columns, spec)
    # the bar comes first: comparing times is cheaper than comparing names where rows are sorted
    out = df.withColumn("_bar", bar).groupBy("_bar", *spec.groups).agg(*aggs, *extra_aggs)
    names = [c for c in out.columns if c not in (*spec.groups, "_bar")]
    return out.select(*spec.groups, F.col("_bar").alias(spec.time), *names).na.drop(
        subset=[c for c in names if c in ("open", "high", "low", "close", "volume", "open_interest")]
    )


def bar_spec(spec: PanelSpec, tf: str) -> PanelSpec:
    """Spec of the resampled panel: bars are unique, so no tiebreak is left."""
    return replace(spec, tiebreak=(), step=timeframe(tf)["seconds"])


def prepare_intraday(df: DataFrame, tf: str, spec: PanelSpec, country: str = "US") -> DataFrame:
    """Session filter, then bars (1-minute data is passed on as it is). Lazy and unordered;
    sort the final output if a file needs it."""
    inside = filter_market_hours(df, spec.time, country)
    return inside if tf == "1min" else resample_ohlcv(inside, tf, spec)


@dataclass(frozen=True)
class PreparedPanel:
    frame: DataFrame
    spec: PanelSpec
    timeframe: str
    country: str
    sequence_length: int


def prepare_intraday_for_training(df: DataFrame, tf: str, spec: PanelSpec, country: str = "US") -> PreparedPanel:
    """``prepare_intraday`` plus backward fill and the recommended lookback length."""
    bars = prepare_intraday(df, tf, spec, country)
    new_spec = spec if tf == "1min" else bar_spec(spec, tf)
    filled = fill_backward_zero(bars, new_spec)
    return PreparedPanel(filled, new_spec, tf, country, timeframe(tf)["sequence_length"])
