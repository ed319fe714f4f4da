"""Bars and repeated-bar removal on streams: the batch operators with a watermark. The
batch definitions remain the reference for what is computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.resample import bar_aggregates
from panelwright.spec import PanelSpec, require_columns, timeframe


def resample_stream(stream: DataFrame, tf: str, spec: PanelSpec, lateness: str = "10 minutes") -> DataFrame:
    """OHLCV bars, each emitted once its end is older than the watermark. Append mode. State
    is one row per open (group, bar). The stream's time must be a timestamp with zone."""
    require_columns(stream, *spec.groups, *spec.order, "open", "high", "low", "close", "volume")
    bar = F.window(spec.time, f"{timeframe(tf)['seconds']} seconds")
    grouped = stream.withWatermark(spec.time, lateness).groupBy(bar.alias("_bar"), *spec.groups)
    out = grouped.agg(*bar_aggregates(stream.columns, spec))
    values = [c for c in out.columns if c not in (*spec.groups, "_bar")]
    return out.select(*spec.groups, F.col("_bar.start").alias(spec.time), *values).na.drop(subset=values)


def dedup_stream(stream: DataFrame, spec: PanelSpec, lateness: str = "10 minutes") -> DataFrame:
    """One row per (group, time) among rows that arrive within the watermark; of several
    copies the first to arrive stays."""
    return stream.withWatermark(spec.time, lateness).dropDuplicatesWithinWatermark(spec.keys)
