"""Lookback windows as arrays of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.plans.blocks import BlockFrame, CellTable, Feature, over_blocks
from panelwright.spec import PanelSpec, require_columns


def lookback(features: list[str], length: int, name: str = "window") -> Feature:
    """The last ``length`` rows up to the current one as an array of feature arrays."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        row = F.array(*[F.col(c).cast("double") for c in features])
        return d.withColumn(name, F.collect_list(row).over(w.trailing(length)))

    return Feature(build, before=length - 1)


def sequence_windows(
    df: DataFrame,
    spec: PanelSpec,
    features: list[str],
    length: int,
    name: str = "window",
    cells: CellTable | None = None,
    extra: tuple[Feature, ...] = (),
) -> DataFrame:
    """One row per complete window, carried by the window's last row with all its columns
    (category codes and targets included). Groups with no more than ``length`` rows have no
    window."""
    if not features:
        raise ValueError("windows need at least one feature")
    require_columns(df, *features)
    out = over_blocks(df, spec, lookback(features, length, name), *extra, cells=cells, keep_position=True)
    kept = out.filter((F.col("_pos") >= length) & (F.col("_group_rows") > length))
    return kept.drop("_pos", "_group_rows")


def latest_window(
    df: DataFrame,
    spec: PanelSpec,
    features: list[str],
    length: int,
    name: str = "window",
    last_columns: tuple[str, ...] = (),
) -> DataFrame:
    """The newest window of every group with more than ``length`` rows: keys, time of the
    last row, the window and ``last_columns`` of the last row. Only the newest cells are
    shuffled and only ``length`` rows of a group meet in one place."""
    require_columns(df, *features, *spec.keys, *last_columns)
    used = list(dict.fromkeys([*spec.groups, *spec.order, *features, *last_columns]))
    out = over_blocks(df.select(*used), spec, keep_position=True, tail=length)
    recent = out.filter((F.col("_group_rows") > length) & (F.col("_pos") > F.col("_group_rows") - length))
    row = F.struct("_pos", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    grouped = recent.groupBy(*spec.groups).agg(
        F.max(spec.time).alias(spec.time),
        F.array_sort(F.collect_list(row)).alias("_rows"),
        *[F.max_by(F.col(c), F.col("_pos")).alias(c) for c in last_columns],
    )
    window = F.transform("_rows", lambda r: r["x"]).alias(name)
    return grouped.select(*spec.groups, spec.time, window, *last_columns)
