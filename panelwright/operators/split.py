"""Chronological train / val / test split per group, and group sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.plans.blocks import CellTable, with_position
from panelwright.spec import PanelSpec


def split_time_series(
    df: DataFrame,
    spec: PanelSpec,
    test_size: int = 30,
    val_size: int | None = None,
    sequence_length: int = 1,
    include_overlap: bool = True,
    cells: CellTable | None = None,
) -> DataFrame:
    """Labels rows ``split`` in train / val / test: the newest ``test_size`` rows of a group
    are test, the ``val_size`` before them val, the rest train. With overlap the
    ``sequence_length - 1`` rows before val and test are repeated there, marked
    ``is_context``. Groups that are too short are left out; a panel without groups is kept as
    train instead. The result is one frame; filter on ``split``."""
    t, v = test_size, val_size or 0
    overlap = max(0, sequence_length - 1) if include_overlap else 0
    n = F.col("_group_rows")
    out = with_position(df, spec, cells)
    if spec.groups:
        out = out.filter(n >= t + v + 2 * sequence_length + 10)
        tested = F.lit(t > 0)
    else:
        tested = F.lit(t > 0) & (n > t)
    back = n - F.col("_pos") + 1  # 1 = newest row
    t_size = F.when(tested, F.lit(t)).otherwise(F.lit(0))
    has_val = F.lit(v > 0) & (n - t_size > v)
    if not spec.groups and t > 0:
        has_val = has_val & tested
    v_size = F.when(has_val, F.lit(v)).otherwise(F.lit(0))
    train_size = n - t_size - v_size
    in_test = tested & (back <= t_size)
    in_val = has_val & (back > t_size) & (back <= t_size + v_size)
    in_train = back > t_size + v_size
    val_context = (
        has_val & (train_size >= overlap) & (back > t_size + v_size) & (back <= t_size + v_size + overlap)
    )
    source_size = F.when(has_val, v_size).otherwise(train_size)
    test_context = tested & (source_size >= overlap) & (back > t_size) & (back <= t_size + overlap)

    def label(name, context):
        return F.struct(F.lit(name).alias("split"), F.lit(context).alias("is_context"))

    labels = F.array_compact(
        F.array(
            F.when(in_train, label("train", False)),
            F.when(in_val, label("val", False)),
            F.when(val_context, label("val", True)),
            F.when(in_test, label("test", False)),
            F.when(test_context, label("test", True)),
        )
    )
    return out.withColumn("_labels", labels).select(*df.columns, F.inline("_labels"))


def require_some_group(split: DataFrame) -> DataFrame:
    """Raises if no group was long enough to be split (one small job)."""
    if split.limit(1).isEmpty():
        raise ValueError("no group has enough rows for the requested split")
    return split


def group_sizes(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"))


def min_group_size(df: DataFrame, groups: list[str], ratio: float = 0.2) -> DataFrame:
    """Smallest group and the validation size derived from it."""
    sizes = group_sizes(df, groups)
    return sizes.agg(F.min("rows").alias("min_rows")).withColumn("val_size", F.floor(F.col("min_rows") * ratio).cast("long"))


def split_summary(split: DataFrame, group: str, time: str) -> DataFrame:
    """Rows, groups and date range of every split."""
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(group).alias("groups"),
        F.min(time).alias("first"),
        F.max(time).alias("last"),
    )
