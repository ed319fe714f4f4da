"""Rolling statistics and technical indicators along a group.

Every function returns a ``Feature``; pass several to ``over_blocks`` and they share one
shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.arithmetic import divide, intraday_momentum
from panelwright.plans.blocks import BlockFrame, Feature, over_blocks
from panelwright.spec import OHLCV, PanelSpec, require_columns


def _full(w: BlockFrame, column: str, n: int, value: Column) -> Column:
    """Null until ``n`` non-null values are in the frame."""
    return F.when(F.count(column).over(w.trailing(n)) == n, value)


def rolling_features(column: str, windows: list[int]) -> Feature:
    """Mean, sample standard deviation, min and max of the last n rows, null until full."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        new = {}
        for n in windows:
            frame = w.trailing(n)
            new[f"{column}_rolling_mean_{n}"] = _full(w, column, n, F.avg(column).over(frame))
            new[f"{column}_rolling_std_{n}"] = _full(w, column, n, F.stddev_samp(column).over(frame))
            new[f"{column}_rolling_min_{n}"] = _full(w, column, n, F.min(column).over(frame))
            new[f"{column}_rolling_max_{n}"] = _full(w, column, n, F.max(column).over(frame))
        return d.withColumns(new)

    return Feature(build, before=max(windows) - 1)


def _ewm_stretch(alpha: float) -> int:
    """Rows after which an old value weighs less than e^-40."""
    return max(2, math.ceil(40.0 / -math.log1p(-alpha))) if alpha < 1 else 2


def _ewm(d: DataFrame, w: BlockFrame, source: Column, name: str, alpha: float, min_periods: int) -> DataFrame:
    """Adds the recursive mean y1 = x1, yt = (1 - alpha) yt-1 + alpha xt.

    Rows are cut into stretches long enough that anything before the previous stretch has no
    weight left in double precision. Inside a stretch the recursion is a running weighted
    sum; the last value of the previous stretch enters with the weight of its distance.
    """
    if alpha >= 1:
        return d.withColumn(name, F.when(w.pos >= min_periods, source))
    m, keep = _ewm_stretch(alpha), 1.0 - alpha
    x = F.when(source.isNull(), F.raise_error(F.lit(f"{name}: the recursive mean needs non-null input")).cast("double"))
    x = x.otherwise(source.cast("double"))
    part, inside = "_ewm_part", (w.pos - 1) % m
    d = d.withColumn(part, F.floor((w.pos - 1) / m))
    order = w.spec.order
    in_stretch = Window.partitionBy(*w.partition, F.col(part)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*w.partition).orderBy(F.col(part), *order).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(w.pos == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    scaled = x * weight * F.pow(F.lit(keep), -inside)
    local, carry = f"_{name}_local", f"_{name}_carry"
    d = d.withColumn(local, F.sum(scaled).over(in_stretch) * F.pow(F.lit(keep), inside))
    d = d.withColumn(carry, F.last(F.when(inside == m - 1, F.col(local)), ignorenulls=True).over(along))
    y = F.col(local) + F.coalesce(F.col(carry), F.lit(0.0)) * F.pow(F.lit(keep), inside + 1)
    return d.withColumn(name, F.when(w.pos >= min_periods, y)).drop(local, carry, part)


def ewm_mean(column: str, span: int, min_periods: int = 0, name: str | None = None) -> Feature:
    """Recursive exponential mean with alpha = 2 / (span + 1); input must not be null."""
    alpha = 2.0 / (span + 1)

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        return _ewm(d, w, F.col(column), name or f"{column}_ewm_{span}", alpha, min_periods)

    return Feature(build, before=2 * _ewm_stretch(alpha))


def rsi(column: str = "close", period: int = 14, name: str | None = None, fill_warmup: bool = True) -> Feature:
    """Relative strength index over recursive means of gains and losses. No loss at all and
    the warm-up give 100 (``fill_warmup=False`` keeps the warm-up null)."""
    alpha = 2.0 / (period + 1)
    out = name or f"rsi_{period}"

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        step = F.col(column) - F.lag(column).over(w.ordered)
        d = d.withColumn("_step", step)
        gain = F.coalesce(F.when(F.col("_step") > 0, F.col("_step")), F.lit(0.0))
        loss = F.coalesce(F.when(F.col("_step") < 0, -F.col("_step")), F.lit(0.0))
        d = _ewm(d, w, gain, "_gain", alpha, period)
        d = _ewm(d, w, loss, "_loss", alpha, period)
        value = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(
            100.0 - F.lit(100.0) / (1.0 + F.try_divide(F.col("_gain"), F.col("_loss")))
        )
        if fill_warmup:
            value = F.coalesce(value, F.lit(100.0))
        return d.withColumn(out, value).drop("_step", "_gain", "_loss")

    return Feature(build, before=2 * _ewm_stretch(alpha) + 1)


def _bands(w: BlockFrame, column: str, period: int, num_std: float) -> tuple[Column, Column, Column]:
    frame = w.trailing(period)
    mid = _full(w, column, period, F.avg(column).over(frame))
    spread = _full(w, column, period, F.stddev_samp(column).over(frame)) * num_std
    return mid + spread, mid, mid - spread


def bollinger_bands(column: str = "close", period: int = 20, num_std: float = 2.0) -> Feature:
    """Moving average and the bands ``num_std`` sample standard deviations around it."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        upper, mid, lower = _bands(w, column, period, num_std)
        return d.withColumns({"bb_upper": upper, "bb_middle": mid, "bb_lower": lower})

    return Feature(build, before=period - 1)


def bb_position(column: str = "close", period: int = 20, num_std: float = 2.0, fill_warmup: bool = True) -> Feature:
    """Place of the value between the lower (0) and upper (1) band."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        upper, _, lower = _bands(w, column, period, num_std)
        d = d.withColumns({"_upper": upper, "_lower": lower})
        value = divide(F.col(column) - F.col("_lower"), F.col("_upper") - F.col("_lower"))
        value = F.coalesce(value, F.lit(0.5)) if fill_warmup else value
        return d.withColumn("bb_position", value).drop("_upper", "_lower")

    return Feature(build, before=period - 1)


def relative_volume(column: str = "volume", period: int = 20, fill_warmup: bool = True) -> Feature:
    """Volume over its own moving average."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        d = d.withColumn("_mean", _full(w, column, period, F.avg(column).over(w.trailing(period))))
        value = divide(column, "_mean")
        value = F.coalesce(value, F.lit(1.0)) if fill_warmup else value
        return d.withColumn("relative_volume", value).drop("_mean")

    return Feature(build, before=period - 1)


def momentum() -> Feature:
    return Feature(lambda d, w: d.withColumn("intraday_momentum", intraday_momentum("open", "close")))


def technical_features(
    rsi_period: int = 14, bb_period: int = 20, bb_std: float = 2.0, vol_period: int = 20, fill_warmup: bool = True
) -> list[Feature]:
    return [
        relative_volume(period=vol_period, fill_warmup=fill_warmup),
        momentum(),
        rsi(period=rsi_period, name="rsi_14", fill_warmup=fill_warmup),
        bb_position(period=bb_period, num_std=bb_std, fill_warmup=fill_warmup),
    ]


def technical_indicators(df: DataFrame, spec: PanelSpec, **periods) -> DataFrame:
    """Relative volume, momentum, RSI and band position in one pass over the panel."""
    require_columns(df, *OHLCV)
    return over_blocks(df, spec, *technical_features(**periods))
