"""Date parts, their cyclical encoding and future timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.spec import require_columns

# Full cycle of each date part.
PERIODS = {"month": 12, "dayofweek": 7, "hour": 24, "minute": 60, "day": 31, "quarter": 4}
PARTS = ("year", "month", "day", "hour", "minute", "dayofweek", "quarter")


def date_part(name: str, time: str) -> Column:
    c = F.col(time)
    return {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "hour": F.hour,
        "minute": F.minute,
        "dayofweek": F.weekday,
        "quarter": F.quarter,
    }[name](c)


def date_parts(df: DataFrame, time: str, parts=PARTS) -> DataFrame:
    """Plain calendar columns; ``dayofweek`` counts from Monday = 0."""
    require_columns(df, time)
    return df.withColumns({p: date_part(p, time) for p in parts})


def cyclical_features(df: DataFrame, time: str, parts=("month", "dayofweek"), keep_parts: bool = True) -> DataFrame:
    """Sine and cosine of each part over its full cycle; ``is_weekend`` with dayofweek."""
    require_columns(df, time)
    new: dict[str, Column] = {}
    for p in parts:
        value = date_part(p, time)
        if keep_parts:
            new[p] = value
        if p in PERIODS:
            angle = value * F.lit(2 * math.pi) / F.lit(PERIODS[p])
            new[f"{p}_sin"], new[f"{p}_cos"] = F.sin(angle), F.cos(angle)
        if p == "dayofweek":
            new["is_weekend"] = (value >= 5).cast("int")
    return df.withColumns(new)


def has_time_of_day(df: DataFrame, time: str) -> bool:
    """Whether any row has an hour or minute (one aggregate job)."""
    any_time = F.max(((F.hour(time) != 0) | (F.minute(time) != 0)).cast("int"))
    return bool(df.agg(any_time).first()[0])


def date_features(df: DataFrame, time: str, has_time: bool | None = None) -> DataFrame:
    """Month, day and weekday cycles, plus hour and minute if the data has a time of day.
    Columns named like a plain date part are dropped. ``has_time=None`` looks at the data."""
    if has_time is None:
        has_time = has_time_of_day(df, time)
    parts = ["month", "day", "dayofweek"] + (["hour", "minute"] if has_time else [])
    out = cyclical_features(df, time, parts, keep_parts=False)
    return out.drop(*[p for p in PARTS if p in out.columns])


def future_timestamps(
    df: DataFrame, last: str, n: int, kind: str = "calendar_day", seconds: int | None = None, name: str = "future_ts"
) -> DataFrame:
    """``n`` rows per input row: the next calendar days, business days or bars after
    ``last``, numbered by ``step``."""
    start = F.col(last).cast("timestamp_ntz")
    if kind == "bar":
        if not seconds:
            raise ValueError("bars need their length in seconds")
        step = F.expr(f"INTERVAL '{int(seconds)}' SECOND")
        times = F.sequence(start + step, start + F.expr(f"INTERVAL '{int(seconds) * n}' SECOND"), step)
    elif kind in ("calendar_day", "business_day"):
        day = F.expr("INTERVAL '1' DAY")
        span = n if kind == "calendar_day" else n + 2 * (n // 5 + 1)
        times = F.sequence(start + day, start + F.expr(f"INTERVAL '{span}' DAY"), day)
        if kind == "business_day":
            times = F.slice(F.filter(times, lambda t: F.weekday(t) < 5), 1, n)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    out = df.select("*", F.posexplode(times).alias("_i", name))
    return out.withColumn("step", F.col("_i") + 1).drop("_i")
