"""Row filters, cleaning and filling."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.plans.blocks import CellTable, Feature, over_blocks
from panelwright.spec import OHLC, PanelSpec, market, require_columns


def clean_ohlc_daily(df: DataFrame, spec: PanelSpec, cells: CellTable | None = None) -> DataFrame:
    """Missing and non-positive prices take the last positive price of their group (null if
    there is none), high and low are swapped where crossed, negative volume becomes 0. Only
    columns that are present are touched."""
    prices = [c for c in OHLC if c in df.columns]
    df = df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in prices})

    def fill(d: DataFrame, w) -> DataFrame:
        return d.withColumns({c: w.last_value(c) for c in prices})

    out = over_blocks(df, spec, Feature(fill, carry_last=prices), cells=cells) if prices else df
    if {"high", "low"} <= set(out.columns):
        crossed = F.col("high") < F.col("low")
        out = out.withColumns(
            {
                "high": F.when(crossed, F.col("low")).otherwise(F.col("high")),
                "low": F.when(crossed, F.col("high")).otherwise(F.col("low")),
            }
        )
    if "volume" in out.columns:
        zero = F.lit(0).cast(out.schema["volume"].dataType)
        out = out.withColumn("volume", F.when(F.col("volume") < 0, zero).otherwise(F.col("volume")))
    return out


def bar_faults(columns) -> dict[str, Column]:
    """Named faults of a minute bar, only for the columns that are present."""
    present = set(columns)
    faults: dict[str, Column] = {}
    for c in OHLC:
        if c in present:
            faults[f"bad_{c}"] = F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0)
    if "volume" in present:
        faults["bad_volume"] = F.col("volume").isNull() | (F.col("volume") < 0)
    if set(OHLC) <= present:
        high, low, open_, close = (F.col(c) for c in ("high", "low", "open", "close"))
        crossed = [high < low, high < open_, high < close, low > open_, low > close]
        faults["bad_range"] = F.coalesce(reduce(or_, crossed), F.lit(False))
    return faults


def clean_ohlc_intraday(df: DataFrame, spec: PanelSpec, dedup: bool = True) -> DataFrame:
    """Drops faulty bars, then repeated bars of one (group, time)."""
    faults = list(bar_faults(df.columns).values())
    good = df.filter(~reduce(or_, faults)) if faults else df
    return dedup_bars(good, spec) if dedup else good


def fault_report(df: DataFrame) -> DataFrame:
    """Rows per fault and rows kept, in one aggregate."""
    faults = bar_faults(df.columns)
    any_fault = reduce(or_, faults.values())
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        *[F.count_if(f).alias(name) for name, f in faults.items()],
        F.count_if(~any_fault).alias("rows_kept"),
    )


def filter_market_hours(df: DataFrame, time: str, country: str = "US", convert_from: str | None = None) -> DataFrame:
    """Rows inside the session [open, close) of a market. Times are taken as written;
    ``convert_from`` names their zone if they must first be moved to the market's zone."""
    m = market(country)
    if not m["filter_hours"]:
        return df
    c = F.col(time)
    if convert_from:
        c = F.convert_timezone(F.lit(convert_from), F.lit(m["timezone"]), c.cast("timestamp_ntz"))
    second = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return df.filter((second >= m["open"]) & (second < m["close"]))


def filter_rows(df: DataFrame, remove_closed: bool = True, remove_zero_sales: bool = False) -> DataFrame:
    if remove_closed and "Open" in df.columns:
        df = df.filter(F.col("Open") == 1)
    if remove_zero_sales and "Sales" in df.columns:
        df = df.filter(F.col("Sales") > 0)
    return df


def filter_group(df: DataFrame, **key) -> DataFrame:
    """Rows of one (composite) group, e.g. ``filter_group(df, symbol="A", sector="T")``."""
    require_columns(df, *key)
    return df.filter(reduce(and_, [F.col(k) == F.lit(v) for k, v in key.items()]))


def drop_null_targets(df: DataFrame, columns: list[str]) -> DataFrame:
    return require_columns(df, *columns).na.drop(subset=columns)


def drop_warmup(df: DataFrame, keep: list[str], needed: list[str]) -> DataFrame:
    """Projection to ``keep`` + ``needed`` without rows that miss any needed value."""
    return require_columns(df, *keep, *needed).select(*keep, *needed).na.drop(subset=needed)


def fill_backward_zero(df: DataFrame, spec: PanelSpec, columns: list[str] | None = None) -> DataFrame:
    """Nulls take the next value of their group, else 0. Note that this looks ahead."""
    columns = columns or [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in (*spec.groups, *spec.order)
    ]

    def fill(d: DataFrame, w) -> DataFrame:
        zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in columns}
        return d.withColumns({c: F.coalesce(w.next_value(c), zero[c]) for c in columns})

    return over_blocks(df, spec, Feature(fill, carry_next=columns))


def dedup_bars(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """First row of every (group, time) by the tiebreak order; an aggregate with map-side
    combine, so any number of copies of one bar is harmless."""
    if not spec.tiebreak:
        return df.dropDuplicates(spec.keys)
    rest = [c for c in df.columns if c not in spec.keys]
    first = F.min_by(F.struct(*rest), F.struct(*spec.tiebreak)).alias("_first")
    return df.groupBy(*spec.keys).agg(first).select(*spec.keys, "_first.*").select(*df.columns)


def fill_zero(df: DataFrame) -> DataFrame:
    """Remaining nulls become 0, in text columns the text 0."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df.na.fill(0)
    return out.na.fill("0", subset=texts) if texts else out


def numeric_features(df: DataFrame, exclude: list[str]) -> list[str]:
    """Numeric columns that are not excluded, in schema order; looks at the schema only."""
    shifted = [c for c in df.columns if "_target_h" in c]
    drop = {*exclude, *shifted}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def missing_features(df: DataFrame, fitted: list[str]) -> list[str]:
    """Features known from fitting that the frame lacks (plan time)."""
    return [c for c in fitted if c not in df.columns]


def with_fitted_features(df: DataFrame, fitted: list[str]) -> DataFrame:
    """Adds 0.0 for features that were present when fitting and are missing now."""
    lack = missing_features(df, fitted)
    return df.withColumns({c: F.lit(0.0) for c in lack}) if lack else df


def limit_groups(df: DataFrame, group: str, n: int, *others: DataFrame):
    """Rows of the ``n`` smallest group values, here and in every other frame. The list of
    kept groups has at most ``n`` rows, which bounds the broadcast."""
    kept = df.select(group).distinct().orderBy(group).limit(n)
    small = F.broadcast(kept) if n <= 100_000 else kept
    result = [d.join(small, group, "left_semi") for d in (df, *others)]
    return result[0] if not others else tuple(result)
