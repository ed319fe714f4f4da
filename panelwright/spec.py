"""What a panel is (keys, time, order) and the fixed market / timeframe settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that mark a time column, first hit wins.
TIME_COLUMN_NAMES = ("timestamp", "date", "datetime", "time", "Date", "Timestamp", "DateTime")

# Timeframe -> bar length in seconds and recommended lookback length.
TIMEFRAMES = {
    "1min": {"seconds": 60, "sequence_length": 240, "description": "1-minute bars"},
    "5min": {"seconds": 300, "sequence_length": 96, "description": "5-minute bars"},
    "15min": {"seconds": 900, "sequence_length": 32, "description": "15-minute bars"},
    "1h": {"seconds": 3600, "sequence_length": 12, "description": "1-hour bars"},
}

# Market sessions, seconds since midnight, half open [open, close).
MARKETS = {
    "US": {"open": 34200, "close": 57600, "timezone": "America/New_York", "filter_hours": True},
    "INDIA": {"open": 33300, "close": 55800, "timezone": "Asia/Kolkata", "filter_hours": True},
    "CRYPTO": {"open": 0, "close": 86340, "timezone": "UTC", "filter_hours": False},
}

OHLC = ("open", "high", "low", "close")
OHLCV = OHLC + ("volume",)


def timeframe(name: str) -> dict:
    if name not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name!r}; choose one of {sorted(TIMEFRAMES)}")
    return dict(TIMEFRAMES[name])


def market(name: str) -> dict:
    if name not in MARKETS:
        raise ValueError(f"unknown market {name!r}; choose one of {sorted(MARKETS)}")
    return dict(MARKETS[name])


def detect_time_column(columns, names=TIME_COLUMN_NAMES) -> str | None:
    """First well-known time column name present; looks at names only, runs no job."""
    present = set(columns)
    return next((n for n in names if n in present), None)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Plan-time check that every named column exists (no job)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


@dataclass(frozen=True)
class PanelSpec:
    """Keys and order of a panel, and how its order is cut into bounded blocks.

    Counting cells are stretches of the order column; consecutive cells are merged until a block
    holds about ``block_rows`` rows. Their width is ``cell_steps * step``, ``step`` being the usual
    spacing of rows (seconds for timestamps and dates, plain units for integers); without a
    ``step`` it follows from the smallest and largest time and the number of rows. With
    ``count_first`` the cells are counted by a small job of their own (two columns of the panel
    are read) before the ordered pass: cells that hold more than a block are narrowed, down to a
    microsecond and then by the first tiebreak if that is an integer; the cell table has a known
    size and is broadcast if small, and the panel is shuffled once instead of twice. Without it
    everything stays lazy, cells keep the width of the spec, and a wide cell is one task's work.
    None of this changes what is computed.
    """

    time: str
    groups: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()
    step: int | None = None
    cell_steps: int = 4096
    block_rows: int = 500_000
    count_first: bool = True

    def __post_init__(self):
        for field in ("groups", "tiebreak"):
            value = getattr(self, field)
            if isinstance(value, str):
                object.__setattr__(self, field, (value,))
            elif not isinstance(value, tuple):
                object.__setattr__(self, field, tuple(value))

    def with_groups(self, *groups: str) -> "PanelSpec":
        return replace(self, groups=tuple(groups))

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    @property
    def keys(self) -> list[str]:
        return [*self.groups, self.time]

    def width(self, df: DataFrame) -> int | None:
        """Width of a cell in units of ``order_value``; None if the data must tell."""
        return None if self.step is None else self.step * self.cell_steps * unit_of(df, self.time)

    def tie(self, df: DataFrame) -> str | None:
        """The tiebreak by which cells of one moment can be divided."""
        first = self.tiebreak[0] if self.tiebreak else None
        return first if first and isinstance(df.schema[first].dataType, T.IntegralType) else None

    def cell_of(self, df: DataFrame, width: int, tie_width: int | None = None) -> Column:
        """Cell of a row: never decreasing along the panel order, null times first."""
        cell = F.floor(order_value(df, self.time) / F.lit(width)).cast("long")
        if tie_width is None:
            return cell
        return F.struct(cell.alias("time"), F.floor(F.col(self.tie(df)) / F.lit(tie_width)).cast("long").alias("tie"))


MICROS = 1_000_000


def unit_of(df: DataFrame, name: str) -> int:
    """What one second (or one unit of an integer) is in ``order_value``."""
    return 1 if isinstance(df.schema[name].dataType, T.IntegralType) else MICROS


def order_value(df: DataFrame, name: str) -> Column:
    """Order column as a whole number (microseconds of times and dates), independent of the
    session time zone for zone-less types."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86400 * MICROS)
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(c.cast("date")).cast("long") * F.lit(1440) + F.hour(c) * F.lit(60) + F.minute(c)
        return minutes * F.lit(60 * MICROS) + (F.date_part(F.lit("SECOND"), c) * F.lit(MICROS)).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"order column {name!r} must be a date, a timestamp or an integer, not {kind}")
