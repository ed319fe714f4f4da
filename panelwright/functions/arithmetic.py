"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divide(a: Column | str, b: Column | str) -> Column:
    """IEEE style division: 0/0 is null, x/0 is signed infinity."""
    a, b = col(a).cast("double"), col(b).cast("double")
    inf = F.lit(float("inf"))
    by_zero = F.when(a > 0, inf).when(a < 0, -inf)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def clip_lower(c: Column | str, bound: float = 0.0) -> Column:
    """Values below the bound become the bound; null stays null."""
    c = col(c)
    return F.when(c < bound, F.lit(bound)).otherwise(c)


def intraday_momentum(open_: Column | str, close: Column | str) -> Column:
    return F.coalesce(divide(col(close) - col(open_), open_), F.lit(0.0))


def error_columns(
    actual: Column | str, predicted: Column | str, zero_actual: float | None = 0.0, relative_to_size: bool = False
) -> dict[str, Column]:
    """Error, absolute error and error in percent of the actual value; ``zero_actual`` is
    the percentage where the actual value is 0."""
    a, p = col(actual), col(predicted)
    error = a - p
    pct = F.try_divide(F.abs(error), F.abs(a)) if relative_to_size else F.try_divide(error, a)
    return {
        "error": error,
        "abs_error": F.abs(error),
        "pct_error": F.when(a.isNull() | p.isNull(), F.lit(None).cast("double"))
        .when(a == 0, F.lit(zero_actual).cast("double"))
        .otherwise(pct * 100.0),
    }


def rmspe_contribution(actual: Column | str, predicted: Column | str) -> Column:
    a, p = col(actual), col(predicted)
    return F.when(a == 0, F.lit(0.0)).otherwise(F.pow(F.try_divide(a - p, a), F.lit(2.0)))


def months_since(year: Column | str, month: Column | str, date: Column | str, missing: int = 999) -> Column:
    """Whole months from (year, month) to the month of ``date``; future starts give 0 and
    missing or impossible ones ``missing``. A missing month counts as January."""
    y, d = col(year).cast("int"), col(date)
    m = F.coalesce(col(month).cast("int"), F.lit(1))
    gap = (F.year(d) - y) * 12 + (F.month(d) - m)
    usable = y.isNotNull() & m.between(1, 12) & d.isNotNull()
    return F.when(~usable, F.lit(missing)).when(gap < 0, F.lit(0)).otherwise(gap).cast("int")


def in_promo_month(interval: Column | str, date: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """1 if the month abbreviation of ``date`` is in the comma separated ``interval``.
    ``aliases`` maps other spellings in the list to the abbreviation, e.g. Sept -> Sep."""
    months = F.split(col(interval), ",")
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        months = F.transform(months, lambda x: F.coalesce(table[x], x))
    hit = F.array_contains(months, F.date_format(col(date), "MMM"))
    return F.coalesce(hit.cast("int"), F.lit(0))


def sales_per_customer(sales: Column | str, customers: Column | str) -> Column:
    c = col(customers)
    return F.try_divide(col(sales).cast("double"), F.when(c == 0, F.lit(1)).otherwise(c))


def distance_bin(distance: Column | str, edges=(0, 1000, 5000, 10000, 50000)) -> Column:
    """Index of the last edge not above the value; null below the first edge."""
    d = col(distance)
    out = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        out = F.when(d >= edge, F.lit(i)).otherwise(out)
    return out


def angle_bucket(sin: Column | str, cos: Column | str, buckets: Column | int) -> Column:
    """Bucket of the angle of a (sin, cos) pair on the full circle."""
    k = buckets if isinstance(buckets, Column) else F.lit(buckets)
    turn = F.lit(6.283185307179586)
    angle = F.pmod(F.atan2(col(sin), col(cos)) + turn, turn)
    return F.greatest(F.lit(0), F.least(F.floor(angle / turn * k).cast("int"), (k - 1).cast("int")))


def unit_bucket(value: Column | str, buckets: Column | int) -> Column:
    """Bucket of a single sine or cosine value, [-1, 1] cut into equal parts."""
    k = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.greatest(F.lit(0), F.least(F.floor((col(value) + 1) / 2 * k).cast("int"), (k - 1).cast("int")))
