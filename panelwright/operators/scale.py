"""Fitting and applying scalers, globally or per group.

A fitted scaler is a table with one row per group and two columns per scaled column:
``{column}__center`` and ``{column}__scale``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.plans.lookup import key_lookup, measured
from panelwright.plans.quantiles import exact_quantiles
from panelwright.spec import require_columns

# kind -> (center aggregate, scale aggregate) of a column
_AGGREGATES: dict[str, Callable[[str], tuple[Column, Column]]] = {}


def register_scaler(name: str, aggregates: Callable[[str], tuple[Column, Column]]) -> None:
    """Adds a scaler made of two aggregates of a column: its center and its scale."""
    _AGGREGATES[name.lower()] = aggregates


def available_scalers() -> list[str]:
    return [*_AGGREGATES, "robust"]


register_scaler("standard", lambda c: (F.avg(c), F.stddev_pop(c)))
register_scaler("minmax", lambda c: (F.min(c), F.max(c) - F.min(c)))
register_scaler("maxabs", lambda c: (F.lit(0.0), F.max(F.abs(c))))
register_scaler("onlymax", lambda c: (F.lit(0.0), F.max(c)))


def center(column: str) -> str:
    return f"{column}__center"


def scale_of(column: str) -> str:
    return f"{column}__scale"


def _nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


@dataclass(frozen=True)
class ScalerModel:
    kind: str
    columns: tuple[str, ...]
    groups: tuple[str, ...]
    params: DataFrame
    size: int | None = None  # bytes of ``params``, once measured

    def materialize(self) -> "ScalerModel":
        """Write the parameters once to the shared folder and measure them."""
        params, size = measured(self.params)
        return replace(self, params=params, size=size)

    def long(self) -> DataFrame:
        """Parameter table ``(groups..., column, center, scale)``."""
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(center(c)).alias("center"), F.col(scale_of(c)).alias("scale"))
            for c in self.columns
        ]
        return self.params.select(*self.groups, F.inline(F.array(*cells)))

    def attach(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """Rows with the parameter columns of their group. With ``strict`` a group that was
        not seen when fitting raises."""
        if not self.groups:
            one = self.params.limit(1)
            names = [n for c in self.columns for n in (center(c), scale_of(c))]
            packed = one.select(F.struct(*names)).scalar()
            out = df.withColumn("_params", packed)
            return out.select(*df.columns, *[F.col(f"_params.{n}").alias(n) for n in names])
        known = self.params.withColumn("_known", F.lit(True))
        out = key_lookup(df, known, list(self.groups), size=self.size)
        if strict:
            shown = F.concat_ws(", ", *[F.col(g).cast("string") for g in self.groups])
            complain = F.raise_error(F.concat(F.lit("group without fitted scaler: "), shown)).cast("boolean")
            out = out.filter(F.coalesce(F.col("_known"), complain))
        return out.drop("_known")

    def transform(self, df: DataFrame, columns: list[str] | None = None, suffix: str = "", strict=True):
        """(x - center) / scale, in place or under ``{column}{suffix}``."""
        names = list(columns or self.columns)
        require_columns(df, *names, *self.groups)
        out = self.attach(df, strict)
        new = {
            f"{c}{suffix}": (F.col(c).cast("double") - F.col(center(c))) / F.col(scale_of(c)) for c in names
        }
        return out.withColumns(new).drop(*[n for c in self.columns for n in (center(c), scale_of(c))])

    def inverse(self, df: DataFrame, columns: dict[str, str], strict=True) -> DataFrame:
        """``columns`` maps a scaled column of ``df`` to the fitted column whose parameters
        undo the scaling: p * scale + center."""
        out = self.attach(df, strict)
        new = {p: F.col(p) * F.col(scale_of(c)) + F.col(center(c)) for p, c in columns.items()}
        return out.withColumns(new).drop(*[n for c in self.columns for n in (center(c), scale_of(c))])


def fit_scaler(
    df: DataFrame,
    kind: str,
    columns: list[str],
    groups: list[str] | None = None,
    *,
    quantile_range: tuple[float, float] = (25.0, 75.0),
    approximate: bool = False,
) -> ScalerModel:
    """Parameters of ``kind`` for every column, per group or over all rows, lazily.

    A scale of 0 becomes 1. ``robust`` uses exact quantiles with linear interpolation;
    ``approximate=True`` takes sketch quantiles in a single aggregate instead.
    """
    kind = kind.lower()
    groups = list(groups or [])
    require_columns(df, *columns, *groups)
    if kind == "robust":
        params = _robust(df, columns, groups, quantile_range, approximate)
    elif kind in _AGGREGATES:
        typed = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
        aggs = []
        for c in columns:
            mid, width = _AGGREGATES[kind](c)
            aggs += [mid.alias(center(c)), _nonzero(width).alias(scale_of(c))]
        params = typed.groupBy(*groups).agg(*aggs)
    else:
        raise ValueError(f"unknown scaler {kind!r}; choose one of {sorted(available_scalers())}")
    return ScalerModel(kind, tuple(columns), tuple(groups), params)


def _robust(df, columns, groups, quantile_range, approximate) -> DataFrame:
    low, high = (q / 100.0 for q in quantile_range)
    wanted = [low, 0.5, high]
    if approximate:
        typed = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
        sketch = typed.groupBy(*groups).agg(*[F.percentile_approx(c, wanted, 10_000).alias(c) for c in columns])
        return sketch.select(
            *groups,
            *[F.col(c)[1].alias(center(c)) for c in columns],
            *[_nonzero(F.col(c)[2] - F.col(c)[0]).alias(scale_of(c)) for c in columns],
        )
    q = exact_quantiles(df, groups, columns, wanted)

    def pick(c: str, p: float) -> Column:
        return F.max(F.when((F.col("column") == c) & (F.col("probability") == p), F.col("value")))

    aggs = []
    for c in columns:
        aggs += [pick(c, 0.5).alias(center(c)), _nonzero(pick(c, high) - pick(c, low)).alias(scale_of(c))]
    return q.groupBy(*groups).agg(*aggs)
