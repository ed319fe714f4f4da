"""Cardinalities, feature kinds, ranges, order and quality reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.plans.blocks import BlockFrame, Feature, over_blocks
from panelwright.spec import PanelSpec, require_columns

HELD = 10_000  # distinct values that are held in a set
SEASONAL_NAME = re.compile(r"(.+)_(sin|cos)$")  # fixed value: names of seasonal columns


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, as ``(column, categories)``."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in require_columns(df, *columns).select(*columns).columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("categories")) for c in columns]
    return wide.select(F.inline(F.array(*cells)))


def is_seasonal(name: str) -> bool:
    return SEASONAL_NAME.match(name) is not None


def seasonal_pairs(columns: list[str]) -> dict[str, tuple[str, str]]:
    """Base name -> (sine column, cosine column) where both exist."""
    bases = [m.group(1) for m in map(SEASONAL_NAME.match, columns) if m and m.group(2) == "sin"]
    return {b: (f"{b}_sin", f"{b}_cos") for b in bases if f"{b}_cos" in columns}


def profile_features(df: DataFrame, exclude: list[str] = (), threshold: int = 20) -> DataFrame:
    """``(column, kind, categories)`` with kind seasonal, categorical or numeric.

    Seasonal by name; texts and booleans are categorical; numbers with at most ``threshold``
    distinct values too, unless they are integers spread over more than ten times as many
    values. Numeric columns show no category count.

    A first job sketches the distinct counts of all columns in one aggregate. Numbers far above
    the threshold are numeric and are not counted exactly. The others come from one more
    aggregate, lazily: as sets, which merge and are small by the sketch (at most ``HELD``
    values), and as plain distinct counts where a text column has more. No row is copied."""
    fields = [f for f in df.schema.fields if f.name not in exclude]

    def discrete(f: T.StructField) -> bool:
        return is_seasonal(f.name) or isinstance(f.dataType, (T.StringType, T.BooleanType))

    def value(f: T.StructField):
        c = F.round(F.col(f.name), 4) if is_seasonal(f.name) else F.col(f.name)
        # minus zero is zero
        return c + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    rough = df.agg(*[F.approx_count_distinct(value(f)).alias(f.name) for f in fields]).first().asDict() if fields else {}
    many = {f.name for f in fields if not discrete(f) and rough[f.name] > 3 * threshold}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    large = []
    for f in fields:
        if f.name in many:
            continue
        if rough[f.name] > HELD and is_seasonal(f.name):
            aggs.append(F.lit(HELD).cast("long").alias(f"{f.name}__n"))  # more than the 100 that are shown
        elif rough[f.name] > HELD:
            large.append(f)
        else:
            aggs.append(F.size(F.collect_set(value(f))).cast("long").alias(f"{f.name}__n"))
        if isinstance(f.dataType, T.IntegralType):
            aggs += [F.max(f.name).cast("long").alias(f"{f.name}__hi"), F.min(f.name).cast("long").alias(f"{f.name}__lo")]
    wide = df.agg(*aggs)
    for f in large:
        wide = wide.withColumn(f"{f.name}__n", df.agg(F.count_distinct(value(f))).scalar())
    numeric, categorical = F.lit("numeric"), F.lit("categorical")
    cells = []
    for f in fields:
        n = F.col(f"{f.name}__n")
        if f.name in many:
            kind, size = numeric, F.lit(None)
        elif is_seasonal(f.name):
            kind, size = F.lit("seasonal"), F.when(n == 0, F.lit(24)).otherwise(F.least(n, F.lit(100)))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            kind, size = F.when(n > 0, categorical).otherwise(numeric), F.when(n > 0, n)
        else:
            few = (n > 0) & (n <= threshold)
            if isinstance(f.dataType, T.IntegralType):
                few = few & ~((F.col(f"{f.name}__hi") - F.col(f"{f.name}__lo")) > n * 10)
            kind, size = F.when(few, categorical).otherwise(numeric), F.when(few, n)
        cells.append(F.struct(F.lit(f.name).alias("column"), kind.alias("kind"), size.cast("long").alias("categories")))
    return wide.select(F.inline(F.array(*cells)))


def seasonal_resolution(df: DataFrame, sin: str, cos: str, decimals: int = 4) -> DataFrame:
    """Distinct positions on the circle, 24 if there is no complete pair."""
    pair = F.when(F.col(sin).isNotNull() & F.col(cos).isNotNull(), F.struct(F.round(sin, decimals), F.round(cos, decimals)))
    n = F.count_distinct(pair)
    return df.agg(F.when(n == 0, F.lit(24)).otherwise(n).cast("long").alias("resolution"))


def date_range(df: DataFrame, time: str, group: str | None = None) -> DataFrame:
    aggs = [F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("rows")]
    if group:
        aggs.append(F.count_distinct(group).alias("groups"))
    return df.agg(*aggs)


def order_violations(df: DataFrame, time: str, offset: PanelSpec) -> DataFrame:
    """Rows whose time is earlier than that of the row before them in ingest order, per group.
    ``offset`` is a spec whose order column is the ingest position."""

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        return d.withColumn("_back", F.col(time) < F.lag(time).over(w.ordered))

    marked = over_blocks(df.select(*{*offset.groups, *offset.order, time}), offset, Feature(build, before=1))
    return marked.groupBy(*offset.groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_back")).alias("violations")
    )


def weekend_count(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.count_if(F.weekday(time) >= 5).alias("weekend_rows"), F.count(F.lit(1)).alias("rows"))


def quality_report(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Nulls over all columns and repeated (group, time) keys."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    per_key = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(nulls).alias("_nulls"))
    return per_key.agg(
        F.sum("_n").alias("rows"),
        F.sum("_nulls").alias("null_values"),
        F.sum(F.col("_n") - 1).alias("duplicate_keys"),
    )
