"""Exact quantiles per group without holding a group's values in one place.

1. One aggregate keeps a small sketch per (group, column) and yields a bracket of values
   around every wanted rank.
2. A second aggregate counts what lies below each bracket and remembers the nearest values
   outside it. Both combine on the map side; no row is copied.
3. Only values inside a bracket, a tiny share of the rows, are counted and ranked; linear
   interpolation between the two neighbouring ranks gives the exact quantile.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.plans.lookup import key_lookup, measured


def _attach(df: DataFrame, table: DataFrame, groups: list[str]) -> DataFrame:
    if groups:
        table, size = measured(table)
        return key_lookup(df, table, groups, size=size, how="inner")
    names = table.columns
    packed = df.withColumn("_all", table.select(F.struct(*names)).scalar())
    return packed.select(*df.columns, *[F.col(f"_all.{n}").alias(n) for n in names])


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    columns: list[str],
    probabilities: list[float],
    *,
    accuracy: int = 100_000,
) -> DataFrame:
    """Rows ``(groups..., column, probability, value)``; nulls and NaN are left out."""
    n_probs = len(probabilities)
    v = [f"_v{i}" for i in range(len(columns))]
    numbers = [F.col(c).cast("double").alias(n) for c, n in zip(columns, v)]
    values = df.select(*groups, *numbers)
    values = values.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in v})

    margin = 3.0 / accuracy
    low = [max(p - margin, 0.0) for p in probabilities]
    high = [min(p + margin, 1.0) for p in probabilities]
    sketch = values.groupBy(*groups).agg(*[F.percentile_approx(n, low + high, accuracy).alias(f"_edges{n}") for n in v])
    placed = _attach(values, sketch, groups)

    def edges(n: str, i: int) -> tuple[Column, Column]:
        return F.col(f"_edges{n}")[i], F.col(f"_edges{n}")[n_probs + i]

    # below, and the nearest values on either side, of every bracket
    outside = []
    for n in v:
        x = F.col(n)
        outside.append(F.count(x).alias(f"_n{n}"))
        for i in range(n_probs):
            lo, hi = edges(n, i)
            outside += [
                F.count_if(x < lo).alias(f"_below{n}_{i}"),
                F.max(F.when(x < lo, x)).alias(f"_under{n}_{i}"),
                F.min(F.when(x > hi, x)).alias(f"_over{n}_{i}"),
            ]
    around = placed.groupBy(*groups).agg(*outside)
    wanted = around.select(
        *groups,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(float(p)).alias("probability"),
                        (F.lit(float(p)) * (F.col(f"_n{n}") - 1)).alias("rank"),
                        F.col(f"_below{n}_{i}").alias("below"),
                        F.col(f"_under{n}_{i}").alias("under"),
                        F.col(f"_over{n}_{i}").alias("over"),
                    )
                    for c, n in zip(columns, v)
                    for i, p in enumerate(probabilities)
                ]
            )
        ),
    ).filter(F.col("rank") >= 0)

    # distinct values inside the brackets with their counts
    hits = {(c, p): F.col(n).between(*edges(n, i)) for c, n in zip(columns, v) for i, p in enumerate(probabilities)}
    number = dict(zip(columns, v))
    inside = (
        placed.filter(reduce(or_, hits.values()))
        .select(
            *groups,
            F.inline(
                F.array_compact(
                    F.array(
                        *[
                            F.when(
                                hit,
                                F.struct(
                                    F.lit(c).alias("column"),
                                    F.lit(float(p)).alias("probability"),
                                    F.col(number[c]).alias("x"),
                                ),
                            )
                            for (c, p), hit in hits.items()
                        ]
                    )
                )
            ),
        )
        .groupBy(*groups, "column", "probability", "x")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    keys = [*groups, "column", "probability"]
    running = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("end", F.sum("rows").over(running)).withColumn("start", F.col("end") - F.col("rows"))
    ranked = key_lookup(ranked, wanted, keys, how="inner")
    asked = {"floor": F.floor("rank") - F.col("below"), "ceil": F.ceil("rank") - F.col("below")}
    found = ranked.groupBy(*keys, "rank", "below", "under", "over").agg(
        F.max("end").alias("size"),
        *[F.max(F.when((F.col("start") <= k) & (k < F.col("end")), F.col("x"))).alias(f"_{name}") for name, k in asked.items()],
    )

    def at(name: str) -> Column:
        # one rank beside the bracket is known too
        k = asked[name]
        return F.when(k == -1, F.col("under")).when(k == F.col("size"), F.col("over")).otherwise(F.col(f"_{name}"))

    lower, upper, share = at("floor"), at("ceil"), F.col("rank") - F.floor("rank")
    missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
    return found.select(
        *keys, F.when(lower.isNull() | upper.isNull(), missed).otherwise(lower + (upper - lower) * share).alias("value")
    )
