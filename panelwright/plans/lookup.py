"""Bringing per-key parameters (scales, codes, dimensions) to the rows of a panel."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

# A table is broadcast only when it was measured and takes no more than this.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """Size of a row, measured on its text form."""
    return F.octet_length(F.to_json(F.struct("*"))).cast("long") if df.columns else F.lit(0).cast("long")


def bytes_of(df: DataFrame) -> int:
    """Size of a table, by a job that returns one row."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """The table written once to the shared folder, and its size."""
    table = cut_lineage(df)
    return table, bytes_of(table)


def key_lookup(df: DataFrame, table: DataFrame, keys: list[str], *, size: int | None = None, how: str = "left") -> DataFrame:
    """Join ``table`` (one row per key) to ``df``; null keys match null keys. ``size`` is the
    table's measured size in bytes: when small enough it is broadcast. Otherwise Spark joins by
    the sizes it sees at run time and splits the rows of a hot key over several tasks; the table
    is not repeated."""
    right = table
    for k in keys:
        right = right.withColumnRenamed(k, f"_on_{k}")
    if not keys:
        raise ValueError("key_lookup needs at least one key")
    if size is not None and size <= BROADCAST_BYTES:
        right = F.broadcast(right)
    match = reduce(and_, [df[k].eqNullSafe(right[f"_on_{k}"]) for k in keys])
    return df.join(right, match, how).drop(*[f"_on_{k}" for k in keys])
