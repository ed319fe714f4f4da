"""Label maps, one-hot columns and seasonal buckets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.arithmetic import unit_bucket
from panelwright.plans.lookup import key_lookup, row_bytes
from panelwright.session import cut_lineage
from panelwright.spec import require_columns

NULL_LABEL = "nan"  # fixed value: label of a missing category
ONE_HOT_LIMIT = 1000  # more categories than this are no one-hot columns


def _label(c: str, null_label: str | None) -> Column:
    text = F.col(c).cast("string")
    return text if null_label is None else F.coalesce(text, F.lit(null_label))


@dataclass(frozen=True)
class LabelMap:
    """Table ``(column, label, code)``: codes 0..k-1 in text order of the labels."""

    columns: tuple[str, ...]
    table: DataFrame
    null_label: str | None = NULL_LABEL
    sizes: dict | None = None  # bytes of each column's labels, once measured

    def materialize(self) -> "LabelMap":
        return replace(self, table=cut_lineage(self.table)).sized()

    def sized(self) -> "LabelMap":
        """Measures each column's labels by themselves (a job that returns a row per column)."""
        rows = self.table.groupBy("column").agg(F.sum(row_bytes(self.table)).alias("n")).collect()
        return replace(self, sizes=dict.fromkeys(self.columns, 0) | {r["column"]: r["n"] for r in rows})

    def _size(self, column: str) -> int | None:
        return None if self.sizes is None else self.sizes.get(column, 0)

    @staticmethod
    def _numbered(labels: DataFrame) -> DataFrame:
        """Codes for a dictionary of any size without gathering it: labels are range partitioned and
        sorted, and each partition starts where the ones before it end. The sorted table is
        checkpointed first, so that a repeated task cannot move a label."""
        ranged = labels.repartitionByRange("column", "label").sortWithinPartitions("column", "label")
        fixed = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
        sizes = fixed.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        # at most one row per partition and column
        placed = fixed.join(F.broadcast(starts), ["column", "_part"])
        return placed.select("column", "label", (F.col("_start") + F.col("_row") - F.col("_first")).cast("int").alias("code"))

    def cardinalities(self) -> DataFrame:
        return self.table.groupBy("column").agg(F.count(F.lit(1)).alias("categories"))

    def _codes_of(self, column: str) -> DataFrame:
        one = self.table.filter(F.col("column") == column)
        return one.select(F.col("label").alias("_label"), F.col("code").alias("_code"))

    def encode(self, df: DataFrame, suffix: str = "_code", unseen: str = "error") -> DataFrame:
        """Adds ``{column}{suffix}``. ``unseen``: raise (error), null (null) or the code after
        the last one (keep), which is also the code of null when nulls have no label."""
        require_columns(df, *self.columns)
        if unseen not in ("error", "null", "keep"):
            raise ValueError(f"unknown treatment of unseen labels: {unseen!r}")
        sizes = self.cardinalities() if unseen == "keep" else None
        for c in self.columns:
            codes = self._codes_of(c)
            df = df.withColumn("_label", _label(c, self.null_label))
            df = key_lookup(df, codes, ["_label"], size=self._size(c))
            code = F.col("_code")
            if unseen == "error":
                complain = F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.coalesce("_label", F.lit("null"))))
                code = F.coalesce(code, complain.cast("int"))
            elif unseen == "keep":
                after = sizes.filter(F.col("column") == c).select(F.col("categories").cast("int")).scalar()
                code = F.coalesce(code, after, F.lit(0))
            df = df.withColumn(f"{c}{suffix}", code).drop("_label", "_code")
        return df

    def decode(self, df: DataFrame, column: str, code_column: str, out: str) -> DataFrame:
        """Adds the label of a code; unknown codes give null."""
        labels = self._codes_of(column).select(F.col("_code").alias(code_column), F.col("_label").alias(out))
        return key_lookup(df, labels, [code_column], size=self._size(column))

    def unseen(self, df: DataFrame) -> DataFrame:
        """Labels of ``df`` without a code, as ``(column, label)``."""
        return distinct_labels(df, list(self.columns), self.null_label).join(
            self.table, ["column", "label"], "left_anti"
        )


def distinct_labels(df: DataFrame, columns: list[str], null_label: str | None = NULL_LABEL) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), _label(c, null_label).alias("label")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("label").isNotNull()).distinct()


def fit_labels(
    df: DataFrame, columns: list[str], null_label: str | None = NULL_LABEL, lazy: bool = False
) -> LabelMap:
    """Label map of the given columns, numbered in range partitions and counted (runs a job).
    ``lazy`` gives a map without any job for small dictionaries: the distinct labels of a
    column, never its rows, are then numbered by one task."""
    require_columns(df, *columns)
    labels = distinct_labels(df, columns, null_label)
    if not lazy:
        return LabelMap(tuple(columns), LabelMap._numbered(labels), null_label).materialize()
    order = Window.partitionBy("column").orderBy("label")
    return LabelMap(tuple(columns), labels.withColumn("code", F.row_number().over(order) - 1), null_label)


def group_code(groups: list[str]) -> Column:
    """Composite key of several columns as one value."""
    return F.struct(*groups)


def one_hot_vector(df: DataFrame, labels: LabelMap, column: str, out: str) -> DataFrame:
    """Adds a sparse 0/1 vector of any number of categories: position ``code`` of the label map is
    1, a label that was not fitted has one position more. Nothing but the number of categories
    comes to the driver."""
    coded = replace(labels, columns=(column,)).encode(df, suffix="_one_hot_code", unseen="keep")
    code = f"{column}_one_hot_code"
    n = labels.table.filter(F.col("column") == column).count()
    sizes = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias(code))
    encoder = OneHotEncoder(inputCols=[code], outputCols=[out], dropLast=False).fit(sizes)
    return encoder.transform(coded).drop(code)


def categories_of(df: DataFrame, column: str, limit: int = ONE_HOT_LIMIT) -> list[str]:
    """Sorted distinct texts of a column (one small job); refuses more than ``limit``, which are
    better kept in one sparse vector (``one_hot_vector``) than in as many columns."""
    rows = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories; use a label map")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, categories: dict[str, list[str]], drop: bool = True) -> DataFrame:
    """0/1 column ``{column}_{category}`` for every fitted category."""
    require_columns(df, *categories)
    new = {
        f"{c}_{v}": F.when(F.col(c).cast("string") == v, 1).otherwise(0) for c, values in categories.items() for v in values
    }
    out = df.withColumns(new)
    return out.drop(*categories) if drop else out


def categorical_inputs(df: DataFrame, categorical: dict[str, int], seasonal: list[str], labels: LabelMap) -> DataFrame:
    """Code column for every profiled categorical feature: buckets for sine / cosine
    columns, label codes (null last) for the others."""
    others = [c for c in categorical if c not in seasonal]
    if others:
        df = replace(labels, columns=tuple(others)).encode(df, unseen="keep")
    return df.withColumns({f"{c}_code": unit_bucket(c, categorical[c]) for c in categorical if c in seasonal})
