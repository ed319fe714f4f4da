"""Reading time series, price bars and sales tables; names, types and times normalised."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.clean import clean_ohlc_intraday
from panelwright.plans.lookup import key_lookup, measured
from panelwright.spec import OHLCV, PanelSpec, require_columns

# Other spellings of minute bar columns.
INTRADAY_NAMES = {
    "Datetime": "timestamp",
    "Date": "timestamp",
    "Time": "timestamp",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
    "Vol": "volume",
    "Symbol": "symbol",
}


def read_table(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame:
    """CSV with header, or parquet / JSON / ORC by the ending of the last part of the path (a
    compression's ending may follow) or ``fmt``. Give a schema for large files: without one a CSV
    is read twice."""
    endings = posixpath.basename(urlsplit(path).path.rstrip("/")).lower().split(".")[1:][-2:]
    fmt = fmt or next((e for e in reversed(endings) if e in ("parquet", "json", "orc", "csv")), "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def _parsed(df: DataFrame, name: str, formats: Sequence[str]) -> Column:
    """The text column as a timestamp without zone; null where no form fits."""
    c = F.col(f"`{name}`")
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.rlike(r"\d:\d")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(c).cast("timestamp_ntz"))
    plain = F.expr(f"try_cast(`{name}` as timestamp_ntz)")
    given = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(F.when(zoned, utc).otherwise(plain), *given)


def as_time(df: DataFrame, name: str, formats: Sequence[str] = (), unreadable: str = "error") -> DataFrame:
    """Text becomes a timestamp without zone; text or timestamps with a zone become UTC first;
    dates become midnight. Text is read in ISO form, then by the ``formats`` in turn. A text that
    no form fits raises and is named; ``unreadable="null"`` makes it null instead (count such
    rows with ``unreadable_times`` first). Null and blank texts are null."""
    if unreadable not in ("error", "null"):
        raise ValueError(f"unknown treatment of unreadable times: {unreadable!r}")
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        time = _parsed(df, name, formats)
        if unreadable == "error":
            complain = F.raise_error(F.concat(F.lit(f"{name} holds a text that is no time: "), c)).cast("timestamp_ntz")
            time = F.coalesce(time, F.when(F.trim(c) != "", complain))
        return df.withColumn(name, time)
    if isinstance(kind, T.TimestampType):
        return df.withColumn(name, utc_naive(c))
    if isinstance(kind, T.DateType):
        return df.withColumn(name, c.cast("timestamp_ntz"))
    return df


def unreadable_times(df: DataFrame, name: str, formats: Sequence[str] = ()) -> DataFrame:
    """One row (rows, example): how many texts of the column are no time, and one of them."""
    bad = F.when((F.trim(f"`{name}`") != "") & _parsed(df, name, formats).isNull(), F.col(f"`{name}`"))
    return df.agg(F.count(bad).alias("rows"), F.min(bad).alias("example"))


def without_null_times(df: DataFrame, name: str, missing: str) -> DataFrame:
    """Rows without a time have no place in an ordered panel: they raise, or are dropped if
    ``missing`` says so."""
    if missing == "drop":
        return df.filter(F.col(f"`{name}`").isNotNull())
    if missing != "error":
        raise ValueError(f"unknown treatment of missing times: {missing!r}")
    kind = df.schema[name].dataType
    return df.withColumn(name, F.coalesce(f"`{name}`", F.raise_error(F.lit(f"a row without {name}")).cast(kind)))


def utc_naive(c: Column) -> Column:
    """An instant as UTC wall time without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def normalize_names(df: DataFrame, renames: dict[str, str] | None = None, lower: bool = False) -> DataFrame:
    """Lower-case and / or rename columns; two columns with the same new name are an error."""
    new = [c.lower() if lower else c for c in df.columns]
    new = [(renames or {}).get(c, c) for c in new]
    twice = sorted({c for c in new if new.count(c) > 1})
    if twice:
        raise ValueError(f"several columns would be called {twice}")
    return df.toDF(*new)


def drop_nan(df: DataFrame) -> DataFrame:
    """NaN in floating point columns becomes null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def time_series(df: DataFrame, date_column: str = "date", formats: Sequence[str] = (), unreadable: str = "error") -> DataFrame:
    """Parsed date column, no rows without any value."""
    df = drop_nan(df)
    if date_column in df.columns:
        df = as_time(df, date_column, formats, unreadable)
    return df.na.drop("all")


def read_time_series(
    spark: SparkSession, path: str, date_column: str = "date", schema=None, check: bool = True, formats: Sequence[str] = (), unreadable: str = "error"
) -> DataFrame:
    """Any time series file. ``check`` raises if nothing is left (a one-row job)."""
    out = time_series(read_table(spark, path, schema), date_column, formats, unreadable)
    if check and out.limit(1).isEmpty():
        raise ValueError(f"no rows left in {path}")
    return out


#: Rows of one stretch of a file that keep their order; Spark numbers no more in a partition.
_IN_SPLIT = 1 << 33


def with_ingest_order(df: DataFrame, name: str = "_ingest") -> DataFrame:
    """Adds a number that rises in the order of ingest: by file path, then by the rows' order in the
    file. ``df`` must come straight from files of any format; no id is needed. The number has
    gaps: the stretches in which Spark reads the files are ranked (a row per stretch), and rows
    count on inside theirs. File names must sort in the order the files were written."""
    where = {"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start")}
    stretches = df.select(*[c.alias(k) for k, c in where.items()]).distinct()
    ranks = stretches.withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_from")) - 1)
    ranks, size = measured(ranks)
    in_split = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_SPLIT - 1))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(k) for k, c in where.items()], in_split.alias("_at"))
    placed = key_lookup(rows, ranks, ["_file", "_from"], size=size, how="inner")
    return placed.withColumn(name, F.col("_rank") * F.lit(_IN_SPLIT) + F.col("_at")).drop("_file", "_from", "_rank", "_at")


def fully_numeric(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose every non-null value reads as a number: numeric types by schema, texts
    by one aggregate over all of them."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in texts])
        row = bad.first()
        numeric += [c for c in texts if row[c] == 0]
    return [c for c in columns if c in numeric]


def daily_bars(
    df: DataFrame,
    date_column: str = "date",
    group_column: str | None = None,
    extra: list[str] | None = None,
    formats: Sequence[str] = (),
    unreadable: str = "error",
    missing: str = "error",
) -> DataFrame:
    """Daily bars from a raw table: lower-case names, OHLCV, date, group and the numeric
    columns (``extra`` names them, otherwise text columns are looked at once), rows with
    missing OHLCV dropped. Unreadable and missing dates raise unless told otherwise."""
    df = normalize_names(drop_nan(df), lower=True)
    date_column, group = date_column.lower(), group_column.lower() if group_column else None
    if "datetime" in df.columns and "date" not in df.columns:
        df, date_column = df.withColumnRenamed("datetime", "date"), "date"
    ohlcv = [c for c in OHLCV if c in df.columns]
    keys = [c for c in (date_column, group) if c and c in df.columns]
    rest = [c for c in df.columns if c not in (*ohlcv, *keys)]
    kept = [c for c in rest if c in extra] if extra is not None else fully_numeric(df, rest)

    def number(c):
        kind = df.schema[c].dataType
        return F.col(c) if isinstance(kind, T.NumericType) else F.expr(f"try_cast(`{c}` as double)").alias(c)

    out = df.select(*[number(c) for c in ohlcv], *keys, *[number(c) for c in kept])
    out = out.na.drop(subset=ohlcv) if ohlcv else out
    if date_column in out.columns:
        out = without_null_times(as_time(out, date_column, formats, unreadable), date_column, missing)
    return out


def read_ohlcv_daily(
    spark: SparkSession, path: str, date_column: str = "date", group_column: str | None = None, schema=None, **options
) -> DataFrame:
    """``options`` are those of ``daily_bars``."""
    return daily_bars(read_table(spark, path, schema), date_column, group_column, **options)


def intraday_bars(
    df: DataFrame, spec: PanelSpec, validate: bool = True, formats: Sequence[str] = (), unreadable: str = "error", missing: str = "error"
) -> DataFrame:
    """Minute bars from a raw table: usual names, UTC time without zone, optionally cleaned.
    Unreadable and missing times raise unless told otherwise, before copies are merged."""
    df = normalize_names(drop_nan(df), INTRADAY_NAMES)
    require_columns(df, spec.time)
    df = without_null_times(as_time(df, spec.time, formats, unreadable), spec.time, missing)
    return clean_ohlc_intraday(df, spec) if validate else df


def read_ohlcv_intraday(spark: SparkSession, path: str, spec: PanelSpec, validate: bool = True, schema=None, **options) -> DataFrame:
    """``options`` are those of ``intraday_bars``."""
    return intraday_bars(read_table(spark, path, schema), spec, validate, **options)


def read_sales_tables(spark: SparkSession, folder: str, fmt: str = "csv", schemas: dict | None = None):
    """(train, test, store) from one folder."""
    schemas = schemas or {}
    return tuple(
        read_table(spark, f"{folder}/{name}.{fmt}", schemas.get(name), fmt) for name in ("train", "test", "store")
    )
