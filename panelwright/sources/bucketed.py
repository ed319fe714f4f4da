"""Tables that are dealt by their keys when they are written, so that joining them later moves no
row: predictions and actual values, say, that different jobs write and a third compares."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelwright.spec import PanelSpec, require_columns

LAYOUT = "_layout"


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Parquet below ``path``, one sorted file per bucket of ``keys``, and beside it how it is
    dealt. Rows are shuffled once, here."""
    if buckets < 1:
        raise ValueError("a table needs at least one bucket")
    require_columns(df, *keys)
    spark, name = df.sparkSession, _name()
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    try:
        dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    layout = json.dumps({"columns": columns, "keys": list(keys), "buckets": buckets})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``. Spark knows its buckets: joins and groupings by the keys need
    no exchange, if the other table has the same keys and as many buckets."""
    (row,) = spark.read.text(f"{path}/{LAYOUT}").collect()
    layout = json.loads(row[0])
    keys, name = ", ".join(f"`{k}`" for k in layout["keys"]), _name()
    spark.sql(
        f"CREATE TABLE {name} ({layout['columns']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _name() -> str:
    return f"panelwright_{uuid.uuid4().hex}"


def forecast_keys(spec: PanelSpec) -> list[str]:
    """What a prediction and an actual value are matched by."""
    return [*spec.keys, "target", "horizon"]


def write_forecasts(df: DataFrame, path: str, spec: PanelSpec, buckets: int = 64) -> None:
    """Predictions or actual values in long form, dealt for ``align``."""
    write_bucketed(df, path, forecast_keys(spec), buckets)
