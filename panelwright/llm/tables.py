"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, new_table_path

#: Fixed value: the six white-space bytes that separate words.
WORD = r"[^\x20\x09-\x0D]+"


#: Folder that holds this library.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets the Python workers import this library where it stands at the same path as here; on
    other clusters it comes with ``--py-files``."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [HOME, *paths] if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives the loss of an
    executor, and tells Spark the table's real size, from which it chooses its joins."""
    importable(df.sparkSession)
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_in(text: Column) -> Column:
    """Number of words (runs without white space); a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds the row's position (from 0) in the given order. The rows are range partitioned and
    sorted; each partition starts where the one before it ends, so no task sees all rows. The
    sorted rows are checkpointed first, so that a repeated task cannot move a row."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # one row per partition of the table
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return fixed.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_row") - F.col("_first")).select(*df.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of rows (a, b): (node, root) for every node of an edge, the root being
    the smallest node it reaches. Alternates two star steps, each a map-side minimum per node and
    a join that Spark splits where a node is hot; each round is written out."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(pairs, "edges"), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = mark
        # larger neighbours move to the smallest neighbour ...
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # ... then a node and its smaller neighbours do
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        to_low = [F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("a", "b")]
        small = large.join(low, "a").select(F.explode(F.array(*to_low)).alias("e"))
        now = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")


_HELD: dict = {}


def held(key, make):
    """The one large object that a worker process keeps between tasks (a model, a cache of
    encoded words); another key replaces it, so that the stages of a pipeline do not pile up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Returns memory that earlier tasks of this worker process have freed to the system, where its
    allocator can be told to."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
