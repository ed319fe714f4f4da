from pyspark.sql import functions as F

from panelwright.catalog import views
from panelwright.operators.resample import resample_ohlcv
from panelwright.spec import PanelSpec
from panelwright.streaming.bars import dedup_stream, resample_stream

SPEC = PanelSpec("ts", ("event_type",), ("event_id",), step=60)


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    ticks = views.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = (
        resample_stream(stream, "1h", SPEC)
        .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = resample_ohlcv(views.ticks(spark, sf), "1h", SPEC)
    late = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")  # the newest bars are still open
    a, b = (x.filter(F.col("ts") < late).select(sorted(want.columns)) for x in (got, want))
    assert a.count() > 100 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_streamed_duplicates_are_dropped(spark, sf, tmp_path):
    ticks = views.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.unionByName(ticks).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = (
        dedup_stream(stream, SPEC)
        .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == ticks.select("event_type", "ts").distinct().count()
