import datetime as dt
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from panelwright.sources import readers, sinks
from panelwright.sources.cache import materialize
from panelwright.spec import PanelSpec


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


CRYPTO = """Datetime,Open,High,Low,Close,Volume,Dividends,Stock Splits
2024-01-01 00:00:00+00:00,1,2,0.5,1.5,10,0,0
2024-01-01 05:30:00+05:30,1,2,0.5,1.6,11,0,0
2024-01-01 00:01:00+00:00,1,2,0.5,,12,0,0
"""


def test_daily_file_with_offsets(spark, tmp_path):
    out = readers.read_ohlcv_daily(spark, write(tmp_path, "c.csv", CRYPTO), schema=None)
    assert set(out.columns) == {"open", "high", "low", "close", "volume", "date", "dividends", "stock splits"}
    assert [r["date"] for r in rows(out, "close")] == [dt.datetime(2024, 1, 1)] * 2


def test_minute_file_is_cleaned(spark, tmp_path):
    spec = PanelSpec("timestamp", step=60)
    out = readers.read_ohlcv_intraday(spark, write(tmp_path, "c.csv", CRYPTO), spec)
    assert out.count() == 1  # one empty close, two bars of the same instant


def test_ambiguous_names_are_an_error(spark):
    with pytest.raises(ValueError, match="timestamp"):
        readers.normalize_names(spark.createDataFrame([(1, 2)], "Date int, Time int"), readers.INTRADAY_NAMES)


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_time_series(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="no rows"):
        readers.read_time_series(spark, write(tmp_path, "e.csv", "date,v\n"), schema="date string, v double")


def test_unreadable_dates_become_null_on_request(spark, tmp_path):
    path = write(tmp_path, "t.csv", "date,v\n2024-01-05,1\nsoon,2\n,\n")
    out = rows(readers.read_time_series(spark, path, schema="date string, v double", unreadable="null"), "v")
    assert [(r["date"], r["v"]) for r in out] == [(dt.datetime(2024, 1, 5), 1.0), (None, 2.0)]


def test_non_numeric_column_is_left_out_only_if_any_value_is(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, "2"), ("3", None)], "a string, b string")
    assert readers.fully_numeric(df, ["a", "b"]) == ["a"]


def test_cache_versions(spark, tmp_path):
    calls = []

    def build(n):
        def f():
            calls.append(n)
            return {"train": spark.range(n), "test": spark.range(1)}

        return f

    base, c1 = str(tmp_path), {"version": "v1"}
    assert materialize(spark, base, c1, build(3))["train"].count() == 3
    assert materialize(spark, base, c1, build(4))["train"].count() == 3
    assert materialize(spark, base, c1, build(5), force=True)["train"].count() == 5
    assert materialize(spark, base, {"version": "v2"}, build(6))["train"].count() == 6
    off = {"version": "v3", "cache": {"enabled": False}}
    assert materialize(spark, base, off, build(7))["train"].count() == 7
    assert calls == [3, 5, 6, 7] and not (tmp_path / "v3").exists()
    assert spark.read.text(f"{base}/v1/config").first()[0] == '{"version": "v1"}'


def test_error_tables(spark):
    df = spark.createDataFrame([(1, 100.0, 90.0), (2, 0.0, 5.0)], "Store int, actual double, prediction double")
    out = rows(sinks.errors_table(df, ["Store"], "val", contribution=True), "Store")
    assert out[0] == {"Store": 1, "Actual_Sales": 100.0, "Predicted_Sales": 90.0, "Error": 10.0, "Abs_Error": 10.0,
                      "Pct_Error": 10.0, "RMSPE_Contribution": pytest.approx(0.01), "Dataset": "val"}
    assert (out[1]["Pct_Error"], out[1]["RMSPE_Contribution"]) == (0.0, 0.0)
    assert sinks.errors_table(df.drop("actual"), ["Store"]).columns == ["Store", "Predicted_Sales"]


def test_combining_nothing_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no prediction"):
        sinks.combine_predictions(spark, {"train": str(tmp_path / "a"), "val": None})


def test_submission_clips(spark):
    df = spark.createDataFrame([(1, -4.0), (2, 7.0), (3, None)], "Id long, prediction double")
    assert [r["Sales"] for r in rows(sinks.submission(df), "Id")] == [0.0, 7.0, None]


@pytest.mark.parametrize("read", [
    lambda df, **o: readers.daily_bars(df, **o),
    lambda df, **o: readers.intraday_bars(df, PanelSpec("date", ("g",), ("n",)), **o),
    lambda df, **o: readers.time_series(df, **o),
])
def test_unreadable_times_are_never_lost_unnoticed(spark, read):
    texts = ["01/02/2024 09:30", "2024-02-01 09:31", "soon"]
    df = spark.createDataFrame([(t, "a", n, *[1.0] * 5) for n, t in enumerate(texts)], "date string, g string, n int, open double, high double, low double, close double, volume double")
    with pytest.raises(Exception, match="no time: (soon|01/02/2024 09:30)"):
        read(df).collect()
    day_first = ["dd/MM/yyyy HH:mm"]
    with pytest.raises(Exception, match="no time: soon"):
        read(df, formats=day_first).collect()
    good = df.filter("date <> 'soon'")
    assert {str(r.date) for r in read(good, formats=day_first).collect()} == {"2024-02-01 09:30:00", "2024-02-01 09:31:00"}
    assert tuple(readers.unreadable_times(df, "date", day_first).first()) == (1, "soon")
    assert tuple(readers.unreadable_times(good, "date", day_first).first()) == (0, None)


def test_rows_without_a_time_raise_or_are_dropped_on_request(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (" ", "a", 1.0), ("2024-01-01", "a", 2.0)], "timestamp string, g string, close double")
    spec = PanelSpec("timestamp", ("g",))
    with pytest.raises(Exception, match="a row without timestamp"):
        readers.intraday_bars(df, spec).collect()
    assert readers.intraday_bars(df, spec, missing="drop").count() == 1
    assert readers.as_time(df.filter("timestamp is null").union(spark.createDataFrame([("x", "a", 1.0)], df.schema)), "timestamp", unreadable="null").count() == 2


@pytest.mark.parametrize("name,kind", [("x.orchard/f.csv", "csv"), ("a.parquet/b.json", "json"), ("t.orc", "orc"), ("f.json.gz", "json"), ("d.v1.parquet/", "parquet")])
def test_format_comes_from_the_last_part_of_the_path(spark, tmp_path, name, kind):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    path = str(tmp_path / "made") + f".{kind}"
    df.write.format(kind).option("header", True).save(path)
    target = tmp_path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    if name.endswith(".gz"):
        df.write.format(kind).option("compression", "gzip").save(str(target))
    else:
        os.rename(path, str(target))
    assert [(int(r.n), r.s) for r in readers.read_table(spark, str(target) + ("/" if name.endswith("/") else "")).collect()] == [(1, "a")]


def test_written_tables_can_be_removed(spark):
    from panelwright import session

    session.remove_tables(spark)
    path = session.new_table_path(spark, "kept-shortly")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:")) and session.remove_tables(spark) == 1
    assert not os.path.exists(path.removeprefix("file:")) and session.remove_tables(spark) == 0


def test_the_contexts_checkpoint_directory_is_honoured(spark):
    from panelwright import session

    class Context:
        master = "spark://elsewhere"

        def __init__(self, folder):
            self.getCheckpointDir = lambda: folder

    class Session:
        def __init__(self, folder, named=None):
            self.sparkContext = Context(folder)
            self.conf = {"spark.checkpoint.dir": named}

    assert session.shared_folder(Session("hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_folder(Session("hdfs://x/y", "s3://b/z/")) == "s3://b/z"
    with pytest.raises(RuntimeError):
        session.shared_folder(Session(None))
