import datetime as dt
import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.operators import evaluate as ev
from panelwright.operators import split, targets
from panelwright.operators.sequence import latest_window, sequence_windows
from panelwright.plans.blocks import over_blocks
from panelwright.spec import PanelSpec

D0 = dt.datetime(2024, 1, 1)
SPEC = PanelSpec("date", ("symbol",), cell_steps=3, block_rows=4)


@pytest.fixture(scope="module")
def panel(spark):
    """Four groups of ten days, close = base + day."""
    data = [(s, D0 + dt.timedelta(days=i), float(b + i)) for s, b in zip("ABCD", (100, 200, 300, 400)) for i in range(10)]
    return spark.createDataFrame(data, "symbol string, date timestamp_ntz, close double")


def test_shifted_targets_by_hand(panel):
    out = rows(targets.shift_targets(panel, SPEC, "close", 3), "symbol", "date")
    assert len(out) == 4 * 7
    for r in out:
        assert [r[f"close_target_h{h}"] - r["close"] for h in (1, 2, 3)] == [1, 2, 3]


def test_shift_drops_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 3.0), ("a", 2, 4.0)], "g string, k int, v double")
    assert targets.shift_targets(df, PanelSpec("k", ("g",), step=1), "v").count() == 1


def test_forward_returns_by_hand(panel):
    out = over_blocks(panel, SPEC, targets.forward_returns("close", (1, 3)))
    for r in out.collect():
        day = (r.date - D0).days
        assert r.return_1d == (pytest.approx(100 / r.close) if day < 9 else None)
        assert r.return_3d == (pytest.approx(300 / r.close) if day < 7 else None)


def test_returns_around_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 5.0), ("a", 4, 0.0)], "g string, k int, close double")
    spec = PanelSpec("k", ("g",), step=1)
    simple = [r["return_1d"] for r in rows(over_blocks(df, spec, targets.forward_returns("close", (1,))), "k")]
    assert simple == [None, float("inf"), -100.0, None]
    log = [r["return_1d"] for r in rows(over_blocks(df, spec, targets.forward_returns("close", (1,), "log")), "k")]
    assert log == [None, float("inf"), float("-inf"), None]


def test_validate_returns(panel, spark):
    out = over_blocks(panel, SPEC, targets.forward_returns("close", (1,)))
    assert targets.validate_returns(out, [1])
    with pytest.raises(ValueError, match="missing"):
        targets.validate_returns(out, [2])
    with pytest.raises(ValueError, match="no values"):
        targets.validate_returns(out.withColumn("return_1d", F.lit(None).cast("double")), [1])
    with pytest.raises(ValueError, match="only"):
        targets.validate_returns(out.withColumn("return_1d", F.when(F.col("close") == 100.0, 1.0)), [1])


def test_windows_and_their_targets(panel):
    shifted = targets.shift_targets(panel, SPEC, "close", 1)
    out = rows(sequence_windows(shifted, SPEC, ["close"], 4), "symbol", "date")
    assert len(out) == 4 * (9 - 4 + 1)
    for r in out:
        assert [w[0] for w in r["window"]] == [r["close"] - 3, r["close"] - 2, r["close"] - 1, r["close"]]
        assert r["close_target_h1"] == r["close"] + 1


def test_group_as_long_as_the_window_has_none(panel):
    assert sequence_windows(panel, SPEC, ["close"], 10).count() == 0
    assert sequence_windows(panel, SPEC, ["close"], 9).count() == 8


def test_latest_window(panel):
    out = rows(latest_window(panel, SPEC, ["close"], 3), "symbol")
    assert [[w[0] for w in r["window"]] for r in out] == [[b + 7.0, b + 8.0, b + 9.0] for b in (100, 200, 300, 400)]


def test_alignment_is_by_key(panel):
    shifted = targets.shift_targets(panel, SPEC, "close", 2)
    p = ev.persistence_forecast(shifted, SPEC, ["close"], 2)
    a = ev.actuals_long(shifted, SPEC, ["close"], 2)
    for r in ev.align(p.filter("symbol <> 'B'"), a, SPEC).collect():
        assert r.actual - r.prediction == r.horizon and r.symbol != "B"


def plain_split(n, t, v, length, overlap, grouped):
    """The rules on a list 0..n-1: (split -> positions), positions of context included."""
    o = max(0, length - 1) if overlap else 0
    if grouped and n < t + v + 2 * length + 10:
        return {}
    if not grouped and t > 0 and n <= t:
        return {"train": list(range(n))}
    rest, test = list(range(n - t)), list(range(n - t, n))
    val = rest[len(rest) - v :] if v > 0 and len(rest) > v else None
    train = rest[: len(rest) - v] if val is not None else rest
    source = val if val is not None else train
    out = {"train": train}
    if val is not None:
        out["val"] = (train[len(train) - o :] if o and len(train) >= o else []) + val
    if t > 0:
        out["test"] = (source[len(source) - o :] if o and len(source) >= o else []) + test
    return {k: x for k, x in out.items() if x}


@pytest.mark.parametrize("grouped", [True, False])
def test_split_equals_plain_rules(spark, grouped):
    sizes = {"a": 23, "b": 31, "c": 40, "d": 64} if grouped else {"a": 31}
    data = [(g, D0 + dt.timedelta(days=i), i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "g string, date timestamp_ntz, i int").cache()
    spec = PanelSpec("date", ("g",) if grouped else (), cell_steps=5, block_rows=6)
    sizes_and_context = [*itertools.product((0, 5, 40), (None, 6, 35), [(4, True)]), (5, 6, (9, True)), (5, 35, (9, True)), (5, 6, (1, True)), (5, 6, (4, False))]
    for t, v, (length, overlap) in sizes_and_context:
        got = {}
        for r in split.split_time_series(df, spec, t, v, length, overlap).collect():
            got.setdefault(r.g, {}).setdefault(r.split, []).append(r.i)
        want = {g: plain_split(n, t, v or 0, length, overlap, grouped) for g, n in sizes.items()}
        want = {g: x for g, x in want.items() if x}
        assert {g: {k: sorted(x) for k, x in s.items()} for g, s in got.items()} == want, (t, v, length, overlap)


def test_overlap_adds_context_per_group(spark):
    data = [(g, D0 + dt.timedelta(days=i)) for g in "ab" for i in range(150)]
    df = spark.createDataFrame(data, "g string, date timestamp_ntz")
    spec = PanelSpec("date", ("g",))
    sizes = lambda x: {r.split: r["count"] for r in split.split_time_series(df, spec, 20, 20, 10, x).groupBy("split").count().collect()}
    with_it, without = sizes(True), sizes(False)
    assert {k: with_it[k] - without[k] for k in with_it} == {"train": 0, "val": 18, "test": 18}
    assert sum(without.values()) == 300


def test_no_group_long_enough(spark):
    df = spark.createDataFrame([("a", D0)], "g string, date timestamp_ntz")
    with pytest.raises(ValueError, match="no group"):
        split.require_some_group(split.split_time_series(df, PanelSpec("date", ("g",)), 5))


def test_features_do_not_see_the_future(spark, sf):
    """Changing everything after a time leaves all features up to it as they were."""
    from panelwright.catalog import views
    from panelwright.operators.rolling import rolling_features, technical_features

    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    bars = views.bars(spark, sf)
    changed = bars.withColumns({c: F.when(F.col("ts") > cut, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    features = [*technical_features(), rolling_features("close", [5])]
    a, b = (over_blocks(x, views.BAR, *features).filter(F.col("ts") <= cut) for x in (bars, changed))
    assert a.count() > 100 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
