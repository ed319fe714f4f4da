import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.operators import encode, profile, scale
from panelwright.plans.lookup import key_lookup
from panelwright.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    data = [(g, i, float(x), float(rng.integers(0, 4))) for g in "ab" for i, x in enumerate(rng.normal(5 if g == "a" else -40, 9, 60))]
    return spark.createDataFrame(data, "g string, i int, x double, y double").cache()


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust", "maxabs", "onlymax"])
@pytest.mark.parametrize("groups", [["g"], []])
def test_inverse_undoes_scaling(frame, kind, groups):
    model = scale.fit_scaler(frame, kind, ["x", "y"], groups).materialize()
    there = model.transform(frame, suffix="_s")
    back = model.inverse(there, {"x_s": "x", "y_s": "y"})
    assert back.filter((F.abs(F.col("x") - F.col("x_s")) > 1e-9) | (F.abs(F.col("y") - F.col("y_s")) > 1e-9)).isEmpty()
    assert back.count() == frame.count()


def test_parameters_equal_numpy(frame):
    pdf = frame.toPandas()
    for g, part in pdf.groupby("g"):
        x = part["x"].to_numpy()
        want = {
            "standard": (x.mean(), x.std()),
            "minmax": (x.min(), x.max() - x.min()),
            "robust": (np.median(x), np.percentile(x, 75) - np.percentile(x, 25)),
            "maxabs": (0, np.abs(x).max()),
            "onlymax": (0, x.max()),
        }
        for kind, (c, s) in want.items():
            r = scale.fit_scaler(frame, kind, ["x"], ["g"]).params.filter(F.col("g") == g).first()
            assert (r["x__center"], r["x__scale"]) == pytest.approx((c, s))


def test_constant_column_has_scale_one(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    for kind in scale.available_scalers():
        assert scale.fit_scaler(df, kind, ["x"]).params.first()["x__scale"] == 1.0


def test_unknown_group_and_scaler_are_errors(frame, spark):
    model = scale.fit_scaler(frame, "standard", ["x"], ["g"])
    other = spark.createDataFrame([("zzz", 1, 1.0)], "g string, i int, x double")
    with pytest.raises(Exception, match="without fitted scaler"):
        model.transform(other).collect()
    assert model.transform(other, strict=False).first()["x"] is None
    with pytest.raises(ValueError, match="unknown scaler"):
        scale.fit_scaler(frame, "nope", ["x"])


def test_own_scaler(frame):
    scale.register_scaler("range2", lambda c: (F.min(c), (F.max(c) - F.min(c)) * 2))
    out = scale.fit_scaler(frame, "range2", ["x"]).transform(frame)
    assert out.agg(F.max("x")).first()[0] == pytest.approx(0.5)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    """Small groups, heavy ties, extreme values; a coarse sketch must not matter."""
    rng = np.random.default_rng(11)
    groups = {
        "one": [5.0], "two": [1.0, 9.0], "three": [3.0, 1.0, 2.0], "same": [7.0] * 500,
        "ties": list(rng.integers(0, 3, 700).astype(float)), "wide": list(rng.normal(0, 1e6, 1500)),
        "skew": list(np.exp(rng.normal(0, 4, 900))) + [0.0] * 400,
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("two", float("nan"))]
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = exact_quantiles(spark.createDataFrame(data, "g string, v double").repartition(7), ["g"], ["v"], probs, accuracy=accuracy)
    got = {(r.g, r.probability): r.value for r in out.collect()}
    assert len(got) == len(groups) * len(probs)
    for g, vs in groups.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (g, p)


def test_lookup_ways_agree(spark):
    facts = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("t")).withColumn("k", F.when(F.col("k") < 6, F.col("k")))
    table = spark.createDataFrame([(i, i * 10) for i in range(5)] + [(None, -1)], "k long, v long")
    want = sorted((r.k is None, r.k, r.t, r.v) for r in key_lookup(facts, table, ["k"], size=100).collect())
    for kw in ({}, {"size": 1 << 40}):
        got = sorted((r.k is None, r.k, r.t, r.v) for r in key_lookup(facts, table, ["k"], **kw).collect())
        assert got == want and len(got) == 500


def test_label_codes_follow_text_order(spark):
    df = spark.createDataFrame([("10",), ("2",), (None,), ("b",), ("2",)], "c string")
    for lazy in (False, True):
        m = encode.fit_labels(df, ["c"], lazy=lazy)
        assert {r.label: r.code for r in m.table.collect()} == {"10": 0, "2": 1, "b": 2, "nan": 3}
        assert sorted(r.c_code for r in m.encode(df).collect()) == [0, 1, 1, 2, 3]


def test_unseen_labels(spark):
    known = encode.fit_labels(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    assert [r.label for r in known.unseen(new).collect()] == ["z"]
    with pytest.raises(Exception, match="unseen label"):
        known.encode(new).collect()
    assert {r.c: r.c_code for r in known.encode(new, unseen="keep").collect()} == {"a": 0, "z": 2}
    assert {r.c: r.c_code for r in known.encode(new, unseen="null").collect()} == {"a": 0, "z": None}


def test_one_hot_is_fitted(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    cats = {"c": encode.categories_of(train, "c")}
    out = encode.one_hot(spark.createDataFrame([("b",), ("new",)], "c string"), cats)
    assert out.columns == ["c_a", "c_b"] and [tuple(r) for r in out.collect()] == [(0, 1), (0, 0)]
    with pytest.raises(ValueError, match="more than"):
        encode.categories_of(train, "c", limit=1)


def test_profile_rules(spark):
    data = [(i, i % 3, float(i % 3), i * 1000 % 5000, str(i % 4), i % 2 == 0, float(np.sin(i % 24)), None) for i in range(200)]
    df = spark.createDataFrame(data, "id int, few int, fewf double, wide int, text string, flag boolean, hour_sin double, empty double")
    got = {r["column"]: (r["kind"], r["categories"]) for r in profile.profile_features(df).collect()}
    assert got == {
        "id": ("numeric", None), "few": ("categorical", 3), "fewf": ("categorical", 3), "wide": ("numeric", None),
        "text": ("categorical", 4), "flag": ("categorical", 2), "hour_sin": ("seasonal", 24), "empty": ("numeric", None),
    }
    assert profile.seasonal_pairs(["a_sin", "a_cos", "b_sin"]) == {"a": ("a_sin", "a_cos")}


def test_cardinality_exact_and_approximate(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    assert {r["column"]: r.categories for r in profile.cardinality(df, ["a", "b"]).collect()} == {"a": 10, "b": 1000}
    approx = {r["column"]: r.categories for r in profile.cardinality(df, ["a", "b"], approximate=True).collect()}
    assert approx["a"] == 10 and abs(approx["b"] - 1000) < 100


def test_one_hot_vector_has_room_for_any_number_of_categories(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.range(5000).selectExpr("lpad(id, 5, '0') AS c")
    labels = encode.fit_labels(train, ["c"])
    rows = spark.createDataFrame([("00000",), ("04999",), ("other",), (None,)], "c string")
    out = encode.one_hot_vector(rows, labels, "c", "hot")
    assert out.columns == ["c", "hot"]
    got = {r.c: r.hot for r in out.collect()}
    assert {v.size for v in got.values()} == {5001}
    assert {c: list(v.indices) for c, v in got.items()} == {"00000": [0], "04999": [4999], "other": [5000], None: [5000]}
    assert out.select(vector_to_array("hot")[0].alias("first")).agg(F.sum("first")).first()[0] == 1.0
