import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from panelwright.operators.experiments import append_experiment, claim_experiment_id, read_experiments
from panelwright.sources import commit
from panelwright.sources.cache import clean, materialize


def tables(spark, n):
    return lambda: {"train": spark.range(n), "test": spark.range(n, 2 * n)}


V1 = {"version": "v1"}


def stored(spark, base):
    def never():
        raise AssertionError("nothing is stored")

    return {n: t.count() for n, t in materialize(spark, base, V1, never).items()}


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path):
    base = str(tmp_path / "sets")
    materialize(spark, base, V1, tables(spark, 3))

    def half():
        bad = spark.range(9).selectExpr("raise_error('broken') AS id")
        return {"train": spark.range(9), "test": bad}

    with pytest.raises(Exception, match="broken"):
        materialize(spark, base, V1, half, force=True)
    assert stored(spark, base) == {"train": 3, "test": 3}
    assert len([n for n in commit.names(spark, f"{base}/v1") if n.startswith("data-")]) == 2
    assert clean(spark, base, "v1") == 1 and stored(spark, base) == {"train": 3, "test": 3}


def test_a_first_writer_that_fails_leaves_nothing(spark, tmp_path):
    base = str(tmp_path / "sets")
    with pytest.raises(Exception, match="broken"):
        materialize(spark, base, V1, lambda: {"train": spark.range(1), "test": spark.range(1).selectExpr("raise_error('broken') AS id")})
    with pytest.raises(AssertionError, match="nothing is stored"):
        stored(spark, base)


def test_readers_see_one_version_while_another_is_written(spark, tmp_path):
    base = str(tmp_path / "sets")
    first = materialize(spark, base, V1, tables(spark, 3))
    train_is_written, go_on, seen = threading.Event(), threading.Event(), []

    class Slow(dict):
        def __getitem__(self, name):
            if name == "test":  # the new train table stands, the test table does not yet
                train_is_written.set()
                assert go_on.wait(60)
            return super().__getitem__(name)

    writer = threading.Thread(target=lambda: materialize(spark, base, V1, lambda: Slow(tables(spark, 8)()), force=True))
    writer.start()
    assert train_is_written.wait(60)
    seen.append(stored(spark, base))
    go_on.set()
    writer.join(60)
    seen.append(stored(spark, base))
    assert seen == [{"train": 3, "test": 3}, {"train": 8, "test": 8}]
    assert first["train"].count() == 3  # whoever reads the old one still can


def test_writers_at_the_same_time_get_manifests_of_their_own(spark, tmp_path):
    base = str(tmp_path / "sets")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: materialize(spark, base, V1, tables(spark, n), force=True), range(2, 8)))
    found = [n for n in commit.names(spark, f"{base}/v1") if n.startswith("manifest-")]
    assert found == [f"manifest-{k:08d}.json" for k in range(1, 7)]
    got = stored(spark, base)
    assert got["train"] == got["test"] in range(2, 8)


def test_a_path_is_claimed_once(spark, tmp_path):
    path = str(tmp_path / "ids" / "one")
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: commit.claim(spark, path), range(40))) == 1


def test_runs_at_the_same_time_get_different_ids(spark, tmp_path):
    path = str(tmp_path / "log")
    append_experiment(spark, path, experiment_id="exp_004", val_rmspe=0.1)
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda _: claim_experiment_id(spark, path), range(12)))
    assert sorted(ids) == [f"exp_{k:03d}" for k in range(5, 17)]
    append_experiment(spark, path, experiment_id=ids[0], val_rmspe=0.2)
    assert read_experiments(spark, path).count() == 2  # claims are no rows


def test_files_appear_whole(spark, tmp_path):
    path = str(tmp_path / "f" / "a.json")
    commit.put(spark, path, "some text, é")
    assert commit.text_of(spark, path) == "some text, é" and "a.json" in commit.names(spark, str(tmp_path / "f"))
    assert not [n for n in commit.names(spark, str(tmp_path / "f")) if n.endswith(".draft")]
    assert commit.names(spark, str(tmp_path / "none")) == [] and commit.newest(spark, str(tmp_path / "none")) is None
