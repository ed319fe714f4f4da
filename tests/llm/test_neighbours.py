import math

import numpy as np
import pyarrow as pa
import pytest
from panelwright.llm import neighbours as nb
from panelwright.llm.tables import importable


def brute(rows, similarity=0.9):
    whole = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows)
             if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for k, _, v in whole:
        for j, _, w in whole:
            if k != j and len(v) == len(w) and (v @ w) / math.sqrt((v @ v) * (w @ w)) >= similarity:
                links[k].append(j)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(links[k]), least, i == least))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **kw):
    importable(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'l' AS lead", "2 AS v", "3 AS label", "4 AS `a.b`")
    return sorted((tuple(r) for r in nb.near_duplicates(df.repartition(parts), **kw).collect()), key=str)


def clusters(seed, n, d, groups, spread):
    """Single vectors, and groups around a centre of which some pairs are links and some are not."""
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(0, 1, d).tolist()) for k in range(n)]
    for g, size in enumerate(groups):
        centre = rng.normal(0, 1, d)
        rows += [(10_000 + 1000 * g + k, (centre + rng.normal(0, spread[g % len(spread)], d)).tolist()) for k in range(size)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = clusters(seed, 250, 24, [2, 2, 3, 40, 25], [0.05, 0.2, 0.3, 0.15, 0.33])
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = clusters(4, 30, 5, [6], [0.02])
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 5), (503, [float("inf")] + [0.0] * 4), (504, [0.0] * 5), (505, []), (504, [0.0, -0.0]),
             (None, rows[0][1]), (None, [9.0, 1.0]), (600, [1.0, 0.0]), (601, [2.0, 0.0]), (600, [1.0, 0.0]), (602, [1e200, 0.0]), (603, [0.9, math.sqrt(1 - 0.81) * 1.01]),
             (3, rows[3][1]), (700, [3.0]), (701, [-1.0]), (702, [4.0])]
    assert [x for x in found(spark, rows) if x[0] != 602] == [x for x in brute([r if r[0] != 602 else (602, [1.0, 0.0]) for r in rows]) if x[0] != 602]


def test_copies_and_a_dense_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, 16)
    rows = [(k, centre.tolist()) for k in range(300)]
    rows += [(1000 + k, (centre + rng.normal(0, 0.08, 16)).tolist()) for k in range(200)]
    rows += clusters(6, 100, 16, [], [0.1])
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    got = found(spark, rows)
    assert got == brute(rows)


def test_saturated_lists_are_enlarged(spark, monkeypatch):
    monkeypatch.setattr(nb, "TABLES", 0)  # no balls: all links must come from the lists
    monkeypatch.setattr(nb, "NEAREST", 3)
    rows = clusters(7, 60, 12, [30, 9], [0.1])
    assert found(spark, rows) == brute(rows)


def test_meetings_at_which_nobody_enters_a_list(spark):
    unit = pa.array([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]], pa.list_(pa.float32()))
    rows = pa.record_batch([pa.array([1, 1, 1]), pa.array([0, 0, 0]), pa.array([5, 6, 7]), unit, pa.array([0.95] * 3)], ["center", "part", "nbr", "unit", "floor"])
    assert list(nb._meet(iter([rows]))) == []
    open_list = rows.set_column(4, "floor", pa.array([0.95, 0.5, 0.95]))
    assert [b.to_pydict()["nbr"] for b in nb._meet(iter([open_list]))] == [[5, 7]]


def test_audit_counts_missing_links(spark):
    importable(spark)
    rows = clusters(8, 50, 8, [10], [0.05])
    reps = spark.createDataFrame([(i, (np.array(v) / np.linalg.norm(v)).tolist(), 0.0) for i, v in rows], "id long, unit array<float>, radius double")
    none = spark.createDataFrame([], "id long, nbr long, sim double")
    assert nb.audited(none, reps, 0.9) == (45, 0)
    full = nb.graph(reps, 0.9)
    assert nb.audited(full, reps, 0.9) == (45, 45)


def test_query_equals_brute_force_on_given_vectors(spark, sf):
    from panelwright.llm.queries import op12_embedding_near

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op12_embedding_near(spark, sf).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]
    assert nb.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
