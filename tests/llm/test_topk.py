import math

import numpy as np
import pytest
from panelwright.llm import topk
from panelwright.llm.tables import importable


def brute(rows, best=20, every=20):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in whole if i % every == 0}:
        mine = [a for i, a in whole if i == q]
        products = [(j, [sum(map(int.__mul__, a, b)) for a in mine if len(a) == len(b)]) for j, b in whole if j != q]
        scores = [(-max(s), j) for j, s in products if s]
        out += [(q, k, j, -s) for k, (s, j) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out)


def vectors(spark, rows):
    importable(spark)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'q' AS query", "2 AS rank", "3 AS size").repartition(3)


def sample(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, d))
    return [(i, (centres[i % 5] + rng.normal(0, 0.1, d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"queries": 3, "candidates": 17}])
def test_search_equals_brute_force(spark, blocks):
    rows = sample(330, 13, 1) + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 13), (1003, [float("inf")] * 13), (None, [1.0] * 13),
                                 (2000, [0.5, -0.5]), (2001, [0.5, -0.5]), (2020, []), (2021, [])]
    rows += [(3000 + k, rows[0][1]) for k in range(45)]  # ties
    got = sorted(tuple(r) for r in topk.top_k(vectors(spark, rows), **blocks).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_repeated_rows(spark):
    rows = sample(60, 5, 2)
    # a repeated candidate, a repeated query, a query id with a second vector
    rows += [rows[7], rows[20], rows[20], (40, rows[11][1])]
    for blocks in ({}, {"queries": 2, "candidates": 9}):
        got = sorted(tuple(r) for r in topk.top_k(vectors(spark, rows), **blocks).collect())
        assert got == brute(rows) and sum(r[0] == 20 for r in got) == 20


def test_statistics_bound_the_products():
    rng = np.random.default_rng(4)
    q, v = (np.floor(rng.normal(0, 30, (40, 24))) for _ in range(2))
    for segments in (1, 4, 16, 99):
        assert (topk.statistics(q, segments) @ topk.statistics(v, segments).T >= q @ v.T - 1e-6).all()


def test_pruning_leaves_few_candidates():
    rows = np.floor(64 * np.array([v for _, v in sample(3000, 64, 3)]))
    ids = np.arange(len(rows))
    got = [x for part in topk.search(ids[:40], rows[:40], ids, rows) for x in zip(*part, strict=True)]
    exact = rows[:40] @ rows.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    assert all([s for i, _, s in got if i == k] == sorted(exact[k], reverse=True)[:20] for k in range(40))


def test_runs_out_of_reach_are_not_opened(monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 40, (6, 16)).repeat(4, axis=1)  # segments differ, so that statistics tell
    rows = np.floor(np.concatenate([c + rng.normal(0, 2, (200, 64)) for c in centres]))
    ids, opened = np.arange(len(rows)), []
    plain = topk._opened

    def counted(*args):
        opened.append(len(args[5]))
        return plain(*args)

    monkeypatch.setattr(topk, "_opened", counted)
    monkeypatch.setattr(topk, "RUN", 50)
    got = [x for part in topk.search(ids[::10], rows[::10], ids, rows) for x in zip(*part, strict=True)]
    exact = rows[::10] @ rows.T
    exact[np.arange(120), ids[::10]] = -np.inf
    assert all([s for i, _, s in got if i == k] == sorted(exact[k], reverse=True)[:20] for k in range(120))
    assert sum(opened) < 120 * 24 / 3  # of 24 runs


def test_large_numbers_stay_exact():
    q = np.array([[2.0**31, 1.0]])
    v = np.array([[2.0**30, 3.0], [2.0**30, 4.0]])
    (found,) = list(topk.search(np.array([0]), q, np.array([1, 2]), v))
    assert [int(s) for s in found[2]] == [2**61 + 4, 2**61 + 3]


def test_empty_table(spark):
    assert topk.top_k(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert topk.top_k(vectors(spark, [(20, [1.0])])).count() == 0
