"""Exact top-k search with multi-resolution segment statistics.

Vectors are integers (components times ``SCALE``, rounded down); the score is the inner product.
Each vector is summed up by the means and deviations of 1, 4, then 16 segments. The segments'
statistics bound the squared distance from below by sum l((m - m')^2 + (s - s')^2), and since
2<q, v> = |q|^2 + |v|^2 - |q - v|^2, the score from above.

Queries and candidates are dealt into blocks of bounded size by a hash; every pair of blocks is
one group's work and returns at most k rows a query, which are then merged per query. Inside a
block the candidates stand in the order of their coarse statistics, in runs of ``RUN`` rows with
the least and largest value of every statistic. A query meets the run that bounds it highest
first; each run raises its k-th best score, and a run whose bound is under it is not opened. In
an opened run the levels thin the candidates, coarse to fine; survivors get their exact scores.

Defined results: vectors that are null or hold null or non-finite components take no part, empty
vectors score 0; only vectors of equal length are compared; rows of the query's own id are no
candidates; a repeated ``vec_id`` is a candidate as often as it stands there, a repeated query one
query, and if its rows hold different vectors, a candidate row counts with its best score; ties go
to the smaller id; scores must fit 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.tables import written

SCALE, EVERY, BEST = 64, 20, 20
LEVELS = (1, 4, 16)
QUERIES, CANDIDATES = 2048, 16384  # rows of a block
AT_ONCE = 256  # queries whose bounds are held in memory together
RUN = 2048  # candidates that are opened together
EXACT, SHORT = 2.0**52, 2.0**24  # sums below are exact in doubles and in floats


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as whole numbers."""
    values = F.col("embedding").cast("array<double>")
    real = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & values.isNotNull() & real).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(values, lambda x: F.floor(x * scale).cast("double")).alias("v")
    )


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Per segment, sqrt(l) times mean and deviation: their inner products bound those of the vectors."""
    if not v.shape[1]:
        return np.zeros((len(v), 2))
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    parts = [v[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    means = [p.sum(axis=1) / np.sqrt(p.shape[1]) for p in parts]
    spreads = [np.sqrt(np.maximum((p * p).sum(axis=1) - m * m, 0)) for p, m in zip(parts, means, strict=True)]
    return np.stack([*means, *spreads], axis=1)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, in doubles where these are exact."""
    if len(q) and np.abs(q).max() * np.abs(v).max() * q.shape[1] >= EXACT:
        return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)], object)
    return np.einsum("ij,ij->i", q, v)


def search(q_ids, q, v_ids, v, best: int = BEST):
    """(query row, candidate row, score) of the best candidates of each query."""
    order = np.lexsort(statistics(v, LEVELS[1]).T)
    levels = [(statistics(q, n), statistics(v, n)[order]) for n in LEVELS]
    runs = [slice(k, k + RUN) for k in range(0, len(v), RUN)]
    boxes = [(np.stack([s[r].min(axis=0) for r in runs]), np.stack([s[r].max(axis=0) for r in runs])) for _, s in levels]
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max() + 1e-6
    ids, v = v_ids[order], v[order]
    largest = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1)
    if largest < SHORT:
        q, v = q.astype(np.float32), v.astype(np.float32)
    for at in range(0, len(q), AT_ONCE):
        rows = slice(at, at + AT_ONCE)
        reach = np.min([_box_bound(mine[rows], *box) for (mine, _), box in zip(levels, boxes, strict=True)], axis=0) + slack[rows, None]
        known = np.full(len(reach), -np.inf)
        pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if largest >= EXACT else float)
        # each step opens for every query the best of the runs that it has not met
        for nth in np.argsort(-reach, axis=1, kind="stable").T:
            for k in np.unique(nth):
                mine = np.flatnonzero((nth == k) & (reach[:, k] >= known))
                if not len(mine):
                    continue
                i, j, scores = _opened(q, v, q_ids, ids, levels, at + mine, runs[k], known[mine] - slack[at + mine], known[mine], largest, best)
                pool = tuple(np.concatenate(x) for x in zip(pool, (mine[i], j + runs[k].start, scores), strict=True))
            pool, known = _best_of(pool, ids, best, len(reach))
            if (reach < known[:, None]).all():
                break
        i, j, scores = pool
        yield i + at, order[j], scores


def _box_bound(s, low, high):
    """The largest product that each row of ``s`` can have with anything inside each box."""
    return np.maximum(s, 0) @ high.T + np.minimum(s, 0) @ low.T


def _opened(q, v, q_ids, v_ids, levels, mine, run, floor, known, largest, best):
    """Candidates of a run whose exact score reaches a query's k-th best one."""
    alive = q_ids[mine][:, None] != v_ids[None, run]
    for ours, theirs in levels:
        # bounds of the pairs that are left, one by one only where few are
        if np.count_nonzero(alive) > alive.size // 8:
            alive &= ours[mine] @ theirs[run].T >= floor[:, None]
        else:
            i, j = np.nonzero(alive)
            alive[i, j] = np.einsum("ij,ij->i", ours[mine[i]], theirs[run][j]) >= floor[i]
    if largest < EXACT and np.count_nonzero(alive) > alive.size // 8:
        scores = np.where(alive, q[mine] @ v[run].T, -np.inf)
        high = scores >= known[:, None]
        if np.count_nonzero(high) > 4 * best * len(mine) and scores.shape[1] > best:
            # the run by itself has that many of at least this score
            high &= scores >= np.partition(scores, -best, axis=1)[:, -best, None]
        i, j = np.nonzero(high & alive)
        return i, j, scores[i, j].astype(float)
    i, j = np.nonzero(alive)
    parts = [exact_scores(q[mine[i[k : k + 100_000]]], v[run][j[k : k + 100_000]]) for k in range(0, len(i), 100_000)]
    scores = np.concatenate(parts) if parts else np.zeros(0)
    # beyond doubles the k-th best score is only known rounded
    high = scores >= known[i] if largest < EXACT else np.ones(len(i), bool)
    return i[high], j[high], scores[high]


def _best_of(pool, v_ids, best, n):
    """The best rows of each query, in order, and the score that the next ones must reach."""
    i, j, scores = pool
    order = np.lexsort((v_ids[j], -scores, i))
    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
    order, place = order[place < best], place[place < best]
    known = np.full(n, -np.inf)
    last = order[place == best - 1]
    known[i[last]] = scores[last].astype(float)
    return (i[order], j[order], scores[order]), known


FOUND = "query_id long, row long, vec_id long, score long"


def _cell(best: int):
    def run(rows: pa.Table) -> pa.Table:
        out = []
        sizes = rows.column("size").to_numpy()
        for size in np.unique(sizes):
            mine = rows.filter(pa.array(sizes == size))
            ids, query = mine.column("vec_id").to_numpy(), mine.column("query").to_numpy()
            v = mine.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), size)
            query = query.astype(bool)
            if not query.any() or query.all():
                continue
            q_ids, v_ids, places = ids[query], ids[~query], mine.column("row").to_numpy()[~query]
            for i, j, scores in search(q_ids, v[query], v_ids, v[~query], best):
                out.append((q_ids[i], places[j], v_ids[j], scores.astype(np.int64)))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), parts, strict=True)))

    return run


def top_k(vectors: DataFrame, every: int = EVERY, best: int = BEST, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the best candidates of every row whose id is divisible by
    ``every``."""
    rows = written(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v").distinct().withColumn("row", F.xxhash64("vec_id", "v"))
    across, down = (max(1, -(-n // size)) for n, size in ((rows.count(), candidates), (asked.count(), queries)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    size = F.size("v").cast("long").alias("size")
    cells = asked.select("vec_id", "v", "row", size, F.lit(1).alias("query"), block(down).alias("down"), each(across).alias("across")).unionByName(
        rows.select("vec_id", "v", "row", size, F.lit(0).alias("query"), block(across).alias("across"), each(down).alias("down"))
    )
    found = cells.groupBy("across", "down").applyInArrow(_cell(best), FOUND).groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), candidate AS (SELECT row_number() OVER () AS r, vec_id, v FROM valid),
asked AS (SELECT DISTINCT vec_id, v FROM valid WHERE vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM (SELECT q.vec_id AS query_id, c.r, c.vec_id, max(CAST(list_dot_product(q.v, c.v) AS BIGINT)) AS score
      FROM asked q JOIN candidate c ON q.vec_id <> c.vec_id GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {BEST}
"""
