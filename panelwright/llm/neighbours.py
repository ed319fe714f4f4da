"""Embedding near duplicates by NN-descent.

1. Equal vectors are one node. Nodes that share a signature (signs against random directions) with
   a leader and lie within ``BALL`` of it join the leader's ball: any two members are then linked,
   by the triangle inequality of angles, and a dense group of near copies costs its rows, not its
   pairs. What is left are the balls' leaders and the nodes alone.
2. Their neighbour graph starts from nodes that are next to each other in orders by signature, and
   is refined: all pairs of the neighbours (in either direction) of a node are compared where they
   meet, and whoever is nearer than the worst of a list of ``NEAREST`` enters it. Lists that are
   full of links are saturated: they are enlarged twofold. Rounds end when few entries change.
3. The recall is audited: ``AUDITED`` nodes, by hash, are compared with all nodes. Below ``ENOUGH``
   the search goes on from new directions.
4. Edges within the threshold are kept. Two balls whose members must all be linked are counted as
   a whole; where that is open, their members are compared, block by block.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing; only vectors of equal length are compared; a repeated row is a vector of its own; rows
without ``vec_id`` count as vectors, and a component of such rows alone has none; an empty table
gives no rows; other columns (labels too) are not read. Links below the threshold are never
given; links may be missed, see the audit (``audited`` gives its figures).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.tables import components, importable, written

SIMILARITY = 0.9
BITS, TABLES = 16, 4  # of the signatures by which balls are found
NEAREST, SEEDS, BESIDE = 12, 4, 4  # length of a list, first orders, and neighbours taken from each
ROUNDS, STILL = 12, 0.005  # rounds until the next audit at most; share of changed entries that ends them
AUDITED, ENOUGH, AUDITS = 512, 0.98, 6
MEMBERS = 512  # members of a ball that are compared at once
SLACK = 1e-4  # radians: sums of angles and single precision


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): v is null where the vector takes no part."""
    values = F.col("embedding").cast("array<double>")
    real = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    # minus zero is zero
    v = F.when(real, F.transform(values, lambda x: x + F.lit(0.0)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def directions(size: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, n))


def _by_size(batch: pa.RecordBatch | pa.Table, name: str = "v"):
    """Parts of a batch whose vectors have the same length."""
    sizes = pc.list_value_length(batch.column(name)).to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def signed(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds ``signs`` (one signature per table) and ``unit``, the vector of length one."""

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch):
                u = units(matrix(part.column("v")))
                above = (u @ directions(size, bits * tables, seed) > 0).reshape(len(u), tables, bits)
                signs = above @ (1 << np.arange(bits, dtype=np.int64)) + (np.int64(size) << 40)
                lists = [pa.array(list(x), pa.list_(t)) for x, t in ((signs, pa.int64()), (u.astype(np.float32), pa.float32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "signs", "unit"])

    return nodes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", signs array<long>, unit array<float>")


def balls(nodes: DataFrame, similarity: float) -> DataFrame:
    """Nodes (id, v, unit, weight, least) with ``lead``, the leader of their ball (themselves, if
    there is none) and ``away``, the angle to it. Members are within half the linking angle."""
    near = math.cos(math.acos(similarity) / 2 - SLACK)
    now = written(nodes.withColumns({"lead": F.col("id"), "away": F.lit(0.0), "leads": F.lit(False)}), "balls")
    for t in range(TABLES):
        free = now.filter(F.col("lead") == F.col("id")).withColumn("sign", F.col("signs")[t])
        first = F.struct(~F.col("leads"), F.xxhash64("id"), F.col("id"))
        chosen = free.groupBy("sign").agg(F.min(first)["id"].alias("by"), F.min_by("unit", first).alias("of"), F.count(F.lit(1)).alias("n"))
        met = free.join(chosen.filter("n > 1"), "sign")
        dot = F.aggregate(F.zip_with("unit", "of", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        joins = met.filter("NOT leads AND id <> by").select("id", "by", dot.alias("dot")).filter(F.col("dot") >= near)
        joins = written(joins.select("id", "by", F.acos(F.least("dot", F.lit(1.0))).alias("angle")), "joins")
        if joins.isEmpty():
            continue
        led = joins.groupBy(F.col("by").alias("id")).agg(F.lit(True).alias("led"))
        new = now.join(joins, "id", "left").join(led, "id", "left")
        now = written(
            new.withColumns({"lead": F.coalesce("by", "lead"), "away": F.coalesce("angle", "away"), "leads": F.col("leads") | F.col("led").isNotNull()}).select(now.columns),
            "balls",
        )
    return now


def seeds(reps: DataFrame, n: int, seed: int, tables: int = SEEDS) -> DataFrame:
    """Directed edges (id, nbr, sim) between reps that are next to each other in the orders of
    ``tables`` signatures, ties by one more direction."""
    bits = max(1, min(30, math.ceil(math.log2(max(n, 2) / 32))))

    def places(batches):
        for batch in batches:
            for size, part in _by_size(batch, "unit"):
                u = matrix(part.column("unit"))
                seen = u @ directions(size, (bits + 1) * tables, seed).astype(np.float32)
                seen = seen.reshape(len(u), tables, bits + 1)
                signs = (seen[:, :, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (np.int64(size) << 40)
                for t in range(tables):
                    columns = [pa.array(signs[:, t] * tables + t), pa.array(seen[:, t, bits].astype(np.float64)), part.column("id"), part.column("unit")]
                    yield pa.RecordBatch.from_arrays(columns, ["sign", "along", "id", "unit"])

    def beside(batches):
        for batch in batches:
            for _, part in _by_size(batch, "unit"):
                sign, ids, u = part.column("sign").to_numpy(), part.column("id").to_numpy(), matrix(part.column("unit"))
                for k in range(1, min(BESIDE, len(ids) - 1) + 1):
                    at = np.flatnonzero(sign[k:] == sign[:-k])
                    sim = np.einsum("ij,ij->i", u[at], u[at + k]).astype(np.float64)
                    a, b = np.concatenate([ids[at], ids[at + k]]), np.concatenate([ids[at + k], ids[at]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.tile(sim, 2))], ["id", "nbr", "sim"])

    placed = reps.select("id", "unit").mapInArrow(places, "sign long, along double, id long, unit array<float>")
    return placed.repartition("sign").sortWithinPartitions("sign", "along", "id").mapInArrow(beside, EDGE)


EDGE = "id long, nbr long, sim double"


def _meet(batches):
    """Pairs of the neighbours that meet at a node, of which one is nearer than the worst of the
    other's list; rows (center, part, nbr, unit, floor) come sorted by center and part."""
    rest = None
    for batch in _ended(batches):
        rows = rest if batch is None else batch if rest is None else pa.Table.from_batches([*rest.to_batches(), batch])
        if isinstance(rows, pa.RecordBatch):
            rows = pa.Table.from_batches([rows])
        if rows is None or not rows.num_rows:
            continue
        key = np.stack([rows.column(c).to_numpy() for c in ("center", "part")])
        cut = len(key[0])
        if batch is not None:  # the last group may go on
            cut = int(np.flatnonzero((key == key[:, -1:]).all(axis=0))[0])
            rest = rows.slice(cut)
        if cut:
            for _, part in _by_size(rows.slice(0, cut), "unit"):
                yield from _meetings(part)


def _ended(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _meetings(rows: pa.Table):
    key = np.stack([rows.column(c).to_numpy() for c in ("center", "part")])
    starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
    sizes = np.diff(np.append(starts, rows.num_rows))
    ids, floor, u = rows.column("nbr").to_numpy(), rows.column("floor").to_numpy(), matrix(rows.column("unit"))
    found = []
    for size in np.unique(sizes[sizes > 1]):
        groups = starts[sizes == size]
        for at in range(0, len(groups), max(1, 4_000_000 // (int(size) * (int(size) + u.shape[1])))):
            members = groups[at : at + max(1, 4_000_000 // (int(size) * (int(size) + u.shape[1])))][:, None] + np.arange(size)
            sims = u[members] @ u[members].transpose(0, 2, 1)
            # enters the list of the first of the two
            g, a, b = np.nonzero((sims > floor[members][:, :, None]) & ~np.eye(int(size), dtype=bool))
            found.append((ids[members[g, a]], ids[members[g, b]], sims[g, a, b].astype(np.float64)))
    if not found:
        return
    a, b, sim = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(a):  # neighbours met, and none enters a list
        return
    order = np.lexsort((-sim, b, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (a, b, sim)], ["id", "nbr", "sim"])


def _shortened(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """The nearest of each node's edges, as many as its list has room for."""
    one = edges.repartition("id").groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return one.join(rooms, "id").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("room")).drop("at")


def _lists(edges: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """State of each list: (id, room, floor, full): ``floor`` is what a new entry must exceed; a
    list that is full of possible links has twice the room from now on."""
    radius = reps.select(F.col("id").alias("nbr"), F.col("radius").alias("other"))
    reach = F.col("radius") + F.col("other") + math.acos(similarity) + SLACK
    near = edges.join(radius, "nbr").join(reps.select("id", "radius"), "id").withColumn("links", F.acos(F.least("sim", F.lit(1.0))) <= reach)
    state = near.groupBy("id", "room").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst"), F.every("links").alias("all"))
    full = F.col("n") >= F.col("room")
    wide = full & F.col("all")
    return state.select(
        "id", F.when(wide, F.col("room") * 2).otherwise(F.col("room")).alias("room"),
        F.when(full & ~wide, F.col("worst")).otherwise(F.lit(-2.0)).alias("floor"), wide.alias("wide"),
    )


def descend(edges: DataFrame, reps: DataFrame, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """Refines the lists (id, nbr, sim, room) through neighbours of neighbours until few change
    and none is saturated."""
    for k in range(rounds):
        lists = written(_lists(edges, reps, similarity), "lists")
        two_way = edges.select("id", "nbr", "fresh").unionByName(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "fresh"))
        met = two_way.groupBy("id", "nbr").agg(F.max("fresh").alias("fresh"))
        # a node that is in very many lists is several meeting places
        load = met.groupBy("id").agg(F.count(F.lit(1)).alias("load"), F.max("fresh").alias("news")).filter("news = 1").drop("news")
        places = F.ceil(F.col("load") / (4 * NEAREST)).cast("long")
        part = F.pmod(F.xxhash64("nbr", F.lit(k)), places).alias("part")
        come = met.join(load, "id").select(F.col("id").alias("center"), part, F.col("nbr").alias("id"))
        known = reps.select("id", "unit").join(lists.select("id", "floor"), "id", "left")
        come = come.join(known, "id").select("center", "part", F.col("id").alias("nbr"), "unit", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        better = come.repartition("center", "part").sortWithinPartitions("center", "part").mapInArrow(_meet, EDGE)
        rooms = reps.select("id").join(lists.select("id", "room"), "id", "left").withColumn("room", F.coalesce("room", F.lit(NEAREST)))
        old = edges.select("id", "nbr", "sim", F.lit(0).alias("fresh"))
        edges = written(_shortened(old.unionByName(better.withColumn("fresh", F.lit(1))), rooms), "graph")
        total, fresh = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum("fresh"), F.lit(0))).first()
        if fresh <= STILL * total and lists.filter("wide").isEmpty():
            break
    return edges


def links_of(edges: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b, angle, sure), a < b, between reps some of whose members may be linked; ``sure``
    where all of them must be."""
    pairs = edges.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), "sim")
    pairs = pairs.groupBy("a", "b").agg(F.acos(F.least(F.max("sim"), F.lit(1.0))).alias("angle"))
    both = [reps.select(F.col("id").alias(k), F.col("radius").alias(f"of_{k}")) for k in "ab"]
    spread, limit = F.col("of_a") + F.col("of_b"), math.acos(similarity)
    near = pairs.join(both[0], "a").join(both[1], "b").filter(F.col("angle") <= spread + limit + SLACK)
    return near.select("a", "b", (F.col("angle") + spread <= limit - SLACK).alias("sure"))


def audited(edges: DataFrame, reps: DataFrame, similarity: float, n: int = AUDITED) -> tuple[int, int]:
    """(possible links of ``n`` reps to all reps, by comparing them with all; those in the graph)."""
    asked = reps.select("id", "unit", "radius").orderBy(F.xxhash64("id", F.lit(11))).limit(n).toArrow()
    limit = math.acos(similarity) + SLACK
    parts = {size: (p.column("id").to_numpy(), matrix(p.column("unit")), p.column("radius").to_numpy()) for b in asked.to_batches() for size, p in _by_size(b, "unit")}

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch, "unit"):
                if size not in parts:
                    continue
                ids, u, radius = parts[size]
                own = part.column("id").to_numpy()
                reach = np.cos(np.minimum(radius[:, None] + part.column("radius").to_numpy()[None, :] + limit, math.pi))
                i, j = np.nonzero((u @ matrix(part.column("unit")).T >= reach) & (ids[:, None] != own[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j])], ["id", "nbr"])

    true = reps.select("id", "unit", "radius").mapInArrow(run, "id long, nbr long")
    true = true.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
    found = links_of(edges, reps, similarity).select("a", "b", F.lit(1).alias("found"))
    return tuple(true.join(found, ["a", "b"], "left").agg(F.count(F.lit(1)), F.count("found")).first())


def graph(reps: DataFrame, similarity: float, audits: int = AUDITS) -> DataFrame:
    """The refined neighbour graph, whose recall has passed the audit (or after ``audits`` of them)."""
    n = reps.count()
    rooms = reps.select("id", F.lit(NEAREST).alias("room"))
    first = seeds(reps, n, 1).withColumn("fresh", F.lit(1))
    edges = descend(written(_shortened(first, rooms), "graph"), reps, similarity)
    for k in range(audits):
        true, found = audited(edges, reps, similarity)
        if found >= ENOUGH * true:
            break
        more = seeds(reps, n, 100 + k).withColumn("fresh", F.lit(1))
        wide = rooms.drop("room").join(edges.groupBy("id").agg(F.max("room").alias("room")), "id", "left").withColumn("room", F.coalesce("room", F.lit(NEAREST)))
        both = edges.select("id", "nbr", "sim", F.lit(0).alias("fresh")).unionByName(more)
        edges = descend(written(_shortened(both, wide), "graph"), reps, similarity)
    return edges


def _compared(similarity: float):
    """Counts links between members of two balls: rows (a, b, id, links); rows hold a block of
    each ball."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (units(np.array([m["v"] for m in r[k]])) for k in ("first", "second"))
                hit = x @ y.T >= similarity
                if not hit.any():
                    continue
                out = []
                for side, other, hits in ((r["first"], r["second"], hit), (r["second"], r["first"], hit.T)):
                    n = hits @ np.array([m["weight"] for m in other], np.int64)
                    out += [(m["id"], int(c)) for m, c in zip(side, n, strict=True) if c]
                ids, counts = zip(*out, strict=True)
                columns = [pa.array([r["a"]] * len(out)), pa.array([r["b"]] * len(out)), pa.array(ids), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "id", "links"])

    return run


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    importable(vectors.sparkSession)
    rows = written(usable(vectors), "rows")
    same = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    nodes = written(same.withColumn("id", F.monotonically_increasing_id()), "nodes")
    alone = rows.filter(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    placed = balls(signed(nodes, BITS, TABLES, 7), similarity)
    sums = placed.groupBy("lead").agg(F.max("away").alias("radius"), F.sum("weight").alias("total"), F.min("least").alias("lowest"), F.count(F.lit(1)).alias("members"))
    reps = placed.filter("lead = id").select("id", "unit").join(sums.withColumnRenamed("lead", "id"), "id")
    reps = written(reps, "reps")
    edges = written(links_of(graph(reps, similarity), reps, similarity), "links")
    # balls whose members are all linked with each other
    sure = edges.filter("sure")
    both = sure.select("a", "b").unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = both.join(reps.select(F.col("id").alias("b"), "total"), "b").groupBy(F.col("a").alias("lead")).agg(F.sum("total").alias("whole"))
    # balls whose members must be compared
    open_pairs = edges.filter("NOT sure").select("a", "b")
    asked = open_pairs.select(F.explode(F.array("a", "b")).alias("lead")).distinct()
    member = F.struct("id", "weight", "v")
    blocks = placed.join(asked, "lead").join(sums.select("lead", "members"), "lead").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / MEMBERS).cast("long"))
    ).groupBy("lead", "part").agg(F.collect_list(member).alias("held"))
    blocks = written(blocks, "members")
    meet = open_pairs.join(blocks.select(F.col("lead").alias("a"), F.col("held").alias("first")), "a").join(
        blocks.select(F.col("lead").alias("b"), F.col("held").alias("second")), "b"
    )
    same_length = F.size(F.col("first")[0]["v"]) == F.size(F.col("second")[0]["v"])
    counted = written(meet.filter(same_length).select("a", "b", "first", "second").mapInArrow(_compared(similarity), "a long, b long, id long, links long"), "counted")
    joined = components(sure.select("a", "b").unionByName(counted.select("a", "b").distinct()))
    named = reps.select("id", "lowest").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    of_ball = named.join(lowest, "root").select(F.col("id").alias("lead"), "component_id")
    of_node = counted.groupBy("id").agg(F.sum("links").alias("compared"))
    parts = [sums.select("lead", "total"), whole, of_ball]
    told = reduce(lambda d, p: d.join(p, "lead", "left"), parts, placed.select("id", "v", "lead")).join(of_node, "id", "left")
    links = F.col("total") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("compared", F.lit(0))
    known = rows.filter(F.col("v").isNotNull()).join(told.select("v", links.alias("n_links"), "component_id"), "v")
    out = known.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
