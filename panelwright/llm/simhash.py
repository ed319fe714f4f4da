"""Near duplicates by SimHash and the generalised pigeonhole principle.

A fingerprint bit is set if more than half of the shingle hashes have it. Fingerprints within
``radius`` bits are found without comparing all pairs: correlated bits are grouped into parts,
and every part gets a threshold of its own (skipped, equal, two or four bits) such that the thresholds
plus one add up to ``radius + 1``; two fingerprints within the radius then agree on one part up to
its threshold. Dynamic programming chooses parts and thresholds by the estimated numbers of
candidates and probes, from bit counts over all fingerprints. Equal parts meet by their value; two
(four) bits apart meet because each side is entered under its one-bit (two-bit) neighbours too. Within a
bucket all pairs are verified, and only edges that span the linked rows are returned. Large
buckets are divided into blocks, each pair of blocks being a task's work.

Defined results: a null text or one without words has fingerprint 0; fewer words than a shingle
are one shingle; repeated rows share a fingerprint; null ``doc_id`` are last in order; an empty
table gives no rows; other columns pass through ``drop_near_copies``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tables import components, held, written

BITS = 64
SEED = 42
BLOCK = 4096  # rows of a bucket that one task compares with as many others
FEW = 256  # rows of a bucket up to which it is compared together with others
HASHED_AT_ONCE = 1 << 18
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space bytes, with A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words; of all words if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHED_AT_ONCE):
        part = hashes[at : at + HASHED_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Further hashes of the same shingles (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprints(docs: DataFrame, width: int, checks: int = 0, check_width: int = 5) -> DataFrame:
    """(doc_id, text_hash, fp, checks, set_hash, probes): the fingerprint of ``width``-word shingles,
    as a signed 64-bit number. With ``checks``, that many further ones of ``check_width``-word
    shingles, a hash of their set, and ``PROBES`` independent ones of ``width``-word shingles (the
    first is ``fp``); all fingerprints are then taken over distinct shingles."""

    def run(batches):
        held(None, dict)  # what earlier stages kept in this process is not needed
        for batch in batches:
            fps, more, sets, probes = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                narrow = shingle_hashes(words, width)
                if checks:
                    narrow, wide = np.unique(narrow), np.unique(shingle_hashes(words, check_width))
                    more.append([_signed(majority(_mixed(wide, k))) for k in range(checks)])
                    sets.append(_signed(xxhash.xxh3_64_intdigest(wide.tobytes())))
                else:
                    more.append([])
                    sets.append(0)
                fps.append(_signed(majority(narrow)))
                probes.append([fps[-1], *(_signed(majority(_mixed(narrow, k))) for k in range(1, PROBES))] if checks else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(more, pa.list_(pa.int64())), pa.array(sets, pa.int64()), pa.array(probes, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "fp", "checks", "set_hash", "probes"],
            )

    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    return thin.mapInArrow(run, "doc_id long, text_hash long, fp long, checks array<long>, set_hash long, probes array<long>")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them two bits are both set (64 x 64)."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = as_bits(batch.column(0).to_numpy()).astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        rows = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows)], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def as_bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, column b being bit b."""
    return np.unpackbits(fps.astype(np.int64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; bits that go together share a group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    together = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(together, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (together[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (together[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def agreement(p: np.ndarray, bits: list[int]) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, 2, ... of these bits."""
    out = np.array([1.0])
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        out = np.append(out * (1 - differ), 0) + np.append(0, out * differ)
    return out


def allocate(both: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe: of all numbers of parts, the thresholds with the
    least estimated cost in rows to shuffle and pairs to verify."""
    p = np.diag(both) / max(n, 1)
    best = (math.inf, [])
    for parts in range(1, radius + 2):
        groups = grouped_bits(both, n, parts)
        state: dict[int, tuple[float, list]] = {0: (0.0, [])}  # thresholds plus one so far -> cost, choice
        for group in groups:
            chance = np.cumsum(agreement(p, group))
            cost = {-1: 0.0}
            for t in (0, 2, 4):
                cost[t] = ENTRY * n * len(flips(group, t)) + PAIR * n * n / 2 * chance[min(t, len(group))]
            after: dict[int, tuple[float, list]] = {}
            for got, (spent, choice) in state.items():
                for t, c in cost.items():
                    key = min(radius + 1, got + t + 1)
                    if key not in after or spent + c < after[key][0]:
                        after[key] = (spent + c, [*choice, (group, t)])
            state = after
        if radius + 1 in state and state[radius + 1][0] < best[0]:
            best = state[radius + 1]
    return [(group, t) for group, t in best[1] if t >= 0]


#: Relative costs of a row in a shuffle and of a pair compared in memory.
ENTRY, PAIR = 1.0, 0.02


def flips(bits: list[int], threshold: int) -> list[int]:
    """What to change in a part's value so that two values within the threshold share an entry:
    each side is entered under all values within half of it."""
    single = [1 << b for b in bits]
    double = [x | y for k, x in enumerate(single) for y in single[:k]] if threshold == 4 else []
    return [0, *(single if threshold else []), *double]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def entries(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (bucket, fp, checks, id): each node under the values of its parts."""
    each = F.array(
        *[
            F.xxhash64(F.lit(k), F.col("fp").bitwiseXOR(F.lit(_signed(flip))).bitwiseAND(F.lit(_mask(bits))))
            for k, (bits, t) in enumerate(parts)
            for flip in flips(bits, t)
        ]
    )
    return nodes.select(F.explode(each).alias("bucket"), "fp", "checks", "id")


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds the task's key ``part``: the bucket, for large buckets with a pair of blocks."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = written(counts.select("bucket", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "large")
    if large.isEmpty():
        return rows.withColumn("part", F.col("bucket"))
    known = rows.join(large, "bucket", "left")
    own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)).cast("long"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1))
    paired = known.withColumn("own", own).withColumn("partner", partner)
    key = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(
        F.xxhash64("bucket", F.least("own", "partner"), F.greatest("own", "partner"))
    )
    return paired.withColumn("part", key)


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n rows reaches over the edges (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after


@dataclass
class Rows:
    """Rows of whole parts, sorted by part."""

    part: np.ndarray
    fp: np.ndarray
    ids: np.ndarray
    checks: np.ndarray


def _close(rows: Rows, i, j, radius, angle):
    """The pairs within the radius and the angle."""
    near = np.bitwise_count(rows.fp[i] ^ rows.fp[j]) <= radius
    i, j = i[near], j[near]
    if angle is not None:
        sure = np.bitwise_count(rows.checks[i] ^ rows.checks[j]).sum(axis=1) <= angle * BITS * rows.checks.shape[1]
        i, j = i[sure], j[sure]
    return i, j


def close_pairs(rows: Rows, radius, angle, few: int):
    """In portions: pairs of rows (i < j) of a part that are close; parts of up to ``few`` rows are
    compared together."""
    n = len(rows.part)
    starts = np.flatnonzero(np.concatenate([[True], rows.part[1:] != rows.part[:-1]]))
    size = np.diff(np.append(starts, n))
    last = np.repeat(starts + size, size)
    alive, step = np.flatnonzero(np.repeat(size <= few, size)), 1
    while len(alive):
        alive = alive[alive + step < last[alive]]
        yield _close(rows, alive, alive + step, radius, angle)
        step += 1
    for begin, count in zip(starts[size > few].tolist(), size[size > few].tolist(), strict=True):
        own = np.arange(begin, begin + count)
        for at in range(0, count, 256):
            i, j = np.nonzero(np.bitwise_count(rows.fp[own[at : at + 256], None] ^ rows.fp[None, own[at:]]) <= radius)
            i, j = own[at + i], own[at + j]
            less = i < j
            yield _close(rows, i[less], j[less], radius, angle)


def tree(rows: Rows, radius, angle, few):
    """Edges that span what the close pairs connect."""
    n = len(rows.part)
    us, vs, held = [np.arange(0)], [np.arange(0)], 0
    for i, j in close_pairs(rows, radius, angle, few):
        us.append(i)
        vs.append(j)
        held += len(i)
        if held > 2_000_000:  # edges of dense parts shrink to a tree
            label = spanning(np.concatenate(us), np.concatenate(vs), n)
            rest = np.flatnonzero(label != np.arange(n))
            us, vs, held = [rest], [label[rest]], len(rest)
    label = spanning(np.concatenate(us), np.concatenate(vs), n)
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


EDGES = "a long, b long"


def _edges(radius, angle, few):
    """Edges between ids that span the close rows (part, fp, id, checks) of whole parts, which come
    sorted by part."""

    def column(values, n):
        if pa.types.is_list(values.type):
            return values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return values.to_numpy(zero_copy_only=False)

    def run(batches):
        rest = None
        for batch in _ended(batches):
            if batch is not None:
                new = [column(c, batch.num_rows) for c in batch.columns]
                rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last part may go on
                rest, rows = [x[cut:] for x in rows], [x[:cut] for x in rows]
            else:
                rows, rest = rest, None
            if rows is None or not len(rows[0]):
                continue
            part, fp, ids, checks = rows
            i, j = tree(Rows(part, fp.view(np.uint64), ids, checks.view(np.uint64)), radius, angle, few)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    return run


def links(rows: DataFrame, radius: int, angle: float | None = None, few: int = FEW) -> DataFrame:
    """Edges (a, b) between the ids of close rows, which span what is close in each part."""
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_edges(radius, angle, few), EDGES)


def forest(batches):
    """Of the edges (a, b) of a task those that span them: each node is linked with the smallest one
    it reaches, so that a group costs its rows in every task, however many parts it shares."""
    kept, size = [], 0
    for batch in _ended(batches):
        if batch is not None:
            kept.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
        if kept and (batch is None or size > 2_000_000):
            ids, at = np.unique(np.concatenate(kept, axis=1), return_inverse=True)
            label = spanning(*at.reshape(2, -1), len(ids))
            rest = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[label[rest]])], ["a", "b"])
            kept, size = [], 0


def bucketed(nodes: DataFrame, radius: int, block: int) -> DataFrame:
    """Rows (part, fp, id, checks) of the buckets that ``radius`` needs."""
    n, both = bit_counts(nodes)
    return dealt(entries(nodes, allocate(both, n, radius)), block).select("part", "fp", "id", "checks")


def _ended(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def numbered_prints(prints: DataFrame) -> DataFrame:
    """One row per fingerprint and shingle set: id, smallest ``doc_id``, the hash of one of its texts."""
    one = [F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("probes").alias("probes")]
    sums = prints.groupBy("fp", "checks", "set_hash").agg(*one)
    return written(sums.withColumn("id", F.monotonically_increasing_id()), "nodes")


def with_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component over ``edges`` and its smallest ``doc_id``."""
    found = components(edges)
    member = nodes.join(found, nodes["id"] == found["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(member.join(least, "root"), "members")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per document: fingerprint and the smallest ``doc_id`` it is linked to."""
    prints = written(fingerprints(docs, width), "prints")
    nodes = numbered_prints(prints)
    if nodes.isEmpty():
        found = nodes.select("fp", F.col("least").alias("component_id"))
    else:
        found = with_component(nodes, links(bucketed(nodes, radius, block), radius))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(found.select("fp", "component_id"), "fp").select("doc_id", text, "component_id")


#: The stage's candidates: fingerprints of word pairs, of which an edit touches two instead of five.
CANDIDATE_WIDTH, CANDIDATE_RADIUS = 2, 11
SHINGLE, SIMILARITY, CHECKS, FIRST = 5, 0.8, 16, 2
#: Candidates are near in one of so many independent fingerprints: one alone loses a fifth of the
#: pairs near the threshold that differ by a block or an end.
PROBES = 3
SIGMAS, SURE_SIGMAS = 2.0, 4.0  # of the further fingerprints' bits, in buckets and before sets are compared
SHINGLES = 1 << 19  # of a candidate group that one task compares with as many others


def similar_angle(similarity: float, bits: int, sigmas: float) -> float:
    """Share of differing bits up to which two shingle sets may be similar: what is expected of
    equally large sets with this Jaccard similarity, and some standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return share + sigmas * math.sqrt(share * (1 - share) / bits)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(text_hash, shingles) of the texts whose hashes are wanted."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(words_of(t.as_py()), width)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    own = texts.join(wanted.hint("shuffle_hash"), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    return own.mapInArrow(run, "text_hash long, shingles array<long>")


def grouped_sets(nodes: DataFrame, candidates: DataFrame, docs: DataFrame, width: int, block: int, shingles: int) -> DataFrame:
    """Rows (root, low, high, own, id, checks, shingles) of the nodes that candidates connect, once
    for each task that compares them: a group that is large, in rows or shingles, is divided into
    blocks, and two of them (low, high) meet in a task."""
    group = components(candidates).withColumnRenamed("node", "id")
    named = written(nodes.select("id", "text_hash", "checks").join(group, "id"), "candidates")
    sets = named.join(shingle_sets(docs, named.select("text_hash"), width), "text_hash")
    sets = written(sets.select("id", "root", "checks", "shingles"), "sets")
    parts = F.ceil(F.greatest(F.sum(F.size("shingles")) / shingles, F.count(F.lit(1)) / block)).cast("long")
    known = sets.join(sets.groupBy("root").agg(parts.alias("blocks")), "root").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    paired = known.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return paired.select("root", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"), "own", "id", "checks", "shingles")


def _groups(batches):
    """Tables of the rows that share the first three columns, by which they are sorted."""
    key, kept = None, []
    for batch in batches:
        keys = np.stack([c.to_numpy() for c in batch.columns[:3]])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else []
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if kept and tuple(keys[:, at]) != key:
                yield pa.Table.from_batches(kept)
                kept = []
            key = tuple(keys[:, at])
            kept.append(batch.slice(at, end - at))
    if kept:
        yield pa.Table.from_batches(kept)


def alike(own, checks, sizes, flat, similarity: float, angle: float) -> np.ndarray:
    """The smallest row that each row reaches over pairs whose sets (``sizes`` of the values
    ``flat``) have that Jaccard similarity; of two blocks, rows of different ones are compared."""
    n, ends = len(sizes), np.cumsum(sizes)
    values, flat = np.unique(flat, return_inverse=True)
    mark, label, two = np.zeros(len(values), bool), np.arange(n), (own != own[0]).any()
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if two:
            j = j[own[j] != own[i]]
        j = j[np.minimum(sizes[j], sizes[i]) >= np.maximum(similarity * np.maximum(sizes[j], sizes[i]), 1)]
        j = j[np.bitwise_count(checks[i] ^ checks[j]).sum(axis=1) <= angle * BITS * checks.shape[1]]
        if not len(j):
            continue
        first = np.cumsum(sizes[j]) - sizes[j]
        own_values = flat[ends[i] - sizes[i] : ends[i]]
        mark[own_values] = True
        met = mark[flat[np.repeat(ends[j] - sizes[j] - first, sizes[j]) + np.arange(sizes[j].sum())]]
        both = np.add.reduceat(met.astype(np.int64), first)
        mark[own_values] = False
        hit = label[j[both >= similarity * (sizes[i] + sizes[j] - both)]]
        if len(hit):
            hit = np.unique(np.append(hit, label[i]))
            label[np.isin(label, hit)] = hit[0]
    return label


def verified(rows: DataFrame, similarity: float, angle: float) -> DataFrame:
    """Edges (a, b) that span the rows of ``grouped_sets`` whose shingle sets are similar."""

    def run(batches):
        for group in _groups(batches):
            own, ids = (group.column(c).to_numpy() for c in ("own", "id"))
            checks, sets = (group.column(c).combine_chunks() for c in ("checks", "shingles"))
            bits = checks.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            sizes = pc.list_value_length(sets).to_numpy().astype(np.int64)
            label = alike(own, bits, sizes, sets.flatten().to_numpy(), similarity, angle)
            rest = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[label[rest]])], ["a", "b"])

    key = ("root", "low", "high")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, EDGES)


def drop_near_copies(
    docs: DataFrame, similarity: float = SIMILARITY, radius: int = CANDIDATE_RADIUS, few: int = FEW, block: int = BLOCK, shingles: int = SHINGLES
) -> DataFrame:
    """One document of each group of near copies stays, with the columns of ``docs``: documents
    are linked if their sets of five-word shingles have ``similarity`` or more. Candidates are
    within ``radius`` bits in one of ``PROBES`` fingerprints of word pairs, if their further
    fingerprints (of the shingles) allow it. Edges that span them give groups; each row goes to its
    group, where the shingle sets of all rows that are not linked yet are compared, if 1024 further
    bits allow it. Only documents with the same set are one node from the start. The smallest
    ``doc_id`` of a group stays, with all rows of that ``doc_id`` in the group."""
    prints = written(fingerprints(docs, CANDIDATE_WIDTH, CHECKS, SHINGLE), "prints")
    nodes = numbered_prints(prints)
    if nodes.isEmpty():
        return docs
    short = nodes.withColumn("checks", F.slice("checks", 1, FIRST))
    probes = [bucketed(short.withColumn("fp", F.col("probes")[k]), radius, block) for k in range(PROBES)]
    angle = similar_angle(similarity, FIRST * BITS, SIGMAS)
    asked = [written(links(rows, radius, angle, few).mapInArrow(forest, EDGES), "asked") for rows in probes]
    sets = grouped_sets(nodes, reduce(DataFrame.unionByName, asked), docs, SHINGLE, block, shingles)
    edges = verified(sets, similarity, similar_angle(similarity, CHECKS * BITS, SURE_SIGMAS))
    found = with_component(nodes, edges)
    same = [prints[c] == found[c] for c in ("fp", "checks", "set_hash")]
    lost = prints.join(found, same).filter(~prints["doc_id"].eqNullSafe(F.col("component_id")))
    gone = lost.select(prints["doc_id"].alias("_lost"), prints["text_hash"]).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(gone["_lost"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone.hint("shuffle_hash"), match, "left_anti")
