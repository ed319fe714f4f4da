"""Removal of every byte that a repeated 200-byte string covers, by merging Burrows-Wheeler
transforms.

1. Anchors. Every 200-byte window takes the smallest hash of its 64-byte grams (leftmost of equal
   ones) as its anchor; neighbouring windows with the same anchor are one segment, at most 336
   bytes long. Equal windows have equal anchors, so only segments of an anchor that occurs again
   can hold repeated windows; only hashes and places of segments are shuffled.
2. Segments that occur again as a whole are repeated altogether.
3. The other segments meet the distinct segments of their anchor. Their bytes are dealt into
   shards; each shard's suffixes are sorted once and give its Burrows-Wheeler transform and LF
   mapping. The transforms are merged by refining their interleave: a step puts eight more
   symbols in front of every suffix, taken from the transforms alone, and splits the blocks of suffixes
   that agree so far. Suffixes alone in a block are settled and leave. Blocks that are left after
   200 symbols are the repeated intervals: their common prefix is 200 bytes or more.
4. Anchors with more than ``CLASS`` distinct segments would gather in one task; their windows are
   compared by 128-bit hashes instead, which spread over all tasks.

Steps 2 and 4 compare 128-bit hashes, step 3 bytes.

Defined results: null counts as empty; texts under 200 bytes lose nothing; rows that repeat a
document are further places; nulls of ``doc_id`` are kept; an empty table gives no rows; other
columns pass through ``drop_repeated_bytes``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.tables import written

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1  # grams of a window
CHUNK = 2 << 20  # bytes that are hashed at once
CLASS = 4096
MERGED = 1 << 20  # bytes of segments whose transforms are merged at once
SHARDS = 4
END = 0xFF  # no byte of UTF-8; ends every segment

_ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_PLACE = np.uint64((1 << 23) - 1)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Random odd 64-bit numbers, two for every byte."""
    return np.random.default_rng(20).integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root and of its inverse modulo 2^64."""
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(root), np.uint64(pow(root, -1, 2**64))
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    return up, down


class Hashes:
    """Polynomial hashes of all substrings of a byte array."""

    def __init__(self, data: np.ndarray, which: int):
        size = max(CHUNK + LENGTH, len(data))
        up, self.down = _powers(int(_ROOTS[which]), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_codes()[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.down[begin]
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(piece, first window, number of windows, anchor, segment hash) of the segments of the
    pieces of ``data`` that begin at ``starts``."""
    if not (lengths >= LENGTH).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes, other = Hashes(data, 0), Hashes(data, 1)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    least = _sliding_min((grams & ~_PLACE) | at.astype(np.uint64), WINDOW)
    long = lengths >= LENGTH
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + lengths[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge)[: len(least)])
    anchor = (least[windows] & _PLACE).astype(np.int64)
    piece = np.searchsorted(starts, windows, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    first, count = windows[new], np.diff(np.append(new, len(windows)))
    whole = other.of(first, first + count - 1 + LENGTH) + (anchor[new] - first).astype(np.uint64) * _ROOTS[0] + count.astype(np.uint64)
    return piece[new], first - starts[piece[new]], count, grams[anchor[new]], whole


def _pieces(texts: list[bytes]):
    """Chunks of pieces (row, offset, bytes); texts over a chunk are cut so that the windows of
    every place stay whole."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), CHUNK - LENGTH + 1):
            piece = text[offset : offset + CHUNK]
            if size + len(piece) > CHUNK and held:
                yield held
                held, size = [], 0
            held.append((row, offset, piece))
            size += len(piece)
    if held:
        yield held


KEY = "key long, crc long"
SEGMENTS = f"anchor long, segment long, {KEY}, start int, n int"


def _rows_of_segments(batches):
    for batch in batches:
        key, crc = (batch.column(k).to_numpy() for k in range(2))
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        for held in _pieces(texts):
            lengths = np.array([len(p) for *_, p in held], np.int64)
            starts = np.cumsum(lengths) - lengths
            data = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
            piece, first, count, anchor, whole = segments(data, starts, lengths)
            row = np.array([r for r, *_ in held], np.int64)[piece]
            offset = np.array([o for _, o, _ in held], np.int64)[piece]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(key[row]),
                    pa.array(crc[row]),
                    pa.array((first + offset).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["anchor", "segment", "key", "crc", "start", "n"],
            )


def _eight(symbols: np.ndarray, hop) -> np.ndarray:
    """Eight symbols in one number: each one's own, then those that ``hop`` leads to."""
    wide = symbols.astype(np.uint64)
    for k in range(3):
        wide = wide << np.uint64(8 << k) | wide[hop(1 << k)]
    return wide


def shard_transform(strings: list[bytes]):
    """Burrows-Wheeler transform of the strings (each ended), LF mapping, and the text position
    of every sorted suffix. Suffixes are sorted by eight symbols, then by doubling; ties beyond
    256 symbols stay tied."""
    text = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
    n, place = len(text), np.arange(sum(map(len, strings)) + len(strings))
    keys, width = _eight(text, lambda k: (place + k) % n), 8
    while True:
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        if new[-1] == n - 1 or width >= 256:
            break
        rank = np.empty(n, np.int64)
        rank[order] = new
        keys, width = rank * (int(new[-1]) + 1) + np.roll(rank, -width), 2 * width
    row = np.empty(n, np.int64)
    row[order] = place
    return text[order - 1], row[order - 1], order


def repeated_places(shards: list[list[bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For every shard, the text positions (strings joined by one end each) where strings of
    ``length`` (a multiple of eight) start that start elsewhere too."""
    transforms = [shard_transform(s) for s in shards]
    base = np.cumsum([0, *(len(t[0]) for t in transforms)])
    bwt = np.concatenate([t[0] for t in transforms])
    steps = [np.concatenate([t[1] + b for t, b in zip(transforms, base[:-1], strict=True)])]
    for _ in range(3):
        steps.append(steps[-1][steps[-1]])  # LF once, twice, four and eight times
    symbols, jump = _eight(bwt, lambda k: steps[k.bit_length() - 1]), steps[3].astype(np.int32)
    ended = bwt == END
    for k in range(3):
        ended = ended | ended[steps[k]]
    suffix, block = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    for _ in range(length // 8):
        inside = ~ended[suffix]
        suffix, block = suffix[inside], block[inside]
        front = symbols[suffix]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        sizes = np.diff(np.append(starts, len(block)))
        # blocks whose suffixes now differ are put in order; the others stay as they are
        differ = np.logical_or.reduceat(front != np.repeat(front[starts], sizes), starts) if len(starts) else np.zeros(0, bool)
        mixed = np.flatnonzero(np.repeat(differ, sizes))
        if len(mixed):
            order = mixed[np.lexsort((front[mixed], block[mixed]))]
            suffix[mixed], front[mixed] = suffix[order], front[order]
        split = np.ones(len(suffix) + 1, bool)  # where a block begins
        split[1:-1] = (front[1:] != front[:-1]) | (block[1:] != block[:-1])
        shared = ~(split[:-1] & split[1:])
        suffix = jump[suffix[shared]]
        block = np.cumsum(split[:-1][shared], dtype=np.int32)
    out = []
    for b, e, t in zip(base[:-1], base[1:], transforms, strict=True):
        out.append(np.sort(t[2][suffix[(suffix >= b) & (suffix < e)] - b]))
    return out


SPANS = f"{KEY}, start int, stop int"


def _as_spans(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (key, crc, start, stop)."""
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "crc", "start", "stop"])


def _merged(rows: list[dict]) -> pa.RecordBatch:
    """Repeated spans of the segments that occur once."""
    out = []
    shards = [rows[k::SHARDS] for k in range(SHARDS) if rows[k::SHARDS]]
    found = repeated_places([[r["bytes"] for r in s] for s in shards])
    for shard, places in zip(shards, found, strict=True):
        starts = np.cumsum([0, *(len(r["bytes"]) + 1 for r in shard)])
        for row, a, b in zip(shard, np.searchsorted(places, starts[:-1]), np.searchsorted(places, starts[1:]), strict=True):
            if row["times"] == 1 and b > a:
                own = places[a:b] - starts[:-1][np.searchsorted(starts, places[a], "right") - 1] + row["start"]
                cut = np.flatnonzero(np.diff(own) > LENGTH)  # windows that overlap are one span
                begins, ends = own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)] + LENGTH
                out += [(row["key"], row["crc"], int(x), int(y)) for x, y in zip(begins, ends, strict=True)]
    return _as_spans(out)


def _merge_rows(batches):
    """Whole anchors in turn, ``MERGED`` bytes at once; rows are sorted by anchor."""
    held, size, last = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if size >= MERGED and row["anchor"] != last:
                yield _merged(held)
                held, size = [], 0
            held.append(row)
            size += len(row["bytes"])
            last = row["anchor"]
    if held:
        yield _merged(held)


def _windows(batches):
    """(one, two, key, crc, start, times) of every window of the segments."""
    for batch in batches:
        parts = []
        for row in batch.to_pylist():
            data = np.frombuffer(row["bytes"], np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            one, two = (Hashes(data, k).of(at, at + LENGTH).view(np.int64) for k in range(2))
            same = [np.full(len(at), row[c], np.int64) for c in ("key", "crc", "times")]
            parts.append((one, two, same[0], same[1], (at + row["start"]).astype(np.int32), same[2]))
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "key", "crc", "start", "times"])


def _cut_bytes(batches):
    """The bytes of the wanted segments of every text."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = row["text"].encode()
            for w in row["wanted"]:
                stop = w["start"] + w["n"] - 1 + LENGTH
                rows.append((w["anchor"], row["key"], row["crc"], w["start"], w["times"], w["members"], text[w["start"] : stop]))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["anchor", "key", "crc", "start", "times", "members", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, crc, text): a document's place in joins is its id and the checksum of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(document_key(docs["doc_id"]).alias("key"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))


def document_key(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def repeated_spans(docs: DataFrame, texts: DataFrame, limit: int = CLASS) -> DataFrame:
    """(key, crc, spans): the byte ranges of every text that repeated strings cover. ``texts`` are
    the keyed documents."""
    found = written(keyed(docs).mapInArrow(_rows_of_segments, SEGMENTS), "segments")
    again = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "again")
    place = F.struct("key", "crc", "start", "n")
    candidates = written(found.join(again, "anchor"), "candidates")
    distinct = candidates.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("place"))
    distinct = written(distinct, "distinct")
    whole = candidates.join(distinct.filter("times > 1").select("anchor", "segment"), ["anchor", "segment"]).select(
        "key", "crc", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop")
    )
    members = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    wanted = (
        distinct.join(members, "anchor")
        .select("place.key", "place.crc", F.struct("anchor", "place.start", "place.n", "times", "members").alias("w"))
        .groupBy("key", "crc")
        .agg(F.collect_list("w").alias("wanted"))
    )
    cut = "anchor long, key long, crc long, start int, times long, members long, bytes binary"
    parts = written(texts.join(wanted, ["key", "crc"]).select("key", "crc", "text", "wanted").mapInArrow(_cut_bytes, cut), "parts")
    merged = parts.filter(F.col("members") <= limit).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_rows, SPANS)
    windows = "one long, two long, key long, crc long, start int, times long"
    hot = written(parts.filter(F.col("members") > limit).mapInArrow(_windows, windows), "windows")
    equal = hot.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    by_hash = hot.filter("times = 1").join(equal, ["one", "two"]).select("key", "crc", "start", (F.col("start") + LENGTH).alias("stop"))
    return whole.unionByName(merged).unionByName(by_hash).groupBy("key", "crc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def joined_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, runs) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removal_report(docs: DataFrame, limit: int = CLASS) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, digest of the rest."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, runs = row["text"].encode(), joined_spans(row["spans"])
                rest = hashlib.sha256(without(text, runs)).hexdigest()
                out.append((None if row["key"] == -(2**63) else row["key"], len(text), sum(b - a for a, b in runs), len(runs), rest))
            columns = zip(*out, strict=True)
            kinds = (*[pa.int64()] * 4, pa.string())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    texts = keyed(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = texts.join(written(repeated_spans(docs, texts, limit), "spans"), ["key", "crc"], "left")
    return joined.select("key", "text", "spans").mapInArrow(run, schema)


def drop_repeated_bytes(docs: DataFrame, limit: int = CLASS) -> DataFrame:
    """``docs`` with the remaining bytes of every text (characters cut in two become U+FFFD)."""
    spans = written(repeated_spans(docs, keyed(docs), limit), "spans").withColumnsRenamed({"key": "_key", "crc": "_crc", "spans": "_spans"})
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    match = (document_key(docs["doc_id"]) == spans["_key"]) & (F.crc32(text.cast("binary")) == spans["_crc"])
    names, at = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index("text")

    def run(batches):
        for batch in batches:
            kept = [
                t if not s else without(t.encode(), joined_spans(s)).decode(errors="replace")
                for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            ]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [T.StructField(n, T.StringType() if k == at else f.dataType) for k, (n, f) in enumerate(zip(names, docs.schema.fields, strict=True))]
    joined = docs.join(spans, match, "left").select(*docs.columns, "_spans").toDF(*names, "spans")
    return joined.mapInArrow(run, T.StructType(kinds)).toDF(*docs.columns)
