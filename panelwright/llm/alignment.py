"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes. Every token points to its farthest-right overlapping token:
a token of one side to the other side's last token that begins before it ends; where both end at
the same byte, the second side's points to the first side's, which points to itself. Squaring the
pointers (``succ = succ[succ]``, for all tokens of a block of documents at once) brings every
token to the terminal token of its component within a logarithmic number of steps; tokens with
the same terminal are a group.

A block of documents is one task's step. Its links are counted as pairs of ids; the pairs' counts
are summed over all blocks by Spark, and come back to each block, so a pair travels once a block
however often it occurs, and no pair or document is hot.

Texts are cut at single spaces between other characters before they are encoded: both
vocabularies always cut there (the second one's pieces are looked through for that), so a piece
of text that was met before is not encoded again.

Defined results: a text that is null or empty, or whose joined token bytes differ from a space
and the text, has no tokens: zeros, and an empty column of groups; a repeated row is counted
again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.packing import tokenizer
from panelwright.llm.tables import held, written

BLOCK = 1 << 20  # characters of text whose tokens are aligned at once
CACHED = 400_000  # pieces of text a worker process remembers
_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def byte_level() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 characters
    are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=1)
def first_bytes(path: str) -> list[bytes]:
    """Bytes of every id of the byte-level vocabulary."""
    vocabulary, of = tokenizer(path).get_vocab(), byte_level()
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        out[k] = bytes(of[c] for c in entry)
    return out


@lru_cache(maxsize=1)
def pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=1)
def second_bytes(path: str) -> list[bytes]:
    """Bytes of every id of the piece vocabulary: U+2581 is a space, <0xHH> one byte."""
    own = pieces(path)
    entries = [own.id_to_piece(k) for k in range(own.get_piece_size())]
    return [
        bytes([int(e[3:5], 16)]) if own.is_byte(k) else e.replace("▁", " ").encode() for k, e in enumerate(entries)
    ]


@lru_cache(maxsize=1)
def cuts_at_spaces(path: str) -> bool:
    """Whether no piece holds a space behind another character."""
    own = pieces(path)
    return not any(re.search("[^▁]▁", own.id_to_piece(k)) for k in range(own.get_piece_size()))


@dataclass
class Side:
    """Ids of all pieces of text met so far, one after another; piece k has those from ends[k] on."""

    spelt: list[bytes]  # of every id
    sizes: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    used: int = 0

    @staticmethod
    def of(spelt: list[bytes]) -> Side:
        return Side(spelt, np.array(list(map(len, spelt)), np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64))

    def keep(self, n: int, found: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(found) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(found)] = self.used + np.cumsum(lengths)
        self.used += len(flat)

    def of_pieces(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of those pieces, and how many each has."""
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.repeat(starts - (upto - lengths), lengths) + np.arange(total)], lengths


class Encoder:
    """Ids of both vocabularies for many texts; pieces of text met before are not encoded again."""

    def __init__(self, first: str, second: str, cached: int = CACHED):
        self.paths, self.cached = (first, second), cached
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sides = [Side.of(first_bytes(self.paths[0])), Side.of(second_bytes(self.paths[1]))]
        self.same = np.zeros(1 << 14, bool)  # whether the bytes of both are a space and the piece

    def _learn(self, new: list[str]) -> None:
        n = len(self.known)
        ids = (
            [x.ids for x in tokenizer(self.paths[0]).encode_batch_fast([" " + t for t in new], add_special_tokens=False)],
            pieces(self.paths[1]).encode(new, num_threads=1),
        )
        for side, found in zip(self.sides, ids, strict=True):
            side.keep(n, found)
        while n + len(new) > len(self.same):
            self.same = np.concatenate([self.same, np.zeros_like(self.same)])
        whole = [(" " + t).encode() for t in new]
        a, b = ([b"".join([side.spelt[k] for k in f]) for f in found] for side, found in zip(self.sides, ids, strict=True))
        self.same[n : n + len(new)] = [x == y == z for x, y, z in zip(a, b, whole, strict=True)]
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def _cut(self, text: str) -> list[str]:
        if not cuts_at_spaces(self.paths[1]):
            return [text]
        parts = text.split(" ")
        return parts if all(parts) and not any(p[0].isspace() or p[-1].isspace() for p in parts) else _CUT.split(text)

    def encode(self, texts: list[str]):
        """(document, ids, bytes) of the tokens of each side; documents without tokens have none."""
        if len(self.known) > self.cached:
            self._forget()
        cut = [self._cut(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            self._learn(list({flat[k]: None for k in unknown}))
            at[unknown] = np.fromiter(map(self.known.__getitem__, (flat[k] for k in unknown)), np.int64, len(unknown))
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.same[at]]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        out = []
        for side in self.sides:
            ids, lengths = side.of_pieces(at)
            out.append((np.repeat(doc, lengths), ids, side.sizes[ids]))
        return out


def groups(ends_a: np.ndarray, ends_b: np.ndarray):
    """Number of the group of every token of both sides, from the bytes where they end (both sides
    end at the same last byte), and the linked pairs of tokens.

    Every token points to its farthest-right overlapping token; the pointers are squared until
    they stand still at each component's terminal token."""
    na, nb = len(ends_a), len(ends_b)
    if not na:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    last = int(ends_a[-1])
    marks_a, marks_b = np.zeros(last + 1, bool), np.zeros(last + 1, bool)
    marks_a[ends_a], marks_b[ends_b] = True, True
    # both sides' cuts divide the bytes into stretches, each within one token of either side
    stretch = np.flatnonzero(marks_a | marks_b)
    at_a, at_b = marks_a[stretch], marks_b[stretch]
    of_a, of_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
    # tokens of the first side are 0 .. na - 1, of the second na .. na + nb - 1
    succ = np.empty(na + nb, np.int64)
    closes = np.flatnonzero(at_a)
    succ[:na] = np.where(at_b[closes], np.arange(na), na + of_b[closes])
    succ[na:] = of_a[np.flatnonzero(at_b)]
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            break
        succ = further
    number = np.cumsum(succ[:na] == np.arange(na)) - 1  # of the terminal tokens
    label = number[succ]
    return label[:na], label[na:], of_a, of_b


@lru_cache(maxsize=1)
def _spelt(n: int) -> list[np.ndarray]:
    """Every id in decimal, with what follows it inside a group and at the end of either side."""
    return [np.array([f"{k}{end}" for k in range(n)], object) for end in ",|;"]


def _written(group_a, ids_a, group_b, ids_b, size: int) -> np.ndarray:
    """The groups as words 'a1,', 'a2|', 'b1,', 'b2;' in their order."""
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    n = int(group_a[-1]) + 1
    of_a, of_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b)
    out = np.empty(len(ids_a) + len(ids_b), object)
    place = np.arange(len(ids_a)) + (before_b - of_b)[group_a]
    inner, last_of_a, last_of_b = _spelt(size)
    out[place] = np.where(last_a, last_of_a[ids_a], inner[ids_a])
    place = np.arange(len(ids_b)) + (before_a + of_a)[group_b]
    out[place] = np.where(last_b, last_of_b[ids_b], inner[ids_b])
    return out


ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {groups}"
    "links array<int>, pairs array<long>, times array<long>"
)


def _label(paths, with_groups: bool):
    def run(batches):
        encoder = held(("both", paths), lambda: Encoder(*paths))
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                take, size = [], 0
                while at + len(take) < len(ids) and size < BLOCK:
                    take.append(texts[at + len(take)].as_py())
                    size += len(take[-1] or "")
                yield _block(encoder, (task << 33) + count, ids[at : at + len(take)], take, with_groups)
                count += 1
                at += len(take)

    return run


def _block(encoder: Encoder, block: int, doc_ids, texts, with_groups: bool) -> pa.RecordBatch:
    """One row per document, with its links as places in the block's pairs; the first row also
    has the pairs and how often each is linked in the block."""
    (doc_a, ids_a, sizes_a), (doc_b, ids_b, sizes_b) = encoder.encode(texts)
    group_a, group_b, of_a, of_b = groups(np.cumsum(sizes_a), np.cumsum(sizes_b))
    n = len(texts)
    width = len(encoder.sides[1].spelt)
    pairs, links, times = np.unique(ids_a[of_a].astype(np.int64) * width + ids_b[of_b], return_inverse=True, return_counts=True)
    n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
    n_links = np.bincount(doc_a[of_a], minlength=n)
    opens = np.flatnonzero(np.diff(group_a, prepend=-1)) if len(group_a) else np.zeros(0, np.int64)
    n_groups = np.bincount(doc_a[opens], minlength=n)
    spelt, sums, at = [], [], 0
    words = _written(group_a, ids_a, group_b, ids_b, max(len(s.spelt) for s in encoder.sides)).tolist() if len(ids_a) else []
    for size in (n_a + n_b).tolist():
        text = "".join(words[at : at + size])[:-1]
        sums.append(hashlib.sha256(text.encode()).hexdigest() if size else "")
        spelt.append(text)
        at += size
    columns = {
        "block": pa.array(np.full(n, block)),
        "doc_id": pa.array(doc_ids, pa.int64()),
        **{k: pa.array(v.astype(np.int64)) for k, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))},
        "groups_sha256": pa.array(sums, pa.string()),
        **({"groups": pa.array(spelt, pa.string())} if with_groups else {}),
        "links": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_links)).astype(np.int32)), pa.array(links.astype(np.int32))),
        "pairs": pa.array([pairs] + [None] * (n - 1), pa.list_(pa.int64())),
        "times": pa.array([times] + [None] * (n - 1), pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


SUMS = "n_best long, count_sum long"


def _scored(kept: list[str]):
    """Sums the counts of a block's pairs over each document's links."""

    def run(key, docs: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("place")
        value = np.stack([counts.column("best").to_numpy().astype(np.int64), counts.column("count").to_numpy()])
        links = docs.column("links").combine_chunks()
        lengths = np.diff(links.offsets.to_numpy())
        sums = np.zeros((2, docs.num_rows), np.int64)
        some = np.flatnonzero(lengths)
        if len(some):
            flat = links.flatten().to_numpy()
            starts = (np.cumsum(lengths) - lengths)[some]
            sums[:, some] = np.add.reduceat(value[:, flat], starts, axis=1)
        out = docs.select(kept)
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    return run


def align(docs: DataFrame, first: str, second: str, with_groups: bool = False) -> DataFrame:
    """One row per document: numbers of tokens of both vocabularies, of groups and links, the
    links whose pair is the most frequent one of its second id, and the sum of their pairs'
    counts; ``with_groups`` adds the groups themselves."""
    width = len(second_bytes(second))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ALIGNED.format(groups="groups string, " if with_groups else "")
    aligned = written(thin.mapInArrow(_label((first, second), with_groups), schema), "aligned")
    per_block = aligned.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "pair"))
    per_block = per_block.select("block", "place", F.col("pair.pairs").alias("pair"), F.col("pair.times").alias("times"))
    counts = per_block.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("second", F.col("pair") % width)
    highest = counts.groupBy("second").agg(F.max("count").alias("highest"))
    valued = written(counts.join(highest, "second").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair_counts")
    back = per_block.join(valued, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    kept = [c for c in aligned.columns if c not in ("block", "links", "pairs", "times")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(*kept).schema.fields)
    rows = aligned.drop("pairs", "times")
    scored = rows.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_scored(kept), f"{out}, {SUMS}")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
