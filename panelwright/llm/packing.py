"""Packing by power-of-two decomposition.

Each document's ids (with the separator id) are cut into pieces of ``MOST`` ids and of the binary
digits of what is left, longest first. Every piece is a sequence of its own, so no sequence
crosses documents and, since every length is a power of two, none is padded. Pieces of equal
length share a bucket; sequence ids of a bucket are one ascending range.

Defined results: a null or empty text is the separator alone (one sequence of length 1); a row
that repeats a document is packed again; an empty table gives no rows; other columns are not
read. The ids do not depend on how the tokenizer's work is cached: a text is cut only at single
spaces between other characters, where the vocabulary's pre-tokenizer always cuts.
"""

from __future__ import annotations

import gc
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tables import give_back, held

MOST = 1024  # ids of the longest sequence; a power of two
SEPARATOR = 0
CACHED = 400_000  # chunks of text a worker process remembers, about; what it met only once goes first
BATCH_TEXT = 1 << 19  # characters that are encoded at once

IDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    return own


@lru_cache(maxsize=1)
def spaced(path: str) -> np.ndarray:
    """Which ids begin with a space (written as U+0120)."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for token, k in vocabulary.items() if token[0] == "\u0120"]] = True
    return out


class Encoder:
    """Ids of many texts; chunks that were seen before are not encoded again. The text is cut at
    single spaces; each chunk but the first stands for itself with the space before it."""

    def __init__(self, path: str, cached: int = CACHED):
        self.path, self.cached = path, cached
        self.known: dict[str, int] = {}  # chunks after a space, or first ones with FIRST before them
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends, self.n = np.zeros(1 << 14, np.int64), 0  # chunk k has the ids from ends[k] to ends[k + 1]
        self.met = np.zeros(1 << 14, np.int64)  # how often chunk k was met; what was met long ago counts less

    def _forget(self) -> None:
        """Keeps the half of the cache that was met most often, in the order it was learnt."""
        stay = np.sort(np.argsort(-self.met[: self.n], kind="stable")[: self.cached // 2])
        stay = stay[self.met[stay] > 1]
        starts, lengths = self.ends[stay], self.ends[stay + 1] - self.ends[stay]
        names, n = list(self.known), len(stay)  # chunk k is the k-th that came
        self.known = dict(zip([names[k] for k in stay.tolist()], range(n), strict=True))
        ends = np.cumsum(lengths)
        self.used = int(lengths.sum())
        self.ids = self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(self.used)]
        self.ends, self.met, self.n = np.append(0, ends), self.met[stay] // 2, n

    def _learn(self, new: list[str]) -> None:
        alone = [c for c in new if c[:1] == FIRST or " " in c]
        ids = [x.ids for x in tokenizer(self.path).encode_batch_fast([c[1:] if c[:1] == FIRST else " " + c for c in alone], add_special_tokens=False)]
        self._keep(alone, np.array(list(chain.from_iterable(ids)), np.uint32), np.array(list(map(len, ids)), np.int64))
        # of a chunk without a space inside, only the first id begins with a space
        rest = [c for c in new if not (c[:1] == FIRST or " " in c)]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            (code,) = tokenizer(self.path).encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(code.ids, np.uint32)
            begins = np.flatnonzero(spaced(self.path)[ids])
            self._keep(part, ids, np.diff(np.append(begins, len(ids))))

    def _keep(self, part: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(part) != len(lengths):
            raise ValueError("the vocabulary does not cut at single spaces")
        self.ids = _room(self.ids, self.used, len(ids))
        self.ends = _room(self.ends, self.n + 1, len(part))
        self.met = _room(self.met, self.n, len(part))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(part)] = self.used + np.cumsum(lengths)
        self.met[self.n : self.n + len(part)] = 0
        self.known.update(zip(part, range(self.n, self.n + len(part)), strict=True))
        self.used, self.n = self.used + len(ids), self.n + len(part)

    def _cut(self, text: str, checked: bool) -> list[str]:
        if FIRST in text:
            return [FIRST + text]
        parts = _CUT.split(text) if checked else text.split(" ")
        parts[0] = FIRST + parts[0]
        return parts

    def _found(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids end."""
        if self.n > self.cached:
            self._forget()
        cut = [self._cut(t, False) for t in texts]
        flat = list(chain.from_iterable(cut))
        at = self._found(flat)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = {flat[k] for k in unknown}
            odd = {c for c in new if _is_odd(c)}
            if odd:  # white space beside a space: those texts are cut where that is safe
                cut = [self._cut(t, True) if not odd.isdisjoint(parts) else parts for t, parts in zip(texts, cut, strict=True)]
                flat = list(chain.from_iterable(cut))
                at = self._found(flat)
                unknown = np.flatnonzero(at < 0)
                new = {flat[k] for k in unknown}
            self._learn(list(new))
            at[unknown] = self._found([flat[k] for k in unknown])
        self.met[: self.n] += np.bincount(at, minlength=self.n)
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        last = np.cumsum([len(parts) for parts in cut])
        return ids, ends[last - 1] if len(ends) else np.zeros(0, np.int64)


FIRST = "\ue000"  # marks a text's first chunk; texts that hold it are not cut


def _is_odd(chunk: str) -> bool:
    body = chunk[1:] if chunk[:1] == FIRST else chunk
    return not body or body[0].isspace() or body[-1].isspace()


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(values):
        return values
    return np.concatenate([values, np.empty(max(len(values), more), values.dtype)])


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """Full pieces, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(path: str, most: int, with_ids: bool):
    def run(batches):
        gc.disable()  # strings and numbers form no cycles; searching them for some costs a fifth of the time
        encoder, counts = held(("encoder", path), lambda: Encoder(path)), np.zeros(most.bit_length(), np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids_of):
                take, size = [], 0
                while at + len(take) < len(ids_of) and size < BATCH_TEXT:
                    take.append(texts[at + len(take)].as_py() or "")
                    size += len(take[-1])
                yield _packed(encoder, ids_of[at : at + len(take)], take, counts, task, most, with_ids)
                at += len(take)
            batch = texts = take = None  # freed before the memory is given back
            pa.default_memory_pool().release_unused()
            give_back()
        gc.enable()

    return run


def _packed(encoder, doc_ids, texts, counts, task, most, with_ids):
    ids, ends = encoder.encode(texts)
    rows, kept, begin = [], [], 0
    for doc_id, end in zip(doc_ids, ends.tolist(), strict=True):
        own = np.append(ids[begin:end], np.uint32(SEPARATOR)).astype("<u4")
        begin, start = end, 0
        for length in piece_lengths(len(own), most):
            piece, bucket = own[start : start + length], length.bit_length() - 1
            # bucket, task and count within the task: unique, and ascending by bucket
            sequence = (bucket << 57) + (task << 33) + int(counts[bucket])
            counts[bucket] += 1
            rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), len(own), sequence, 0, bucket))
            if with_ids:
                kept.append(piece.astype(np.int32))
            start += length
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 7 + [pa.int32()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    if with_ids:
        arrays.append(pa.array(kept, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, path: str, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """One row per piece, which is one sequence; ``with_ids`` adds its ids. Documents are cut
    where they are read: nothing is shuffled."""
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(_pieces(path, most, with_ids), IDS + (", ids array<int>" if with_ids else ""))
