"""Exact duplicates through cuckoo-filter indexes of live digests.

A text's digest is the SHA-256 of its characters without white space. Each task keeps a
``CuckooIndex`` of the digests it has seen: a fingerprint hit is verified against the digest
stored in the same slot, a better copy replaces the stored one (delete, insert), an overflowing
table is built anew at twice the size from the stored keys. A first pass indexes every input
partition, so that at most one row per digest and partition is shuffled however often a text
repeats; a second pass merges the rows of each digest.

Defined results: a null text counts as empty, empty texts are equal; of equal texts the one with
the most code points stays, then the smallest ``doc_id`` (null last), then one row of those that
agree in both; an empty table gives no rows; other columns pass through ``drop_copies``.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.tables import fresh, written

SLOTS = 4
KICKS = 200
LAST = 2**63 - 1  # where a null doc_id stands


class CuckooIndex:
    """Set of byte keys with values; every key sits in one of two buckets of four slots."""

    def __init__(self, buckets: int = 64):
        self._build(buckets)

    def _build(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * SLOTS * buckets))  # 0: free slot
        self.content: list = [None] * (SLOTS * buckets)
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, *buckets = self._places(key)
        for bucket in buckets:
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[at] == mark and self.content[at][0] == key:  # a hit counts once its content agrees
                    return at
        return -1

    def get(self, key: bytes):
        at = self._slot(key)
        return None if at < 0 else self.content[at][1]

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at < 0:
            return False
        self.marks[at], self.content[at] = 0, None
        self.size -= 1
        return True

    def insert(self, key: bytes, value) -> None:
        """Adds a key that is not in the index."""
        left = self._put((key, value))
        if left is None:
            return
        stored, buckets = [left, *self.items()], self.mask + 1
        while True:
            buckets *= 2
            self._build(buckets)
            if all(self._put(x) is None for x in stored):
                return

    def _put(self, item):
        mark, first, second = self._places(item[0])
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[at]:
                    self.marks[at], self.content[at] = mark, item
                    self.size += 1
                    return None
        bucket = second
        for turn in range(KICKS):
            at = bucket * SLOTS + turn % SLOTS
            mark, self.marks[at] = self.marks[at], mark
            item, self.content[at] = self.content[at], item
            bucket = self._other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[at]:
                    self.marks[at], self.content[at] = mark, item
                    self.size += 1
                    return None
        return item

    def items(self):
        return (x for x in self.content if x is not None)


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def _offer(index: CuckooIndex, key: bytes, rank: tuple, n: int, row: int | None, ties: int) -> None:
    """Counts a live digest; of two copies the better one stays in the index."""
    held = index.get(key)
    if held is not None:
        index.delete(key)
        best, count, at, equal = held
        if rank == best:
            equal, at = equal + ties, min(at, row)
        elif rank < best:
            best, at, equal = rank, row, ties
        index.insert(key, (best, count + n, at, equal))
    else:
        index.insert(key, (rank, n, row, ties))


BEST = "digest string, length long, keep_id long, group_size long, row long, ties long"


def _indexed(batches):
    """Rows of BEST, one per digest of the partition."""
    index = CuckooIndex()
    for batch in batches:
        for key, length, doc_id, n, row, ties in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rank = (-length, doc_id is None, LAST if doc_id is None else doc_id)
            _offer(index, bytes.fromhex(key), rank, n, row, ties)
    out, step = list(index.items()), 50_000
    for at in range(0, len(out), step):
        part = out[at : at + step]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k.hex() for k, _ in part]),
                pa.array([-v[0][0] for _, v in part], pa.int64()),
                pa.array([None if v[0][1] else v[0][2] for _, v in part], pa.int64()),
                pa.array([v[1] for _, v in part], pa.int64()),
                pa.array([v[2] for _, v in part], pa.int64()),
                pa.array([v[3] for _, v in part], pa.int64()),
            ],
            ["digest", "length", "keep_id", "group_size", "row", "ties"],
        )


def live_digests(rows: DataFrame) -> DataFrame:
    """One row per digest of ``rows`` (digest, length, doc_id, row): the best copy, how many
    rows share the digest and how many equal the best copy in length and ``doc_id``."""
    one = F.lit(1).cast("long")
    first = rows.select("digest", "length", "doc_id", one.alias("n"), "row", one.alias("ties"))
    partial = first.mapInArrow(_indexed, BEST)
    return partial.repartition("digest").mapInArrow(_indexed, BEST)


def digests(docs: DataFrame) -> DataFrame:
    """Thin table (doc_id, digest, length, row) with a number for each row."""
    text = F.coalesce("text", F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(F.col("text")).alias("digest"),
        F.length(text).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(thin, "digests")


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row per document: which row stays for it."""
    thin = digests(docs)
    best = written(live_digests(thin), "live").select("digest", "keep_id", "group_size", F.col("row").alias("_row"))
    return thin.join(best, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    best = written(live_digests(digests(docs)).filter("group_size > 1"), "live")
    key, mark = fresh(docs, "_digest"), fresh(docs, "_best")
    own = best.select(F.col("digest").alias(key), F.struct("length", "keep_id", "ties").alias(mark))
    # one shuffle of the documents at every size; Spark splits the hot digests
    keyed = docs.withColumn(key, digest(F.col("text"))).join(own.hint("shuffle_hash"), key, "left")
    held = F.col(mark)
    stays = held.isNull() | (
        (F.length(F.coalesce("text", F.lit(""))) == held["length"]) & docs["doc_id"].cast("long").eqNullSafe(held["keep_id"])
    )
    left = keyed.filter(stays)
    if best.filter("ties > 1").isEmpty():
        return left.select(*docs.columns)
    alone = left.filter(held.isNull() | (held["ties"] == 1))
    # rows that agree with the best copy in everything that ranks them: one of each digest stays
    order = Window.partitionBy(key).orderBy("text")
    nth = fresh(left, "_nth")
    tied = left.filter(held["ties"] > 1).withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return alone.select(*docs.columns).unionByName(tied.select(*docs.columns))


SQL = """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM keyed WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
