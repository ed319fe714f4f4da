"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word position is a suffix of at most ``longest`` words of its piece. Each task sorts the
pointers of its texts by language, first, second, third word: a segment of pointers is split by a
pivot word into less, equal and greater, and the equal part goes on with the next word. All
segments of a block are split at once, in numpy. The size of an equal part is the count of its
leading words, so the sorted block yields every phrase once, with its count. These entries are
routed by their first two words and sorted likewise in their buckets, where sizes become sums;
parts that weigh less than ``least`` are abandoned there, whole. What is left are the exact counts
of the frequent phrases, from which Spark joins the parts of every cut.

Defined results: a null text is empty; a null language is ``und``; a repeated row counts again;
an empty table gives no rows; other columns are not read; texts are read whole, in blocks of
about ``BLOCK`` bytes (one longer text is one block).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.tables import written

LONGEST, LEAST, BEST, CONTAINED = 3, 10, 2000, 50
BLOCK = 4 << 20  # bytes of text that are sorted at once
BUCKET = 6 << 20  # bytes of text whose phrases share a routing bucket
HELD = 2_000_000  # entries of a bucket that are held before they are summed

#: The characters that end a piece, and the white space between words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_KIND = np.zeros(256, np.uint8)
_KIND[list(ENDS)], _KIND[list(BLANKS)] = 2, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def equal_parts(keys: np.ndarray, weights: np.ndarray | None = None, least: int = 1):
    """Multikey quicksort of the rows of ``keys`` (-1: the row has ended): (row, depth, weight)
    of every part of rows that agree in their first ``depth`` + 1 keys, ``row`` being one of
    them. Parts that weigh less than ``least`` are abandoned with all that is in them. The first
    key (a language) has few values: its parts are dealt by counting."""
    n, width = keys.shape
    flat = keys.ravel()
    lead = keys[:, 0]
    rows = np.argsort(lead.astype(np.int16) if n and lead.max() < 1 << 15 else lead, kind="stable")
    starts = np.flatnonzero(np.diff(lead[rows], prepend=-1))
    weight = np.add.reduceat(weights[rows], starts) if weights is not None and n else np.diff(np.append(starts, n))
    kept = weight >= least
    yield rows[starts[kept]], np.zeros(int(kept.sum()), np.int64), weight[kept]
    if width == 1:
        return
    rows = rows[np.repeat(kept, np.diff(np.append(starts, n)))]
    sizes = np.diff(np.append(starts, n))[kept]
    starts, depth = np.cumsum(sizes) - sizes, np.ones(len(sizes), np.int64)
    while len(rows):
        sizes = np.diff(np.append(starts, len(rows)))
        key = flat[rows * width + np.repeat(depth, sizes)]
        pivot = _middle(key[starts], key[starts + sizes // 2], key[starts + sizes - 1])
        beside = np.repeat(pivot, sizes)
        side = [key < beside, key == beside]
        side.append(~(side[0] | side[1]))
        counts = np.stack([np.add.reduceat(s, starts, dtype=np.int64) for s in side], axis=1)
        # stable: rows of a side keep their order behind the sides before it
        first = starts[:, None] + np.concatenate([np.zeros((len(starts), 1), np.int64), np.cumsum(counts, axis=1)[:, :2]], axis=1)
        moved = np.empty_like(rows)
        for k, s in enumerate(side):
            at = np.flatnonzero(s)
            before = np.cumsum(counts[:, k]) - counts[:, k]
            moved[np.arange(len(at)) + np.repeat(first[:, k] - before, counts[:, k])] = rows[at]
        rows = moved
        sizes, starts, weight = counts.ravel(), first.ravel(), counts.ravel()
        if weights is not None:
            sums = np.concatenate([[0], np.cumsum(weights[rows])])
            weight = sums[starts + sizes] - sums[starts]
        equal = np.tile([False, True, False], len(depth))
        found = equal & (weight >= least) & np.repeat(pivot >= 0, 3)
        yield rows[starts[found]], np.repeat(depth, 3)[found], weight[found]
        depth = np.repeat(depth, 3) + equal
        kept = (sizes > 0) & (weight >= least) & (~equal | (found & (depth < width)))
        single = kept & (sizes == 1)  # a row alone is all its further parts
        alone, at, own = rows[starts[single]], depth[single], weight[single]
        for k in range(width):
            here = (at <= k) & (keys[alone, k] >= 0)
            yield alone[here], np.full(int(here.sum()), k), own[here]
        kept &= ~single
        rows = rows[np.repeat(kept, sizes)]
        sizes, depth = sizes[kept], depth[kept]
        starts = np.cumsum(sizes) - sizes


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def suffixes(langs: pa.Array, texts: pa.Array, longest: int):
    """(language names, words, keys): a row of ``keys`` holds the language and the next
    ``longest`` words of a position, -1 beyond its piece."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[body]
    word = kind == 0
    border = np.zeros(len(body) + 1, bool)
    border[ends] = True  # texts touch without anything between them
    begin = word & (border[:-1] | np.concatenate([[True], ~word[:-1]]))
    end = word & (border[1:] | np.concatenate([~word[1:], [True]]))
    at = np.flatnonzero(begin)
    lengths = np.flatnonzero(end) + 1 - at
    packed = _LOWER[body[word]]
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode()
    doc = np.searchsorted(ends, at, "right") - 1
    stops = np.cumsum(kind == 2, dtype=np.int32 if len(body) < 2**31 else np.int64)[at]
    ids = words.indices.to_numpy().astype(np.int32)
    names = langs.dictionary_encode()
    keys = np.full((len(ids), longest + 1), -1, np.int32)
    keys[:, 0] = names.indices.to_numpy()[doc]
    for k in range(longest):
        on = slice(0, len(ids) - k) if k < len(ids) else slice(0, 0)
        same = (doc[on] == doc[k:]) & (stops[on] == stops[k:])
        keys[on, k + 1] = np.where(same, ids[k:], -1)
    return names.dictionary.cast(pa.string()), words.dictionary, keys


_ODD = np.uint64(0x9E3779B97F4A7C15)  # mixes the words' hashes in their order


def _hashes(values: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(v) for v in values.to_pylist()], np.uint64)


def _code(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after a byte that tells."""
    size = 1 if not len(values) else next(w for w in (1, 2, 4, 8) if int(values.max()) < 1 << 8 * w)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _decode(code: bytes) -> np.ndarray:
    return np.frombuffer(code, f"<u{code[0]}", offset=1).astype(np.int64)


def _order(*columns: np.ndarray) -> np.ndarray:
    """Order of the rows by columns of whole numbers from 0, in one number where that has room."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(sizes) >= 1 << 62:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for column, size in zip(columns, sizes, strict=True):
        key = key * size + column
    return np.argsort(key)


def _lines(text: bytes, some: bool) -> pa.Array:
    body = np.frombuffer(text + b"\n" if some else b"", np.uint8)
    ends = np.flatnonzero(body == 10)
    places = np.append(0, ends - np.arange(len(ends))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(body[body != 10])])


@dataclass
class Entries:
    """Counted phrases: their language and words (-1 beyond the phrase) by number, and counts. A
    phrase without words is the number of all words of the language."""

    langs: pa.Array
    words: pa.Array
    lang: np.ndarray
    ids: np.ndarray
    n: np.ndarray

    @property
    def length(self) -> np.ndarray:
        return (self.ids >= 0).sum(axis=1)

    def routed(self, buckets: int) -> np.ndarray:
        """Bucket of each entry, by its language and its first two words."""
        of_lang, of_word = _hashes(self.langs), _hashes(self.words)
        mixed = of_lang[self.lang]
        for k in range(min(2, self.ids.shape[1])):
            there = self.ids[:, k] >= 0
            step = (mixed ^ (mixed >> np.uint64(29))) * _ODD + of_word[np.where(there, self.ids[:, k], 0)] if len(of_word) else mixed
            mixed = np.where(there, step, mixed)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)

    def packed(self, buckets: int):
        """Rows (bucket, langs, words, codes) of the buckets: longer phrases stand behind their
        first two words, which are written once."""
        bucket, length = self.routed(buckets), self.length
        second = self.ids[:, 1] if self.ids.shape[1] > 1 else np.full(len(bucket), -1)
        order = _order(bucket, self.lang, self.ids[:, 0] + 1, second + 1, length > 2)
        bucket, length, lang, ids, n = (x[order] for x in (bucket, length, self.lang, self.ids, self.n))
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, size, head = ids[a:b], length[a:b], length[a:b] <= 2
            names = lang[a:b][head] * 4 + size[head]
            place = np.arange(own.shape[1])
            used = (place < size[:, None]) & (head[:, None] | (place >= 2))
            flat = pa.array(own[used]).dictionary_encode()
            behind = np.diff(np.append(np.flatnonzero(head), len(head))) - 1
            taken = self.words.take(flat.dictionary).cast(pa.binary())
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), b"\n")[0].as_py()
            codes = [names, behind, size[~head] - 2, flat.indices.to_numpy(), n[a:b]]
            yield int(bucket[a]), self.langs, words, [_code(c) for c in codes]

    @staticmethod
    def unpacked(langs: pa.Array, words: bytes, codes: list[bytes], longest: int) -> Entries:
        names, behind, more, flat, n = map(_decode, codes)
        head = np.zeros(len(n), bool)
        head[np.cumsum(behind + 1) - behind - 1] = True
        own = np.cumsum(head) - 1  # the head of every entry
        length = names[own] % 4
        length[~head] += more
        place = np.arange(longest)
        ids = np.full((len(n), longest), -1, np.int32)
        ids[(place < length[:, None]) & (head[:, None] | (place >= 2))] = flat
        ids[:, :2] = ids[np.flatnonzero(head)[own], :2]
        return Entries(langs, _lines(words, len(flat) > 0), (names // 4).astype(np.int32)[own], ids, n)

    @staticmethod
    def together(parts: list[Entries]) -> Entries:
        """All entries, by one numbering of languages and words."""

        def joined(arrays, numbers):
            whole = pa.chunked_array(arrays).combine_chunks().dictionary_encode()
            new = np.append(whole.indices.to_numpy(), -1).astype(np.int32)  # the last one is of the number -1
            starts = np.cumsum([0, *map(len, arrays)])
            parts = zip(numbers, starts[:-1], starts[1:], strict=True)
            return whole.dictionary, np.concatenate([np.append(new[a:b], np.int32(-1))[x] for x, a, b in parts])

        langs, lang = joined([p.langs for p in parts], [p.lang for p in parts])
        words, ids = joined([p.words for p in parts], [p.ids for p in parts])
        return Entries(langs, words, lang, ids, np.concatenate([p.n for p in parts]))

    def summed(self, least: int) -> Entries:
        """Entries of the same phrase as one; those that weigh less than ``least`` are abandoned."""
        length = self.length
        # entries of one length are parts of their own
        keys = np.column_stack([(self.lang * 8 + length).astype(np.int32), self.ids])
        row, depth, n = (np.concatenate(c) for c in zip(*equal_parts(keys, self.n, least), strict=True))
        whole = depth == length[row]
        row = row[whole]
        return Entries(self.langs, self.words, self.lang[row], self.ids[row], n[whole])


def _counted(langs: pa.Array, texts: pa.Array, longest: int) -> Entries | None:
    """All phrases of a block of texts."""
    names, words, keys = suffixes(langs, texts, longest)
    if not len(keys):
        return None
    row, depth, n = (np.concatenate(c) for c in zip(*equal_parts(keys), strict=True))
    ids = keys[row, 1:]
    ids[np.arange(longest) >= depth[:, None]] = -1
    return Entries(names, words, keys[row, 0], ids, n)


ENTRIES = "bucket long, langs array<string>, words binary, codes array<binary>"


def _blocks(longest: int, buckets: int):
    def run(batches):
        held, size = [], 0
        for batch in _ended(batches):
            # a batch of long texts is cut too
            for part in [None] if batch is None else _slices(batch):
                if part is not None:
                    held.append(part)
                    size += part.nbytes
                if not held or (part is not None and size < BLOCK):
                    continue
                langs, texts = (pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (0, 1))
                found = _counted(langs, texts, longest)
                for bucket, *rest in found.packed(buckets) if found else ():
                    kinds = [pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary())]
                    columns = [pa.array([bucket], pa.int64()), *[pa.array([x], k) for x, k in zip(rest, kinds, strict=True)]]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "langs", "words", "codes"])
                held, size = [], 0

    return run


def _slices(batch: pa.RecordBatch):
    step = max(1, int(batch.num_rows * BLOCK / max(batch.nbytes, 1)))
    return [batch.slice(k, step) for k in range(0, batch.num_rows, step)]


def _ended(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _summed(longest: int, least: int):
    """Frequent phrases of whole buckets; rows come sorted by bucket. What is held of a bucket is
    summed when it has grown to twice its last size, so that a hot pair of words costs its
    different phrases and not its rows."""

    def run(batches):
        held, size, limit, bucket = [], 0, HELD, None
        for batch in _ended(batches):
            for k in [None] if batch is None else range(batch.num_rows):
                now = None if k is None else batch.column(0)[k].as_py()
                if held and now != bucket:
                    yield _phrases(Entries.together(held).summed(least))
                    held, size, limit = [], 0, HELD
                bucket = now
                if k is None:
                    continue
                langs, words, codes = (batch.column(c)[k] for c in (1, 2, 3))
                held.append(Entries.unpacked(langs.values, words.as_py(), codes.as_py(), longest))
                size += len(held[-1].n)
                if size > limit:
                    held = [Entries.together(held).summed(1)]
                    size = len(held[0].n)
                    limit = max(HELD, 2 * size)

    return run


def _phrases(found: Entries) -> pa.RecordBatch:
    length = found.length
    spelt = found.words.cast(pa.string()).take(pa.array(found.ids[found.ids >= 0]))
    parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), spelt)
    out = [found.langs.take(pa.array(found.lang)), pa.array(length, pa.int32()), parts, pa.array(found.n, pa.int64())]
    return pa.RecordBatch.from_arrays(out, ["lang", "words", "parts", "f"])


FREQUENT = "lang string, words int, parts array<string>, f long"


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, parts, phrase, f): every phrase of up to ``longest`` words that occurs ``least``
    times or more in its language; ``words`` = 0 is the number of all words."""
    if not 1 <= longest <= 7:
        raise ValueError("phrases have one to seven words")
    thin = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = thin.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    entries = thin.mapInArrow(_blocks(longest, size // BUCKET + 1), ENTRIES)
    routed = entries.repartition("bucket").sortWithinPartitions("bucket")
    frequent = routed.mapInArrow(_summed(longest, least), FREQUENT)
    return written(frequent.withColumn("phrase", F.array_join("parts", " ")), "phrases")


def _piece(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("parts", first, length), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, contained: int = CONTAINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``best`` phrases of two words
    and more. A phrase scores floor(10^6 a^2 / (l r)) at its weakest cut into a first and a second
    part, which occur l and r times. A phrase inside a longer one that has at least ``contained``
    percent of its occurrences goes."""
    counts = phrase_counts(docs, longest, least)
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    split = counts.filter("words > 1")
    k = F.col("k")
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "words", "phrase", F.col("f").alias("a"), "k",
        _piece(F.lit(1), k).alias("first"), _piece(k + 1, F.col("words") - k).alias("second"),
    )
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("f").alias(c)) for side, c in (("first", "l"), ("second", "r")))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "second"])
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    scored = scored.withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * a * a, "down": l * r})
    scored = scored.withColumn("score", F.expr("up div down"))
    weakest = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # each phrase inside a longer one, with the longer one's occurrences
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    inside = split.filter("words > 2").select("lang", "f", "words", "parts", F.explode(lengths).alias("long"))
    inside = inside.select("lang", "f", "parts", "long", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("long") + 1)).alias("at"))
    inside = inside.select("lang", _piece(F.col("at"), F.col("long")).alias("phrase"), F.col("f").alias("of_longer"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(
        F.col("of_longer").isNull() | (100 * F.col("of_longer").cast("decimal(20,0)") < contained * F.col("a").cast("decimal(20,0)"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


SQL = f"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p
  FROM documents
), words AS (SELECT lang, regexp_extract_all(unnest(p), '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (VALUES (1), (2), (3)) AS sizes(k)
  WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT * FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.g, c.k, c.f AS a, cut, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : cut]
  JOIN f r ON r.lang = c.lang AND r.g = c.g[cut + 1 : c.k]
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, g[i : i + 1] AS g, max(f) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, l, r, score FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.g = w.g
  WHERE longer IS NULL OR 100 * longer < {CONTAINED} * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {BEST}
"""
