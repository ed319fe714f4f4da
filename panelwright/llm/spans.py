"""Substring duplicates by sliding spans of sentences.

A sentence ends after ., ! or ? and white space, or after a line's end. A run is any number of
consecutive sentences with at least ``WORDS`` words together; every sentence that a run other than
the first of its kind covers is removed. First is the smallest (doc_id, text, place).

Hashed (128 bits of the words in lower case) and joined over all documents are the runs that
begin or end too short without their last or first sentence: the shortest from every sentence and
the shortest up to every sentence. They cover what all runs cover. Let a run repeat, and take one of its
sentences: either the shortest run from there stays inside, or the rest from there is too short
and the shortest run up to the end reaches back over it; and a part of a run repeats where the
run does, in the same order of places. So two runs a sentence stand for all.

Only hashes and places are joined; texts move once, to meet the places of their own document. A
run that very many documents share is reduced to its first place on the map side, and Spark
splits its rows in the join.

Defined results: null counts as an empty text, which has no sentences and stays empty; a null
``doc_id`` comes first in order; rows that repeat both ``doc_id`` and text are one document;
white space at the end of a kept sentence stays; an empty table gives no rows; other columns pass
through ``drop_repeated_spans``, whatever they are called. Words are what white space separates, so texts in
scripts without it have few and long ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tables import fresh, written

WORDS = 20
_END = re.compile(r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*")


def sentences(text: str) -> list[str]:
    """Pieces that joined are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if text else []


def runs(pieces: list[str], words: int = WORDS):
    """(start, length, hash) of the shortest long enough run from and up to every sentence."""
    plain = [p.lower().encode().split() for p in pieces]
    counts = np.concatenate([[0], np.cumsum([len(w) for w in plain])]).astype(np.int64)
    ends = np.searchsorted(counts, counts[:-1] + words)
    starts = np.searchsorted(counts, counts[1:] - words, side="right") - 1
    found = {(start, end) for start, end in enumerate(ends.tolist()) if end <= len(pieces)}
    found |= {(start, end) for end, start in enumerate(starts.tolist(), 1) if start >= 0}
    lines = [b" ".join(w) for w in plain]
    for start, end in sorted(found):
        yield start, end - start, xxhash.xxh3_128_digest(b"\n".join(lines[start:end]))


RUNS = "high long, low long, doc_id long, text_hash long, start int, length int"


def span_hashes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            highs, lows, ids, hashes, starts, lengths = ([] for _ in range(6))
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, length, value in runs(sentences(text)):
                    highs.append(int.from_bytes(value[:8], "big", signed=True))
                    lows.append(int.from_bytes(value[8:], "big", signed=True))
                    starts.append(start)
                    lengths.append(length)
                ids += [doc_id] * (len(starts) - len(ids))
                hashes += [text_hash] * (len(starts) - len(hashes))
            long, short = pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays(
                [pa.array(highs, long), pa.array(lows, long), pa.array(ids, long), pa.array(hashes, long), pa.array(starts, short), pa.array(lengths, short)],
                ["high", "low", "doc_id", "text_hash", "start", "length"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return thin.mapInArrow(run, RUNS)


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): the repeated spans of a document, each (start, length, first),
    ``first`` being the document where the span first stands."""
    all_runs = written(span_hashes(docs), "runs")
    place = F.struct("doc_id", "text_hash", "start")
    firsts = all_runs.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    again = all_runs.join(firsts, ["high", "low"]).filter(~place.eqNullSafe(F.col("first")))
    span = F.struct("start", "length", F.col("first.doc_id").alias("first"))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("spans"))


def removed(n: int, spans) -> list[bool]:
    """Which of n sentences a span covers."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["length"]] -= 1
    return (np.cumsum(edge)[:n] > 0).tolist()


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with texts freed of repeated spans, and what was found: n_sentences, n_removed,
    copied_from (documents that hold the removed spans first)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, doc_id = (docs.columns.index(c) for c in ("text", "doc_id"))
    plain = docs.toDF(*names)
    found = written(covered(plain.select(F.col(names[doc_id]).alias("doc_id"), F.col(names[text]).alias("text"))), "covered")
    content = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    match = F.col(names[doc_id]).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(content) == F.col("text_hash"))
    joined = plain.join(found, match, "left").select(*names, "spans")
    extra = []
    for wanted in ("n_sentences", "n_removed", "copied_from"):
        extra.append(fresh(docs, wanted))

    def run(batches):
        for batch in batches:
            kept, totals, gone, sources = [], [], [], []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                pieces = sentences(value or "")
                out = removed(len(pieces), spans)
                kept.append(value if not any(out) else "".join(p for p, r in zip(pieces, out, strict=True) if not r))
                totals.append(len(pieces))
                gone.append(sum(out))
                sources.append(sorted({s["first"] for s in spans or () if s["first"] is not None}))
            columns = list(batch.columns[:-1])
            columns[text] = pa.array(kept, pa.string())
            new = [pa.array(totals, pa.int32()), pa.array(gone, pa.int32()), pa.array(sources, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *new], [*names, "n_sentences", "n_removed", "copied_from"])

    types = ["string" if k == text else f.dataType.simpleString() for k, f in enumerate(docs.schema.fields)]
    kinds = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    out = joined.mapInArrow(run, f"{kinds}, n_sentences int, n_removed int, copied_from array<long>")
    return out.toDF(*docs.columns, *extra)


def span_report(docs: DataFrame) -> DataFrame:
    """One row per document: sentences, removed ones, digest of the kept text, first holders."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return drop_repeated_spans(thin).select(
        "doc_id",
        "n_sentences",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        F.array_join("copied_from", ",").alias("copied_from"),
    )


SQL = f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?][\\x20\\x09-\\x0D]+|\\n[\\x20\\x09-\\x0D]*)|.+') AS pieces FROM documents
), sentence AS (
  SELECT doc_id, unnest(range(len(pieces))) AS k, unnest(pieces) AS piece FROM cut
), counted AS (
  SELECT *, regexp_extract_all(lower(piece), '[^\\x20\\x09-\\x0D]+') AS words FROM sentence
), summed AS (
  SELECT *, array_to_string(words, ' ') AS line, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY k) - len(words) AS before FROM counted
), part AS (
  SELECT a.doc_id, a.k AS start, b.k AS last, b.before + len(b.words) - a.before AS n, len(a.words) AS head, len(b.words) AS tail
  FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {WORDS}
), reach AS (
  SELECT doc_id, start, last FROM part WHERE n >= {WORDS} AND (n - tail < {WORDS} OR n - head < {WORDS})
), run AS (
  SELECT r.doc_id, r.start, r.last, string_agg(s.line, chr(10) ORDER BY s.k) AS span
  FROM reach r JOIN summed s ON s.doc_id = r.doc_id AND s.k BETWEEN r.start AND r.last GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS holder FROM run WINDOW w AS (PARTITION BY span ORDER BY doc_id, start)
), gone AS (
  SELECT DISTINCT s.doc_id, s.k FROM summed s JOIN ranked r ON r.nth > 1 AND s.doc_id = r.doc_id AND s.k BETWEEN r.start AND r.last
), holders AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT holder)), ',') AS copied_from FROM ranked WHERE nth > 1 GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, CAST(count(*) AS INTEGER) AS n_sentences, CAST(count(g.k) AS INTEGER) AS n_removed,
         coalesce(string_agg(CASE WHEN g.k IS NULL THEN piece END, '' ORDER BY s.k), '') AS text
  FROM summed s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.k = g.k GROUP BY s.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(copied_from, '') AS copied_from
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN holders h ON d.doc_id = h.doc_id
"""
