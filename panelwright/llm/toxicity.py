"""Toxicity: a convolutional text classifier, trained in numpy.

Words (runs of letters, lower case) have hashed embeddings: the mean of the vectors of the word
and of its beginnings, so inflected forms of a learnt word stand near it. Filters over
one, two and three words are max-pooled over the whole text; a logistic layer gives the score.
A bounded sample of labelled rows (``POSITIVE`` and ``NEGATIVE`` rows, chosen by a hash of
``doc_id``; the loss weighs them back to the true shares) trains the model; every fifth row of
it is kept aside and sets the thresholds (all rows do, if none of those is toxic): one for all,
which the scores are shifted to show as ``CUT``, and one for every language with toxic rows among
them, drawn towards the common one the more, the fewer they are. Language decides only which
threshold a score is held against; it never enters the score.

Defined results: null and empty texts, and texts without letters, have the score of a text of
padding alone; without labelled rows of both kinds every score is 0; a ``doc_id`` with several
labels is toxic if one of them says so; labels of null ids are not used; repeated rows give
repeated rows; an empty table gives no rows; other columns pass through ``drop_toxic``.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.tables import fresh, give_back, held, written

POSITIVE, NEGATIVE = 3000, 5000  # labelled rows that training uses at most, about
BUCKETS, DIMENSIONS = 1 << 16, 16
WIDTHS, FILTERS = (1, 2, 3), 8
STEMS = (4, 5, 6, 7)  # lengths of the beginnings
START = 1e-6  # squared gradients that Adagrad starts from, which damps words seen once
SCALE = 0.05
PASSES, EPOCHS, BATCH, RATE = 24_000, (3, 25), 32, 0.1  # rows seen in training, epochs at least and most
CUT = 0.7
MET = 3  # training rows that must hold a word or beginning for its vector to be learnt
DROPPED = 0.4  # share of words that each pass of training leaves out, by chance
SHRINK = 25  # toxic rows kept aside with which a language's threshold is half its own
CACHED = 200_000  # words a worker process remembers
BATCH_TEXT = 1 << 19  # characters that are scored at once
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def padding(words: int) -> int:
    """Blank words after a text: every word begins a window, and an empty text has one too."""
    return max(WIDTHS) - (1 if words else 0)


def features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings, by which inflected forms meet."""
    parts = ["=" + word, *(word[:n] for n in STEMS if len(word) > n)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class Network:
    vectors: np.ndarray  # buckets x dimensions
    filters: list[np.ndarray]  # by width: (width * dimensions) x filters
    bias: np.ndarray  # of all filters
    weights: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def untrained(seed: int = 7) -> "Network":
        random = np.random.default_rng(seed)
        wide = [random.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        vectors = random.normal(0, SCALE, (BUCKETS, DIMENSIONS)).astype(np.float32)  # words never seen say little
        return Network(vectors, wide, np.full(n, 0.1, np.float32), random.normal(0, 0.3, n).astype(np.float32), -2.0)

    def embedded(self, words: list[str]) -> np.ndarray:
        lists = [features(w) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((k for x in lists for k in x), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.vectors[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to each place of each filter: a convolution is a sum of these."""
        d = DIMENSIONS
        return np.concatenate([vectors @ f[k * d : (k + 1) * d] for w, f in zip(WIDTHS, self.filters, strict=True) for k in range(w)], axis=1)

    def responses(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Filter outputs at every word; ``rows`` are projections, texts end at ``ends``, and no
        window reaches beyond."""
        out, at = [], 0
        for w in WIDTHS:
            total = rows[:, at : at + FILTERS].copy()
            for k in range(1, w):
                total[:-k] += rows[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            for k in range(1, w):
                total[ends - k] = -np.inf
            out.append(total)
            at += w * FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.shift


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """Adagrad on the weighted log loss; gradients run through the pooled positions only. Words are
    left out by chance, and words of fewer than ``MET`` rows do not learn: a text cannot be told
    by a word of its own."""
    net, random = Network.untrained(seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    sizes, flat = array("q"), array("q")  # lists of lists would take most of the driver's memory
    for word in vocabulary:
        found = features(word)
        sizes.append(len(found))
        flat.extend(found)
    sizes, flat = np.array([*sizes, 0], np.int64), np.frombuffer(flat, np.int64) if flat else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    met = np.zeros(BUCKETS, np.int64)
    for d in docs:
        own = np.unique(d)
        n = sizes[own]
        met[np.unique(flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    blank = len(vocabulary)  # the padding word, a zero vector
    docs = [np.concatenate([d, np.full(padding(len(d)), blank)]) for d in docs]
    state = {k: np.full(v.shape, START, np.float32) for k, v in (("v", net.vectors), ("b", net.bias), ("w", net.weights))}
    filter_state, shift_state, d = [np.full(f.shape, START, np.float32) for f in net.filters], START, DIMENSIONS
    for epoch in range(max(EPOCHS[0], min(EPOCHS[1], PASSES // max(1, len(docs))))):
        rate = RATE / (1 + epoch / 2)
        order = random.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids = np.concatenate([docs[i] for i in chosen])
            ids = np.where(random.random(len(ids)) < DROPPED, blank, ids)
            ends = np.cumsum([len(docs[i]) for i in chosen])
            starts = ends - [len(docs[i]) for i in chosen]
            used, place = np.unique(ids, return_inverse=True)
            real = used[used != blank]
            n = sizes[real]
            buckets = flat[np.repeat(begin[real] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            vectors = np.zeros((len(used), d), np.float32)
            if len(real):
                vectors[: len(real)] = np.add.reduceat(net.vectors[buckets], np.cumsum(n) - n, axis=0) / n[:, None]
            outputs = net.responses(net.projected(vectors)[place], ends)
            pooled = np.maximum.reduceat(outputs, starts, axis=0)
            hidden = np.maximum(pooled + net.bias, 0)
            score = sigmoid(hidden @ net.weights + net.shift)
            error = ((score - toxic[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            d_hidden = error[:, None] * net.weights * (hidden > 0)
            # the first place of every maximum
            owner = np.repeat(np.arange(len(chosen)), ends - starts)
            rows, columns = np.nonzero(outputs == pooled[owner])
            _, first = np.unique(owner[rows] * outputs.shape[1] + columns, return_index=True)
            rows, columns = rows[first], columns[first]
            back = d_hidden[owner[rows], columns]
            d_vectors = np.zeros_like(vectors)
            for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                mine = (columns >= k * FILTERS) & (columns < (k + 1) * FILTERS)
                r, c, g = rows[mine], columns[mine] - k * FILTERS, back[mine]
                gradient = np.zeros_like(f)
                for step in range(w):
                    word = place[r + step]
                    np.add.at(gradient[step * d : (step + 1) * d].T, c, vectors[word] * g[:, None])
                    np.add.at(d_vectors, word, f[step * d : (step + 1) * d].T[c] * g[:, None])
                filter_state[k] += gradient**2
                f -= rate * gradient / np.sqrt(filter_state[k])
            moved = np.flatnonzero(d_vectors[: len(real)].any(axis=1))
            if len(moved):
                own, n = real[moved], sizes[real[moved]]
                buckets = flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                spread = np.repeat(d_vectors[moved] / n[:, None], n, axis=0)
                touched, inverse = np.unique(buckets, return_inverse=True)
                summed = np.zeros((len(touched), d), np.float32)
                np.add.at(summed, inverse, spread)
                summed[met[touched] < MET] = 0
                state["v"][touched] += summed**2
                net.vectors[touched] -= rate * summed / np.sqrt(state["v"][touched])
            for key, value, gradient in (("b", net.bias, d_hidden.sum(axis=0)), ("w", net.weights, hidden.T @ error)):
                state[key] += gradient**2
                value -= rate * gradient / np.sqrt(state[key])
            shift_state += float(error.sum()) ** 2
            net.shift -= rate * float(error.sum()) / np.sqrt(shift_state)
    return net


def best_cut(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best F1 on weighted rows, in the middle of the gap it falls in."""
    order = np.argsort(-scores, kind="stable")
    s, w = scores[order], weight[order]
    hit, flagged = np.cumsum(w * toxic[order]), np.cumsum(w)
    f1 = 2 * hit / (flagged + (weight * toxic).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores fall on the same side
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


class Scorer:
    """Scores of many texts; the projections of words seen before are looked up."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {"": 0}  # the padding word
        self.rows = np.zeros((1, FILTERS * sum(WIDTHS)), np.float32)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        cut = [words_of(t) for t in texts]
        cut = [[*words, *[""] * padding(len(words))] for words in cut]
        if len(self.known) > CACHED:
            self._forget()
        flat = [w for words in cut for w in words]
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
            if start + len(new) > len(self.rows):
                room = np.zeros((max(2 * len(self.rows), start + len(new)), self.rows.shape[1]), np.float32)
                room[: len(self.rows)] = self.rows
                self.rows = room
            self.rows[start : start + len(new)] = self.net.projected(self.net.embedded(new))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(words) for words in cut])
        ends = np.cumsum(lengths)
        pooled = np.maximum.reduceat(self.net.responses(self.rows[at], ends), ends - lengths, axis=0)
        return self.net.logits(pooled)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, take, size = [], [], 0
        for text in texts:
            take.append(text)
            size += len(text or "")
            if size > BATCH_TEXT:
                out.append(self.logits(take))
                take, size = [], 0
        if take:
            out.append(self.logits(take))
        return sigmoid(np.concatenate(out)) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Network | None:
    """The network of the labelled rows of ``docs``; None without rows of both kinds."""
    flags = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = written(flags.agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic")), "flags")
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    share = {0: min(1.0, negative / counts[0]), 1: min(1.0, positive / counts[1])}
    limit = F.when(F.col("_toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20)
    sample = written(known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < limit), "sample")  # bounded: the two limits
    texts = docs.select("doc_id", "lang", "text").join(sample, docs["doc_id"].cast("long") == sample["_id"])
    one = texts.groupBy("_id", "_toxic").agg(F.min(F.struct("text", "lang")).alias("row"))  # an id that repeats is one row
    rows = sorted(one.select("_id", "_toxic", "row.lang", "row.text").toArrow().to_pylist(), key=lambda r: r["_id"])
    toxic = np.array([r["_toxic"] for r in rows], np.float32)
    apart = np.array([zlib.crc32(f"aside{r['_id']}".encode()) % 5 == 0 for r in rows], bool)
    aside = apart & (toxic[apart].any() and toxic[~apart].any())
    if not (toxic[~aside].any() and (toxic[~aside] == 0).any()):
        return None
    weight = np.where(toxic == 1, 1 / share[1], 1 / share[0]).astype(np.float32)
    weight = weight / weight.mean()
    inside, text = np.flatnonzero(~aside), [r["text"] or "" for r in rows]
    net = train([text[i] for i in inside], toxic[inside], weight[inside])
    logits = Scorer(net).logits
    held = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    found = np.concatenate([logits([text[i] for i in held[k : k + 500]]) for k in range(0, len(held), 500)])
    move = np.log(CUT / (1 - CUT)) - best_cut(found, toxic[held], weight[held])
    net.shift += move
    for lang in sorted({rows[i]["lang"] for i in held if rows[i]["lang"] is not None}):
        own = np.array([rows[i]["lang"] == lang for i in held])
        n = toxic[held][own].sum()
        if 0 < n < own.sum():
            own_cut, common = best_cut(found[own] + move, toxic[held][own], weight[held][own]), np.log(CUT / (1 - CUT))
            net.thresholds[lang] = float(sigmoid(common + (own_cut - common) * n / (n + SHRINK)))
    return net


def scored(docs: DataFrame, net: Network | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    if net is None:
        return docs.withColumn(name, F.lit(0.0))
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex  # a fixed size: buckets x dimensions
    text, plain = docs.columns.index("text"), [f"c{k}" for k in range(len(docs.columns))]

    def run(batches):
        scorer = held(key, lambda: Scorer(shared.value))
        give_back()
        for batch in batches:
            values = scorer.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*plain, "score"])

    kinds = [T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType())])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, name)


def threshold(lang: Column, net: Network | None) -> Column:
    if net is None or not net.thresholds:
        return F.lit(CUT)
    pairs = F.create_map(*[F.lit(x) for pair in net.thresholds.items() for x in pair])
    return F.coalesce(pairs[lang], F.lit(CUT))


def judge(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, **options) -> DataFrame:
    """Trains on the documents outside the held-out fold and scores all: (doc_id, held_out, score,
    predicted, threshold, rejected)."""
    fold = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds
    net = fit(docs, labels.filter(fold(F.col("doc_id")) != out), **options)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "text")])
    cut = threshold(F.col("lang"), net)
    return scored(thin, net).select(
        "doc_id",
        (fold(F.col("doc_id")) == out).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        cut.alias("threshold"),
        (F.col("score") >= cut).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents below the threshold of their language, with the columns of ``docs``."""
    net = fit(docs, labels, **options)
    name = fresh(docs, "_score")
    return scored(docs, net, name).filter(F.col(name) < threshold(F.col("lang"), net)).drop(name)
