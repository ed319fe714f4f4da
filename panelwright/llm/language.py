"""Language identification by unigram pieces, marginalised over all segmentations.

A word (a run of letters, in lower case, after a word-start mark) is generated by drawing pieces
of a fixed public vocabulary one after another with the probabilities of a language; its
probability sums all ways to cut it into pieces (forward algorithm). A text's score is the sum
over its words, turned into the posterior probability of the best language. Piece probabilities
are learnt per language by expectation maximisation over the same segmentations; characters that
are no piece of their own share one entry.

Learning may use a bounded sample of labelled rows (``per_language``, chosen by a hash of
``doc_id``); prediction reads every text whole.

Defined results: null text or no letter gives ``und`` with score 0, as does a table without any
labelled row to learn from; ties go to the first language by code point; a null ``doc_id`` hashes
as the empty text; repeated rows give repeated rows; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tables import held, written

START = "▁"  # fixed value: the vocabulary's mark of a word's start
PER_LANGUAGE = 4000  # documents that a language is learnt from, about
ROUNDS = 3
SMOOTH = 0.1
LONG = 48  # longer words are scored one by one, rescaled on the way
CACHED = 900_000  # words a worker process remembers
BATCH_TEXT = 2 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """Number of every lower-case piece, and how many there are; beginnings of pieces that are
    none themselves have number -1. One number more stands for characters that are no piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    kept = sorted(p for p in set(map(model.id_to_piece, plain)) if p == p.lower() and (p.lstrip(START).isalpha() or p == START))
    beginnings = {p[:k]: -1 for p in kept for k in range(1, len(p))}
    return beginnings | {p: k for k, p in enumerate(kept)}, len(kept)


def edges(text: str, vocabulary: dict[str, int], unknown: int):
    """(begin, end, piece) of all pieces in a marked word."""
    get, n = vocabulary.get, len(text)
    for begin in range(n):
        end = begin + 1
        k = get(text[begin])
        yield begin, end, unknown if k is None or k < 0 else k
        while k is not None and end < n:
            end += 1
            k = get(text[begin:end])
            if k is not None and k >= 0:
                yield begin, end, k


class Lattice:
    """All pieces of many words: piece ``piece[e]`` leads from state ``tail[e]`` to ``head[e]``.
    Words occupy consecutive states; edges are ordered by their end in the word, then by word."""

    def __init__(self, words: list[str], vocabulary: dict[str, int], unknown: int):
        tail, head, piece, first, at = [], [], [], [], 0
        for word in words:
            text = START + word
            first.append(at)
            for begin, end, k in edges(text, vocabulary, unknown):
                tail.append(at + begin)
                head.append(at + end)
                piece.append(k)
            at += len(text) + 1
        self.states, self.first = at, np.array(first, np.int64)
        self.last = np.append(self.first[1:], at) - 1 if words else self.first
        tail, head, piece = (np.array(x, np.int64) for x in (tail, head, piece))
        depth = (head - self.first[np.searchsorted(self.first, head, "right") - 1]).astype(np.uint16)
        order = np.argsort(head, kind="stable")
        order = order[np.argsort(depth[order], kind="stable")]
        self.tail, self.head, self.piece, depth = tail[order], head[order], piece[order], depth[order]
        self.letters = self.head - self.tail
        self.steps = np.flatnonzero(np.diff(depth.astype(np.int64), prepend=-1, append=-1))
        self.heads = np.flatnonzero(np.diff(self.head, prepend=-1))  # the first edge of every state
        self.cuts = np.searchsorted(self.heads, self.steps)

    def lifted(self, chance: np.ndarray, lift: int) -> np.ndarray:
        """Chances by edge, times 2 ** lift for every letter: all ways to the end of a word of n
        states grow by the same 2 ** (lift * (n - 1))."""
        return np.ldexp(chance, (lift * self.letters).reshape(-1, *[1] * (chance.ndim - 1)))

    def forward(self, chance: np.ndarray) -> np.ndarray:
        """Sums over all ways from a word's start to each of its states; ``chance`` is by edge."""
        alpha = np.zeros((self.states, *chance.shape[1:]))
        alpha[self.first] = 1
        for k, (a, b) in enumerate(zip(self.steps[:-1], self.steps[1:], strict=True)):
            begins = self.heads[self.cuts[k] : self.cuts[k + 1]]
            alpha[self.head[begins]] = np.add.reduceat(alpha[self.tail[a:b]] * chance[a:b], begins - a, axis=0)
        return alpha

    def backward(self, chance: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.states, *chance.shape[1:]))
        beta[self.last] = 1
        for a, b in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            np.add.at(beta, self.tail[a:b], beta[self.head[a:b]] * chance[a:b])
        return beta


def lift_of(chance: np.ndarray) -> int:
    """Doublings per letter that put the least and the greatest possible sum over a word equally
    far from 1: with them no word of up to ``LONG`` letters under- or overflows as long as the
    least chance is above 5e-13 (2e11 pieces learnt from)."""
    return min(20, round(-np.log2(chance.min()) / 2))


def long_word(word: str, vocabulary: dict[str, int], unknown: int, chance: np.ndarray) -> np.ndarray:
    """Log probability of one word by language, rescaled at every position."""
    text = START + word
    scale, total = np.zeros(chance.shape[1]), {0: np.ones(chance.shape[1])}
    for begin in range(len(text)):
        here = total.pop(begin)
        scale += np.log(here)
        for k in total:
            total[k] = total[k] / here
        for start, end, k in edges(text[begin : begin + LONGEST], vocabulary, unknown):
            if start:
                break
            total[begin + end] = total.get(begin + end, 0) + chance[k]
    return scale + np.log(total[len(text)])


LONGEST = 64  # no piece of a public vocabulary is longer


def word_scores(words: list[str], vocabulary, unknown, chance: np.ndarray) -> np.ndarray:
    """Log probability of every word by language."""
    out = np.empty((len(words), chance.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    lift = lift_of(chance)
    for at in range(0, len(short), 20_000):
        part = short[at : at + 20_000]
        lattice = Lattice([words[i] for i in part], vocabulary, unknown)
        sums = lattice.forward(lattice.lifted(chance[lattice.piece], lift))[lattice.last]
        out[part] = np.log(sums) - np.log(2) * lift * (lattice.last - lattice.first)[:, None]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_word(w, vocabulary, unknown, chance)
    return out


def lexicon(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text)."""

    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text.as_py() or ""))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w.isalpha()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(path: str, languages: list[str], chance: np.ndarray):
    """Expected uses of every piece over rows of a lexicon, as rows (cell, n)."""

    def run(batches):
        vocabulary, unknown = pieces(path)
        number = {lang: k for k, lang in enumerate(languages)}
        used, lift = np.zeros(chance.shape), lift_of(chance)
        for batch in batches:
            langs, words, counts = (batch.column(k).to_pylist() for k in range(3))
            rows = [(number[lang], w, n) for lang, w, n in zip(langs, words, counts, strict=True) if len(w) <= LONG]
            for at in range(0, len(rows), 20_000):
                own, texts, times = zip(*rows[at : at + 20_000], strict=True)
                lattice = Lattice(list(texts), vocabulary, unknown)
                word = np.searchsorted(lattice.first, lattice.tail, "right") - 1
                column = np.array(own)[word]
                p = lattice.lifted(chance[lattice.piece, column], lift)
                alpha, beta = lattice.forward(p), lattice.backward(p)
                share = alpha[lattice.tail] * p * beta[lattice.head] / alpha[lattice.last][word]
                np.add.at(used, (lattice.piece, column), share * np.array(times)[word])
        cells = np.flatnonzero(used.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(used.ravel()[cells])], ["cell", "n"])

    return run


def learn(labelled: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS):
    """(languages, log priors, piece probabilities by language) of rows (doc_id, lang, text)."""
    size = pieces(path)[1] + 1
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    languages = sorted(counts, key=lambda x: x.encode())
    if not languages:
        return [], np.zeros(0), np.zeros((size, 0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])[F.col("lang")]
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    words = written(lexicon(chosen), "lexicon")
    chance = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds):
        sums = words.mapInArrow(_expected(path, languages, chance), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        used = np.full(chance.size, SMOOTH)
        found = sums.toArrow()  # at most one row per piece and language
        used[found.column("cell").to_numpy()] += found.column("n").to_numpy()
        chance = used.reshape(chance.shape)
        chance = chance / chance.sum(axis=0)
    prior = np.log(np.array([counts[x] for x in languages], float) / sum(counts.values()))
    return languages, prior, chance


class Scorer:
    """Posterior of the best language for many texts; words seen before are not scored again."""

    def __init__(self, path, languages, prior, chance):
        self.vocabulary, self.unknown = pieces(path)
        self.languages, self.prior, self.chance = languages, prior, chance
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def _learn(self, words: list[str]) -> None:
        letters = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
        start = len(self.known)
        self.known.update(zip(words, range(start, start + len(words)), strict=True))
        new = word_scores(letters, self.vocabulary, self.unknown, self.chance)
        new[[not w for w in letters]] = np.nan  # digits in disguise: no word
        if start + len(words) > len(self.scores):
            room = np.zeros((max(2 * len(self.scores), start + len(words)), len(self.languages)))
            room[: len(self.scores)] = self.scores
            self.scores = room
        self.scores[start : start + len(words)] = new

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        cut = [words_of(t) for t in texts]
        flat = [w for words in cut for w in words]
        if len(self.known) > CACHED:
            self._forget()
        self._learn([w for w in dict.fromkeys(flat) if w not in self.known])
        rows = self.scores[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
        real = ~np.isnan(rows[:, 0])
        ends = np.cumsum([len(words) for words in cut])
        some = np.concatenate([[0], np.cumsum(real)])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        total = np.tile(self.prior, (len(cut), 1))
        worded = begins < ends  # each text is summed by itself
        if worded.any():
            total[worded] += np.add.reduceat(np.where(real[:, None], rows, 0), begins[worded], axis=0)
        top = total.argmax(axis=1)
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        empty = some[ends] == some[begins]
        return (
            ["und" if e else self.languages[k] for e, k in zip(empty, top, strict=True)],
            [0.0 if e else float(c) for e, c in zip(empty, chance, strict=True)],
        )


def predict(docs: DataFrame, path: str, model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    languages, prior, chance = model
    shared, key = docs.sparkSession.sparkContext.broadcast(chance), uuid.uuid4().hex  # pieces x languages

    def run(batches):
        scorer = held(key, lambda: Scorer(path, languages, prior, shared.value)) if languages else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            names, scores, at = [], [], 0
            while at < len(ids):
                take, size = [], 0
                while at + len(take) < len(ids) and size < BATCH_TEXT:
                    take.append(texts[at + len(take)].as_py() or "")
                    size += len(take[-1])
                got = scorer.score(take) if scorer else (["und"] * len(take), [0.0] * len(take))
                names += got[0]
                scores += got[1]
                at += len(take)
            columns = [ids, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, path: str, folds: int = 5, **options) -> DataFrame:
    """Learns from the documents whose hash falls outside fold 0 and predicts all."""
    train = docs.filter((remainder(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = learn(train.select("doc_id", "lang", "text"), path, **options)
    out = predict(docs, path, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
