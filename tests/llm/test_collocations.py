import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from panelwright.llm import collocations as co
from panelwright.llm.tables import importable


def brute(rows, least=10, best=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in frequent.items():
        if any(p[0] == lang and len(p[1]) > len(g) and 100 * b >= 50 * a and any(p[1][i : i + len(g)] == g for i in range(len(p[1])))
               for p, b in frequent.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)
    )


def found(spark, rows, **kw):
    importable(spark)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS rank", "3 AS `a.b`", "4 AS words")
    return sorted(tuple(r) for r in co.collocations(docs.repartition(3), **kw).collect())


def texts(seed, n, vocabulary=30):
    rng = np.random.default_rng(seed)
    words = np.array([f"W{k}é" if k % 7 == 0 else f"w{k}" for k in range(vocabulary)])
    ends = np.array([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "])
    share = 1 / np.arange(1, vocabulary + 1)
    rows = []
    for k in range(n):
        size = int(rng.integers(0, 60))
        body = "".join(np.char.add(rng.choice(words, size, p=share / share.sum()), rng.choice(ends, size)))
        rows.append((["en", "fr", None][k % 3], body + ("new york city hall " * (k % 3))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(seed, 400) + [("en", None), ("en", ""), (None, " . , "), ("de", "one two"), ("und", "w1 w2 w3 " * 12)]
    want = brute(rows)
    assert len(want) > 40 and found(spark, rows) == want


def test_repeated_rows_and_ties(spark):
    rows = [("en", "b a. c d. a b c! d e f")] * 10 + [("en", "x" * 100_000 + " y")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, best=2) == brute(rows, best=2)


def test_small_blocks_and_many_buckets(spark, monkeypatch):
    rows = texts(5, 90)
    monkeypatch.setattr(co, "BUCKET", 500)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_entries_survive_packing_and_summing(longest):
    langs, bodies = (pa.array(c, pa.string()) for c in zip(*[(a or "und", b) for a, b in texts(8, 40)], strict=True))
    whole = co._counted(langs, bodies, longest)
    parts = [co.Entries.unpacked(a, b, c, longest) for k in (0, 20) for _, a, b, c in co._counted(langs[k : k + 20], bodies[k : k + 20], longest).packed(7)]

    def plain(e):
        return sorted((e.langs[a].as_py(), tuple(e.words[i].as_py() for i in ids if i >= 0), n) for a, ids, n in zip(e.lang.tolist(), e.ids.tolist(), e.n.tolist(), strict=True))

    assert plain(co.Entries.together(parts).summed(1)) == plain(whole)
    assert plain(co.Entries.together(parts).summed(5)) == [x for x in plain(whole) if x[2] >= 5]
    buckets = {}
    for bucket, a, b, c in whole.packed(7):
        for lang, words, _ in plain(co.Entries.unpacked(a, b, c, longest)):
            assert buckets.setdefault((lang, words[:2]), bucket) == bucket


def test_a_hot_bucket_is_summed_on_the_way(spark, monkeypatch):
    importable(spark)
    rows = texts(6, 60)
    langs, bodies = (pa.array(c, pa.string()) for c in zip(*[(a or "und", b) for a, b in rows], strict=True))
    monkeypatch.setattr(co, "HELD", 50)
    batches = []
    for k in range(0, 60, 6):
        for bucket, a, b, c in co._counted(langs[k : k + 6], bodies[k : k + 6], 3).packed(1):
            kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary())]
            batches.append(pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, a, b, c), kinds, strict=True)], ["bucket", "langs", "words", "codes"]))
    (out,) = co._summed(3, 2)(iter(batches))
    whole = co._phrases(co._counted(langs, bodies, 3).summed(2))
    key = lambda r: (r["lang"], r["parts"])
    assert sorted(out.to_pylist(), key=key) == sorted(whole.to_pylist(), key=key)


def test_texts_that_touch_stay_apart(spark):
    rows = [("en", "left")] * 12 + [("en", "right")] * 12
    assert found(spark, rows) == []


def test_empty_table(spark):
    assert found(spark, [("en", None)]) == []
    importable(spark)
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_parts_are_whole_and_light_ones_are_abandoned():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 4, (500, 3))
    keys[rng.random(500) < 0.2, 2] = -1
    weights = rng.integers(1, 5, 500)
    want = Counter()
    for row, w in zip(keys.tolist(), weights.tolist(), strict=True):
        for depth in range(3):
            if row[depth] >= 0:
                want[tuple(row[: depth + 1])] += w
    for least in (1, 30):
        got = [(tuple(keys[r, : d + 1].tolist()), w) for part in co.equal_parts(keys, weights, least) for r, d, w in zip(*part, strict=True)]
        assert len(got) == len(dict(got)) and dict(got) == {k: w for k, w in want.items() if w >= least}


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("CAST(1000000 AS decimal(7,0)) * CAST(999999999999989 AS decimal(15,0)) * CAST(999999999999989 AS decimal(15,0)) AS up",
                                    "CAST(999999999999999 AS decimal(15,0)) * CAST(999999999999998 AS decimal(15,0)) AS down").selectExpr("up div down AS s")
    assert row.first().s == 1_000_000 * 999999999999989**2 // (999999999999999 * 999999999999998)
