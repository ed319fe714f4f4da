import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from panelwright.llm import suffixes
from panelwright.llm.tables import importable


def noise(rng, n, alphabet="abcd é\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def collection(seed=1):
    rng = random.Random(seed)
    passage, other = noise(rng, 400), noise(rng, 230)
    texts = [noise(rng, 300) + passage + noise(rng, 90), passage[50:390], noise(rng, 10) + passage[:260], other + noise(rng, 500) + other, "x" * 1500,
             "abcdefg" * 60, None, "", "short", other[:199], noise(rng, 3000)]
    for _ in range(12):  # many contexts of one passage
        texts.append(noise(rng, rng.randrange(200)) + passage[100:320] + noise(rng, rng.randrange(200)))
    texts += [texts[1], texts[10]]
    return list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents(spark, rows):
    importable(spark)
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'c' AS crc", "2 AS start", "3 AS spans").repartition(3)


@pytest.mark.parametrize("limit", [1, suffixes.CLASS])
def test_report_equals_brute_force(spark, limit):
    rows = collection()
    got = suffixes.removal_report(documents(spark, rows), limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(4)
    passage = noise(rng, 600)
    texts = [(noise(rng, 2500) + passage + noise(rng, 700) + passage).encode(), passage.encode()]
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    windows = set()
    for held in suffixes._pieces(texts):
        lengths = np.array([len(p) for *_, p in held])
        starts = np.cumsum(lengths) - lengths
        piece, first, count, _, _ = suffixes.segments(np.frombuffer(b"".join(p for *_, p in held), np.uint8), starts, lengths)
        for k, f, n in zip(piece, first, count, strict=True):
            assert n <= suffixes.WINDOW
            new = {(held[k][0], held[k][1] + int(f) + d) for d in range(n)}
            assert not new & windows
            windows |= new
    assert windows == {(row, p) for row, t in enumerate(texts) for p in range(len(t) - 199)}


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_transforms_find_repeated_strings(shards):
    rng = random.Random(shards)
    base = [noise(rng, 300, "ab").encode() for _ in range(3)]
    strings = [base[0], base[0][40:], base[1][:250] + b"z" * 30, b"y" + base[1], base[2], b"q" * 450, b"xyz" * 90, b""]
    dealt = [strings[k::shards] for k in range(shards)]
    places = suffixes.repeated_places([d for d in dealt if d])
    seen = Counter(s[p : p + 200] for s in strings for p in range(len(s) - 199))
    for own, found in zip([d for d in dealt if d], places, strict=True):
        text = b"\xff".join(own) + b"\xff"
        assert found.tolist() == [p for p in range(len(text) - 199) if seen[text[p : p + 200]] > 1]


def test_transform_of_a_shard():
    text = b"banana\xffbandana\xff"
    bwt, lf, order = suffixes.shard_transform([b"banana", b"bandana"])
    assert sorted(order.tolist()) == list(range(len(text)))
    turned = [text[k:] + text[:k] for k in order]
    assert turned == sorted(turned) and bytes(bwt) == bytes(t[-1] for t in turned)
    assert [int(order[k]) for k in lf] == [(int(p) - 1) % len(text) for p in order]


def test_stage_keeps_columns_and_order_of_text(spark):
    rows = collection()
    docs = documents(spark, rows)
    out = suffixes.drop_repeated_bytes(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[10] == "" and left[8] == "short" and left[6] is None
    assert suffixes.drop_repeated_bytes(docs.limit(0)).count() == 0 and suffixes.removal_report(docs.limit(0)).count() == 0
