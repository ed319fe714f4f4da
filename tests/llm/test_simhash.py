import random

import numpy as np
import pytest
import xxhash
from panelwright.llm import simhash
from panelwright.llm.tables import importable


def brute_print(text, width=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def documents(spark, rows):
    importable(spark)
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' AS fp", "1 AS id", "2 AS checks", "3 AS _lost").repartition(3)


def edited(rng, words, share):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("block", [4, simhash.BLOCK])
def test_groups_equal_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(1000, None), (4, ""), (5, " \n"), (6, "one"), (7, "One two"), (8, "one two"), (None, "É a b c"), (9, "é a b c"), (10, "a " * 20_000)]
    for k in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 4, 30, 200]))]
        rows += [(20 + 10 * k + n, edited(rng, words, 0.01 if n else 0)) for n in range(6)]
    rows += rows[-3:]
    got = simhash.near_groups(documents(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    prints = [int(r.fingerprint, 16) for r in got]
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    assert prints == [brute_print(text[r.doc_id]) for r in got]
    group = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    for k, r in enumerate(got):
        ids = [x.doc_id for x, g in zip(got, group, strict=True) if g == group[k] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 8, 11])
@pytest.mark.parametrize("n", [100, 10**5, 10**9])
def test_parts_find_every_pair_within_the_radius(radius, n):
    rng = np.random.default_rng(radius)
    p = rng.uniform(0.3, 0.7, 64)
    parts = simhash.allocate(np.outer(p, p) * n + np.diag(p - p * p) * n, n, radius)
    assert sum(t + 1 for _, t in parts) >= radius + 1 and len({b for bits, _ in parts for b in bits}) == sum(len(b) for b, _ in parts)
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, radius, replace=False))
        assert any({(a ^ f) & sum(1 << x for x in bits) for f in simhash.flips(bits, t)} & {(b ^ f) & sum(1 << x for x in bits) for f in simhash.flips(bits, t)} for bits, t in parts)


def shingles(text):
    words = simhash.words_of(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("few", [1, simhash.FEW])
def test_stage_links_by_similarity_of_shingle_sets(spark, few):
    rng = random.Random(7)
    rows = [(900, None), (901, "")]
    for k in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(50 * k + n, edited(rng, words, 0 if n == 0 else rng.choice([0.003, 0.01, 0.08]))) for n in range(9)]
    docs = documents(spark, rows + rows[:2])
    kept = simhash.drop_near_copies(docs, few=few)
    assert kept.columns == docs.columns
    sets = [shingles(t) for _, t in rows]
    group = brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    assert kept.filter("doc_id = 900").count() == 2  # repeated rows stay or go together


def test_texts_that_share_one_frequent_shingle_are_compared(spark):
    rng = random.Random(11)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(4)]
    rows = [(k, own[k] + " pad" * 260) for k in range(3)]
    rows += [(10, own[3] + " pad" * 260), (11, own[3] + " pad" * 300), (12, own[3] + " pad" * 9)]  # equal sets
    kept = simhash.drop_near_copies(documents(spark, rows))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {0, 1, 2, 10}


def changed(rng, kind, words):
    new = [f"v{rng.randrange(10**6)}" for _ in range(72)]
    if kind == "block":
        n, at = rng.randint(19, 28), rng.randrange(40, 200)
        return words[:at] + new[:n] + words[at + n :]
    return words + new[: rng.randint(50, 72)] if kind == "appended" else words[: -rng.randint(42, 58)]


@pytest.mark.parametrize("few", [1, simhash.FEW])
def test_recall_of_block_append_and_truncation_pairs(spark, few):
    rng, rows, kinds = random.Random(5), [], ("block", "appended", "truncated")
    for k in range(450):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed(rng, kinds[k % 3], words)))]
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        a, b = shingles(a[1]), shingles(b[1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.87
    kept = {r.doc_id for r in simhash.drop_near_copies(documents(spark, rows), few=few).select("doc_id").collect()}
    assert kept >= {i for i, _ in rows[::2]}
    found = {kind: sum(2 * k + 1 not in kept for k in range(j, 450, 3)) / 150 for j, kind in enumerate(kinds)}
    print(few, found)
    assert min(found.values()) >= 0.95


def test_a_group_of_candidates_costs_its_rows_not_its_pairs(spark, monkeypatch):
    rng, rows, counted, write = random.Random(13), [], {}, simhash.written
    words = [f"w{k}" for k in range(3000)]
    for k in range(60):  # every two are candidates, and no two are similar enough
        at = set(rng.sample(range(3000), 39))
        rows.append((k, " ".join(f"{k}x{i}" if i in at else w for i, w in enumerate(words))))
    sets = [shingles(t) for _, t in rows]
    assert all(0.75 < len(a & b) / len(a | b) < 0.8 for k, a in enumerate(sets) for b in sets[:k])

    def counting(df, name):
        out = write(df, name)
        counted[name] = max(counted.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counting)
    assert simhash.drop_near_copies(documents(spark, rows)).count() == 60
    assert max(counted.values()) <= 5 * 60, counted


def test_candidate_groups_in_blocks(spark):
    rng, rows = random.Random(17), [(500, None)]
    for k in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(50 * k + n, edited(rng, words, 0 if n == 0 else rng.choice([0.003, 0.01, 0.08]))) for n in range(20)]
    sets = [shingles(t) for _, t in rows]
    group = brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    for kw in ({"block": 4}, {"shingles": 500}):
        assert {r.doc_id for r in simhash.drop_near_copies(documents(spark, rows), **kw).select("doc_id").collect()} == want


def test_empty_table(spark):
    docs = documents(spark, [(1, "a")]).limit(0)
    assert simhash.near_groups(docs).count() == 0 and simhash.drop_near_copies(docs).count() == 0
