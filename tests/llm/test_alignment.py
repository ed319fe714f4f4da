import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelwright.llm import alignment
from panelwright.llm.queries import op11_cross_tokenizer, vocabulary
from panelwright.llm.tables import importable

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [None, "", " ", "a", "a  b", " a b ", "x\n y\t z", "it's 12 o'clock", "abc abc", "naïve   café", "<|endoftext|> </s> <0x41>", "word " * 500,
         "漢字 かな \U0001f600", "a\x1c b", "one▁two", "▁", "the end the end", "\x00 zero", "x" * 300, "<unk> <s>", "á ​ b c"]


def plain_tokens(text):
    """Tokens by the two libraries, whole text at once, with byte ranges from a plain loop."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not text:
        return None
    own = plain_tokens.__dict__
    if "a" not in own:
        own["a"] = Tokenizer.from_file(public_tokenizers.path(FIRST))
        own["a"].encode_special_tokens = True
        own["b"] = SentencePieceProcessor(model_file=public_tokenizers.path(SECOND))
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        own["of"], k = {chr(b): b for b in keep}, 0
        for b in range(256):
            if b not in keep:
                own["of"][chr(256 + k)] = b
                k += 1
    a = [(i, bytes(own["of"][c] for c in own["a"].id_to_token(i))) for i in own["a"].encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in own["b"].encode(text):
        piece = own["b"].id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if own["b"].is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    out = []
    for side in (a, b):
        at, ranges = 0, []
        for i, x in side:
            ranges.append((i, at, at + len(x)))
            at += len(x)
        out.append(ranges)
    return out


def brute(rows):
    tokens = [(d, plain_tokens(t)) for d, t in rows]
    links, count = [], Counter()
    for _, pair in tokens:
        own = [(i, j) for i, a0, a1 in pair[0] for j, b0, b1 in pair[1] if a0 < b1 and b0 < a1] if pair else []
        links.append(own)
        count.update(own)
    best = {}
    for (_, j), c in count.items():
        best[j] = max(best.get(j, 0), c)
    out = []
    for (d, pair), own in zip(tokens, links, strict=True):
        if not pair:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = pair
        stops = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for stop in stops:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= stop) for side in (a, b)))
            start = stop
        spelt = ";".join(groups)
        out.append((d, len(a), len(b), len(groups), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own),
                    hashlib.sha256(spelt.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    importable(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS links", "2 AS pair", "3 AS `a.b`")
    return sorted((tuple(r) for r in alignment.align(docs.repartition(parts), vocabulary(FIRST), vocabulary(SECOND)).collect()), key=str)


@pytest.mark.parametrize("block", [None, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "the end"), (None, None), (7, "abc abc")]
    if block:
        monkeypatch.setattr(alignment, "BLOCK", block)
    assert found(spark, rows) == brute(rows)


def test_query_equals_brute_force_on_given_documents(spark, sf):
    got = sorted((tuple(r) for r in op11_cross_tokenizer(spark, sf).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    short = {d for d, _ in rows}
    # the brute force looks at all pairs of tokens, so long texts are left to the test of groups below
    mine = {r[0]: (*r[1:5], r[7]) for r in got if r[0] in short}
    assert mine == {r[0]: (*r[1:5], r[7]) for r in brute(rows)}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n\t.'é▁<0x4>漢", max_size=30), min_size=1, max_size=5))
def test_cached_encoding_equals_the_tokenizers(texts):
    encoder = alignment.Encoder(vocabulary(FIRST), vocabulary(SECOND), cached=3)
    for _ in range(2):
        sides = encoder.encode(texts)
        for k, (doc, ids, sizes) in enumerate(sides):
            for d, text in enumerate(texts):
                want = plain_tokens(text)
                assert ids[doc == d].tolist() == ([i for i, *_ in want[k]] if want else [])
                assert sizes[doc == d].tolist() == ([e - s for _, s, e in want[k]] if want else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([(1, 0), (0, 1), (1, 1), (0, 0)]), max_size=60))
def test_pointer_jumping_equals_a_scan(marks):
    marks = [*marks, (1, 1)]
    ends = [np.array([k + 1 for k, m in enumerate(marks) if m[side]]) for side in (0, 1)]
    a, b, of_a, of_b = alignment.groups(*ends)
    both = sorted(set(ends[0]) & set(ends[1]))
    assert a.tolist() == [next(k for k, s in enumerate(both) if e <= s) for e in ends[0]]
    assert b.tolist() == [next(k for k, s in enumerate(both) if e <= s) for e in ends[1]]
    begin = [[0, *e[:-1]] for e in ends]
    want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if begin[0][i] < ends[1][j] and begin[1][j] < ends[0][i]]
    assert sorted(zip(of_a.tolist(), of_b.tolist(), strict=True)) == want


def test_groups_are_given(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(docs, vocabulary(FIRST), vocabulary(SECOND), with_groups=True).collect()}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256 and got[2].groups == got[2].groups_sha256 == ""


def test_empty_table(spark):
    assert found(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
    importable(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, vocabulary(FIRST), vocabulary(SECOND)).count() == 0
