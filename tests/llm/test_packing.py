import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelwright.llm import packing
from panelwright.llm.queries import vocabulary
from panelwright.llm.tables import importable

TEXTS = ["", " ", "a", "a  b", " a b ", "x\n y\t z", "it's 12 o'clock", "abc abc", "naïve   café", "<|endoftext|> end",
         "one two one two one", "word " * 3000, "漢字 かな", "a\x1c b"]


def plain(texts):
    own = packing.tokenizer(vocabulary())
    return [own.encode(t, add_special_tokens=False).ids for t in texts]


def split(ids, ends):
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_cached_encoding_equals_the_tokenizer():
    encoder = packing.Encoder(vocabulary(), cached=5)
    for _ in range(2):
        assert split(*encoder.encode(TEXTS)) == plain(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n\t.'é ", max_size=30), min_size=1, max_size=5))
def test_cached_encoding_equals_the_tokenizer_on_odd_spacing(texts):
    assert split(*packing.Encoder(vocabulary()).encode(texts)) == plain(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_piece_lengths_are_powers_of_two(n):
    pieces = packing.piece_lengths(n)
    assert sum(pieces) == n and all(x & (x - 1) == 0 and x <= 1024 for x in pieces) and pieces == sorted(pieces, reverse=True)


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])] + [(0, ""), (None, "a b")]
    importable(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS length", "1 AS ids").repartition(3)
    out = packing.pack(docs, vocabulary(), with_ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    assert all(r.length == len(r.ids) == 1 << r.bucket for r in out)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
    for i, ids in enumerate(plain([t or "" for _, t in rows[: len(TEXTS) + 1]])):
        if i:
            own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
            assert [x for r in own for x in r.ids] == [*ids, 0] and {r.doc_tokens for r in own} == {len(ids) + 1}
    assert [r.length for r in out if r.doc_id == 0] == [1, 1]
    by_bucket = sorted(out, key=lambda r: r.sequence_id)
    assert [r.bucket for r in by_bucket] == sorted(r.bucket for r in out)
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_a_full_cache_keeps_what_is_met_often():
    encoder = packing.Encoder(vocabulary(), cached=20)
    for i in range(30):
        texts = ["the of and the of and " + " ".join(f"w{i}x{j}" for j in range(15))]
        assert split(*encoder.encode(texts)) == plain(texts)
        assert encoder.n == len(encoder.known) <= 20 + 18
        assert {"the", "of", "and"} <= encoder.known.keys()
    encoder._forget()
    assert {"the", "of", "and"} <= encoder.known.keys() and len(encoder.known) <= 10


def test_an_empty_batch_gives_no_rows(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    empty = packing.pa.RecordBatch.from_pydict({"doc_id": packing.pa.array([], "int64"), "text": packing.pa.array([], "string")})
    assert list(packing._pieces(vocabulary(), 1024, False)([empty])) == []
