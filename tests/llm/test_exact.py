import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from panelwright.llm import exact
from panelwright.llm.tables import importable

ROWS = [(3, "ab c"), (1, "a b c"), (2, "abc  "), (9, None), (4, ""), (5, " \n"), (5, " \n"), (6, "Abc"), (None, "q r"), (7, "qr"),
        (None, "q  r"), (8, "x" * 100_000), (10, "a bc"), (11, "x" * 99_999 + " x")]


def documents(spark, rows=ROWS):
    importable(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'d' AS digest", "1 AS kept", "2 AS _best", "3 AS row")
    return docs.repartition(4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_index_holds_what_a_dictionary_holds(changes):
    index, held = exact.CuckooIndex(buckets=2), {}
    for add, n in changes:
        key = hashlib.sha256(str(n).encode()).digest()
        if add and key not in held:
            index.insert(key, n)
            held[key] = n
        elif not add:
            assert index.delete(key) == (key in held)
            held.pop(key, None)
    assert dict(index.items()) == held and index.size == len(held)
    assert all(index.get(k) == v for k, v in held.items()) and index.get(hashlib.sha256(b"other").digest()) is None


def test_overflow_resizes_from_stored_keys():
    index = exact.CuckooIndex(buckets=1)
    keys = [hashlib.sha256(str(n).encode()).digest() for n in range(5000)]
    for k in keys:
        index.insert(k, k)
    assert index.mask + 1 >= 5000 / exact.SLOTS and all(index.get(k) == k for k in keys)


def test_every_row_learns_which_row_stays(spark):
    got = exact.copy_groups(documents(spark)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = {hashlib.sha256(t.encode()).hexdigest(): (min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(g)) for t, g in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_stage_keeps_one_row_of_each_group(spark):
    docs = documents(spark)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(left) == 6 and (1, "a b c") in left and (8, "x" * 100_000) not in left and (11, "x" * 99_999 + " x") in left
    assert sum(1 for i, t in left if not (t or "").strip()) == 1
    assert exact.drop_copies(docs.limit(0)).count() == 0 and exact.copy_groups(docs.limit(0)).count() == 0
