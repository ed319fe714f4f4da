import pytest
from panelwright.llm import mixing

ROWS = [(1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (4, "x " * 50, "s2"), (5, "one", None), (5, "one", None),
        (None, "p q", "s3"), (6, "w " * 7, "s3"), (7, " ", "é"), (8, " \t\n", "zero")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS size", "'k' AS Target", "2.5 AS rate", "true AS _rate", "0 AS copies"
    )


def level(sizes, weights, share=1.5, limit=2.0):
    """Brute force: give out words in small steps of the water level."""
    low, high = 0.0, 2.0 * max(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(limit * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < share * sum(sizes):
            low = mid
        else:
            high = mid
    return [min(limit * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_targets_fill_up_by_weight(spark):
    got = {r.source: r for r in mixing.source_targets(mixing.sizes(documents(spark))).collect()}
    order = ["s1", "s2", "s3", "zero", "é", None]
    sizes = [3, 50, 9, 0, 1, 2]
    assert [got[s].source_size for s in order] == sizes
    assert [got[s].target for s in order] == pytest.approx(level(sizes, [3, 1, 2, 3, 1, 2]), abs=1e-6)
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * sum(sizes))


def test_documents_are_taken_whole_and_alike_each_time(spark):
    first, second = (sorted(mixing.mixed_sizes(documents(spark)).collect(), key=str) for _ in range(2))
    assert first == second and len(first) == len(ROWS)
    for r in first:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert len({r.copies for r in first if r.doc_id == 5}) == 1


def test_mix_repeats_rows_with_their_columns(spark):
    docs = documents(spark)
    out, sizes = mixing.mix(docs), mixing.mixed_sizes(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in sizes.collect())


def test_every_source_comes_near_its_target(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed_sizes(docs).groupBy(*["target", "source_size"]).agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 0.1 * r.target for r in rows)


def test_empty_tables(spark):
    docs = documents(spark).limit(0)
    assert mixing.mixed_sizes(docs).count() == 0 and mixing.mix(docs).count() == 0
    blank = documents(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in mixing.mixed_sizes(blank).collect()] == [0, 0]
