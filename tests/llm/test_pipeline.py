import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__  # noqa: E402
import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402
from panelwright.llm import queries  # noqa: E402
from panelwright.llm.tables import components, numbered, table, written  # noqa: E402


def test_registered():
    names = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert names == {f"op{k}" for k in range(1, 14)} and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    n, wrong = check_oracle.compare(spark, check_oracle.connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name])
    assert not wrong and n > 0


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > 0.8 * sizes[0] and sizes[3] <= sizes[2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= sizes[4]
    empty = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 2), (20, 21), (21, 22), (22, 23), (23, 24), (24, 11)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys((10, 11, 20, 21, 22, 23, 24), 10)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS x").repartition(5)
    assert all(r.x == r.n for r in numbered(df, "n", "x").collect())
