"""What may depend on what, and what the registered queries promise."""

import ast
import pathlib

import pytest

from panelwright import catalog

ROOT = pathlib.Path(__file__).resolve().parent.parent / "panelwright"


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def library():
    """All modules but the text operators, which have tests of their own."""
    return [p for p in sorted(ROOT.rglob("*.py")) if p.relative_to(ROOT).parts[0] != "llm"]


def files(*folders):
    return [p for f in folders for p in sorted((ROOT / f).glob("*.py"))]


@pytest.mark.parametrize("path", files("plans", "functions"), ids=lambda p: p.stem)
def test_lower_layers_do_not_know_the_operators(path):
    assert not [m for m in imports(path) if m.startswith(("panelwright.operators", "panelwright.sources", "panelwright.catalog"))]


@pytest.mark.parametrize(
    "path", [p for p in files("operators") if p.stem not in ("sales", "experiments")], ids=lambda p: p.stem
)
def test_generic_operators_do_not_know_the_sales_domain(path):
    assert "panelwright.operators.sales" not in list(imports(path))


def test_library_needs_no_other_engine():
    used = {m.split(".")[0] for p in library() for m in imports(p)} - ARROW
    assert used <= {"__future__", "atexit", "collections", "dataclasses", "datetime", "functools", "json", "math", "operator", "os", "posixpath", "re",
                    "shutil", "tempfile", "time", "urllib", "uuid", "panelwright", "pyspark"}


#: Blocks of rows reach Python as Arrow tables; what is computed on them needs these.
ARROW = {"numpy", "pandas", "pyarrow"}
ON_BLOCKS = {"operators/grouped.py", "operators/least_squares.py", "operators/forecast.py", "catalog/forecasts.py"}


def test_arrow_is_used_on_blocks_only():
    users = {str(p.relative_to(ROOT)) for p in library() if ARROW & {m.split(".")[0] for m in imports(p)}}
    assert users <= ON_BLOCKS


def test_nothing_in_the_library_imports_the_text_operators():
    assert not [p for p in library() if any(m.startswith("panelwright.llm") for m in imports(p))]


def test_no_row_wise_python_and_no_local_checkpoints():
    text = "\n".join(p.read_text() for p in library())
    for word in ("localCheckpoint", "F.udf", "pandas_udf", ".rdd", "crossJoin", "toPandas"):
        assert word not in text


def test_every_query_has_its_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
    assert not [n for n in catalog.queries() if "pipeline" in n or n.startswith("op")]


def test_every_operator_is_registered():
    ids = {n.split("_")[0] for n in catalog.queries()}
    want = {f"a{i}" for i in range(1, 18)} | {f"b{i}" for i in range(1, 16)} | {f"c{i}" for i in range(1, 6)}
    want |= {f"d{i}" for i in range(1, 18)} - {"d2"} | {f"d2{x}" for x in "abcde"} | {f"e{i}" for i in range(1, 18)}
    want |= {f"f{i}" for i in range(1, 5)} | {f"g{i}" for i in range(1, 4)} | {f"h{i}" for i in range(1, 25)}
    want |= {f"i{i}" for i in range(1, 13)}
    assert sorted(want - ids) == []
