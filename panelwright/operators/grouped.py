"""A user's own function over the ordered rows of every group.

The function sees one block of a group at a time, with the context rows it asked for, so a group
of any length never meets in one task. It may be combined with the library's own features in one
ordered pass.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.plans.blocks import BlockFrame, CellTable, Feature, over_blocks
from panelwright.session import importable
from panelwright.spec import PanelSpec, require_columns


def block_function(fn: Callable[[pd.DataFrame], pd.DataFrame], returns: str, inputs: list[str], before: int = 0, after: int = 0) -> Feature:
    """Columns by ``fn``, which gets the ``inputs`` of consecutive rows of one group, in order, as a
    pandas frame and returns the columns of ``returns`` (``"name type, ..."``) for all of them.

    A row's result may depend on ``before`` rows before it and ``after`` rows behind it: a block
    comes with at least so many rows of its neighbours, and what the function says about those is
    dropped. At a group's ends there are fewer."""
    new = T.StructType.fromDDL(returns)

    def build(d: DataFrame, w: BlockFrame) -> DataFrame:
        require_columns(d, *inputs)
        importable(d.sparkSession)
        order = [(c, "ascending") for c in w.spec.order]
        clash = sorted(set(new.names) & set(d.columns))
        if clash:
            raise ValueError(f"the panel already has columns {clash}")
        kinds = [to_arrow_type(f.dataType) for f in new.fields]

        def run(block: pa.Table) -> pa.Table:
            block = block.take(pc.sort_indices(block, sort_keys=order, null_placement="at_start"))
            found = fn(block.select(inputs).to_pandas())
            missing = [n for n in new.names if n not in found]
            if missing or len(found) != block.num_rows:
                raise ValueError(f"the function must return {new.names} for all {block.num_rows} rows, not {list(found)} for {len(found)}")
            for name, kind in zip(new.names, kinds, strict=True):
                block = block.append_column(name, pa.Array.from_pandas(found[name], type=kind))
            return block

        schema = T.StructType([*d.schema.fields, *new.fields])
        return d.groupBy(*w.partition).applyInArrow(run, schema)

    return Feature(build, before=before, after=after)


def apply_by_group(
    df: DataFrame,
    spec: PanelSpec,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    returns: str,
    inputs: list[str],
    before: int = 0,
    after: int = 0,
    cells: CellTable | None = None,
) -> DataFrame:
    """The panel with the columns that ``fn`` computes along the order of each group."""
    return over_blocks(df, spec, block_function(fn, returns, inputs, before, after), cells=cells)
