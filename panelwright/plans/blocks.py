"""Ordered computations over panels whose groups may be far larger than one task.

A plain ``Window.partitionBy(group).orderBy(time)`` sends a whole group to one task. Here a
group is cut along its order into blocks of about ``block_rows`` rows:

1. count rows per (group, cell), where a cell is a fixed stretch of the order column
   (map-side combined, reads only the key and the order column);
2. running sums over those counts give every cell its start position in the group, its block
   and the neighbouring blocks that need it as context (``before`` / ``after`` rows);
3. rows pick up that information by (group, cell) and are copied to the blocks that need
   them; one shuffle on (group, block) then serves every window, and context rows are
   dropped at the end.

The result is the same as with the plain window; position and size of the group come for
free. Values carried over arbitrarily long stretches (forward / backward fill) travel in the
cell table as the last / first non-null value of earlier / later cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.session import cut_lineage
from panelwright.spec import PanelSpec, order_value, unit_of

# A cell table is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000

_BLOCK, _OWN, _START, _SIZE = "_block", "_own", "_cell_start", "_group_rows"
_POS = "_pos"
_CELL = "_cell"


class BlockFrame:
    """Window specifications and helper columns offered to a feature."""

    def __init__(self, spec: PanelSpec):
        self.spec = spec
        self.partition = [F.col(c) for c in (*spec.groups, _BLOCK)]
        self.pos = F.col(_POS)  # 1-based position in the group
        self.size = F.col(_SIZE)  # rows in the group
        self.own = F.col(_OWN)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.spec.order)

    @property
    def reversed(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*[F.desc(c) for c in self.spec.order])

    def trailing(self, rows: int) -> WindowSpec:
        """The current row and the ``rows - 1`` before it."""
        return self.ordered.rowsBetween(-(rows - 1), 0)

    def running(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def last_value(self, name: str) -> Column:
        """Last non-null value of ``name`` at or before this row (needs ``carry_last``)."""
        seen = F.last(name, ignorenulls=True).over(self.running())
        return F.coalesce(seen, F.first(_carry_last(name)).over(self.running()))

    def next_value(self, name: str) -> Column:
        """First non-null value of ``name`` at or after this row (needs ``carry_next``)."""
        w = self.reversed.rowsBetween(Window.unboundedPreceding, 0)
        return F.coalesce(F.last(name, ignorenulls=True).over(w), F.first(_carry_next(name)).over(w))

    def first_value(self, name: str) -> Column:
        """Value of ``name`` in the first row of the group, null included (needs
        ``carry_first``)."""
        return F.col(_carry_first(name))


@dataclass(frozen=True)
class Feature:
    """Columns computed along the order of a group.

    ``before`` / ``after``: how many neighbouring rows a row's value depends on.
    ``carry_last`` / ``carry_next`` / ``carry_first``: columns used through ``last_value`` /
    ``next_value`` / ``first_value``.
    """

    build: Callable[[DataFrame, BlockFrame], DataFrame]
    before: int = 0
    after: int = 0
    carry_last: Sequence[str] = field(default_factory=tuple)
    carry_next: Sequence[str] = field(default_factory=tuple)
    carry_first: Sequence[str] = field(default_factory=tuple)


@dataclass(frozen=True)
class CellTable:
    """Rows per (group, cell); ``width`` and ``tie_width`` are the size of its cells, ``rows`` its
    own size if it has been counted."""

    table: DataFrame
    width: int
    tie_width: int | None = None
    rows: int | None = None


def _carry_last(name: str) -> str:
    return f"_carry_last_{name}"


def _carry_next(name: str) -> str:
    return f"_carry_next_{name}"


def _carry_first(name: str) -> str:
    return f"_carry_first_{name}"


def _edge(name: str, spec: PanelSpec, newest: bool) -> Column:
    order = F.col(spec.time) if not spec.tiebreak else F.struct(*spec.order)
    by = F.when(F.col(name).isNotNull(), order)
    return (F.max_by if newest else F.min_by)(F.col(name), by)


DAYS = 4096  # width of a cell, in days, where nothing tells more


def count_cells(
    df: DataFrame, spec: PanelSpec, features: Sequence[Feature] = (), width: int | None = None, tie_width: int | None = None
) -> CellTable:
    """Cell table of a panel, lazily. Carried columns bring their edge values along."""
    width = width or spec.width(df) or DAYS * 86400 * unit_of(df, spec.time)
    last = sorted({c for f in features for c in f.carry_last})
    nxt = sorted({c for f in features for c in f.carry_next})
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [_edge(c, spec, True).alias(_carry_last(c)) for c in last]
    aggs += [_edge(c, spec, False).alias(_carry_next(c)) for c in nxt]
    first = sorted({c for f in features for c in f.carry_first})
    order = F.col(spec.time) if not spec.tiebreak else F.struct(*spec.order)
    aggs += [F.min_by(F.col(c), order).alias(_carry_first(c)) for c in first]
    cells = df.withColumn(_CELL, spec.cell_of(df, width, tie_width)).groupBy(*spec.groups, _CELL).agg(*aggs)
    return CellTable(cells, width, tie_width)


def _spread(df: DataFrame, value: Column, spec: PanelSpec) -> int:
    """Width at which evenly spread values would fill a quarter of a block per cell."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    return max(1, (high - low + 1) * spec.block_rows // (4 * n)) if n else 1


def fit_cells(df: DataFrame, spec: PanelSpec, features: Sequence[Feature] = ()) -> CellTable:
    """Cell table written once to the shared folder and counted, so that its size is known
    and small ones can be broadcast (the panel is then shuffled once, not twice). Where a cell
    holds more than a block, cells are narrowed and counted again: by time down to one unit,
    then by an integer tiebreak. Rows without a time are one moment."""
    width, tie_width = spec.width(df) or _spread(df, order_value(df, spec.time), spec), None
    narrower = lambda now, widest: max(1, now * spec.block_rows // (2 * widest))
    while True:
        cells = count_cells(df, spec, features, width, tie_width)
        table = cut_lineage(cells.table)
        moment = F.col(f"{_CELL}.time") if tie_width else F.col(_CELL)
        rows, widest, timeless = table.agg(
            F.count(F.lit(1)), F.max(F.when(moment.isNotNull(), F.col("_rows"))), F.max(F.when(moment.isNull(), F.col("_rows")))
        ).first()
        widest, timeless = widest or 0, timeless or 0
        if max(widest, timeless) <= spec.block_rows:
            break
        if widest > spec.block_rows and width > 1:
            width = narrower(width, widest)
        elif spec.tie(df) and tie_width is None:
            tie_width = _spread(df, F.col(spec.tie(df)).cast("long"), spec)
        elif tie_width and tie_width > 1:
            tie_width = narrower(tie_width, max(widest, timeless))
        else:
            break
    return replace(cells, table=table, rows=rows)


def _placed_cells(cells: CellTable, spec: PanelSpec, before: int, after: int) -> DataFrame:
    """Start position, group size, block and target blocks of every cell."""
    group = Window.partitionBy(*spec.groups)
    order = group.orderBy(_CELL)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(F.desc(_CELL)).rowsBetween(Window.unboundedPreceding, -1)
    size = F.lit(spec.block_rows)

    def block_of(position: Column) -> Column:
        return F.floor(position / size).cast("long")

    carried = []
    for name in cells.table.columns:
        if name.startswith("_carry_last_"):
            carried.append(F.last(name, ignorenulls=True).over(earlier).alias(name))
        elif name.startswith("_carry_next_"):
            carried.append(F.last(name, ignorenulls=True).over(later).alias(name))
        elif name.startswith("_carry_first_"):
            carried.append(F.first(name).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    counted = cells.table.select(
        *spec.groups,
        _CELL,
        "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).cast("long").alias(_START),
        F.sum("_rows").over(group).alias(_SIZE),
        (F.max("_rows").over(group) if after else F.lit(0)).alias("_widest"),
        *carried,
    )
    home = block_of(F.col(_START))
    first, last = home, home
    if after:
        # a block may end up to one cell beyond its nominal end
        first = block_of(F.greatest(F.col(_START) - F.col("_widest") - after, F.lit(0)))
    if before:
        reach = block_of(F.col(_START) + F.col("_rows") + F.lit(before - 1))
        last = F.greatest(home, F.least(reach, block_of(F.col(_SIZE) - 1)))
    return counted.select(*counted.columns, home.alias("_home"), F.sequence(first, last).alias("_to")).drop("_widest")


def spread_blocks(
    df: DataFrame,
    spec: PanelSpec,
    before: int = 0,
    after: int = 0,
    features: Sequence[Feature] = (),
    cells: CellTable | None = None,
    tail: int | None = None,
) -> DataFrame:
    """The panel's rows in their blocks, each block with up to ``before`` and ``after`` rows of its
    neighbours: ``_own`` tells the block's own rows, ``_pos`` the position in the group and
    ``_group_rows`` its size. Rows are partitioned by group and block and come in order."""
    cells = cells or (fit_cells if spec.count_first else count_cells)(df, spec, features)
    placed = _placed_cells(cells, spec, before, after)
    if tail is not None:
        placed = placed.filter(F.col(_START) + F.col("_rows") > F.col(_SIZE) - (tail + before))
    placed = placed.drop("_rows")
    key_names = [*spec.groups, _CELL]
    kept = [c for c in placed.columns if c not in key_names]
    placed = placed.select(*[F.col(k).alias(f"_on_{k}") for k in key_names], *kept)
    if cells.rows is not None and cells.rows <= BROADCAST_ROWS:
        placed = F.broadcast(placed)

    rows = df.withColumn(_CELL, spec.cell_of(df, cells.width, cells.tie_width))
    match = reduce(and_, [rows[k].eqNullSafe(placed[f"_on_{k}"]) for k in key_names])
    extra = [c for c in kept if c not in ("_to", "_home")]
    spread = rows.join(placed, match, "inner").select(*df.columns, *extra, "_home", F.explode("_to").alias(_BLOCK))

    frame = BlockFrame(spec)
    position = F.first(_START).over(frame.running()) + F.row_number().over(frame.ordered)
    return spread.withColumns({_OWN: F.col(_BLOCK) == F.col("_home"), _POS: position.cast("long")})


def over_blocks(
    df: DataFrame,
    spec: PanelSpec,
    *features: Feature,
    cells: CellTable | None = None,
    keep_position: bool = False,
    tail: int | None = None,
) -> DataFrame:
    """Run all ``features`` in one block pass and return the panel with their columns.

    ``keep_position`` keeps ``_pos`` (1-based) and ``_group_rows``. ``tail`` asks for the last
    rows of every group only: older cells are dropped before the shuffle (rows just before
    the tail may remain, filter on the position)."""
    before = max((f.before for f in features), default=0)
    after = max((f.after for f in features), default=0)
    frame = BlockFrame(spec)
    out = spread_blocks(df, spec, before, after, features, cells, tail)
    for f in features:
        out = f.build(out, frame)
    inner = {_BLOCK, _OWN, _START, "_home", *([] if keep_position else [_POS, _SIZE])}
    return out.filter(_OWN).select(*[c for c in out.columns if c not in inner and not c.startswith("_carry_")])


def with_position(df: DataFrame, spec: PanelSpec, cells: CellTable | None = None) -> DataFrame:
    """Adds ``_pos`` (1-based order position) and ``_group_rows`` to every row."""
    return over_blocks(df, spec, cells=cells, keep_position=True)
