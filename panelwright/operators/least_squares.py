"""Linear forecasters fitted in one pass over the ordered blocks of a panel.

A window of the last rows is a row of the design matrix, so neighbouring windows share all but one
of their rows. Here no window is built: each task lays a strided view over the rows of its blocks
and adds up the products of all columns (inputs, category marks, a one, and every target at every
horizon). These sums merge; their total, whose size depends on the model only, answers everything
that is asked afterwards: the least-squares solution for all targets at once, the loss on held-out
rows, and gradient steps that stop when that loss does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.plans.blocks import spread_blocks
from panelwright.session import importable
from panelwright.spec import PanelSpec

#: Singular directions of the (scaled) products are left out below this share of the largest.
RANK = 1e-12


@dataclass(frozen=True)
class Design:
    """What a forecast is made of: the columns of the window, its length, the columns with
    category codes and how many categories each has. A code outside (an unseen category) or null
    marks none."""

    columns: tuple[str, ...]
    length: int
    codes: tuple[str, ...] = ()
    sizes: tuple[int, ...] = ()

    @property
    def inputs(self) -> int:
        return len(self.columns) * self.length

    @property
    def width(self) -> int:
        """Inputs, category marks and the one of the intercept."""
        return self.inputs + sum(self.sizes) + 1


def _complete(batches, before: int):
    """Batches as tables, each after the last ``before`` rows of those before it."""
    held = None
    for batch in batches:
        if batch.num_rows:
            new = pa.Table.from_batches([batch])
            whole = new if held is None else pa.concat_tables([held, new])
            yield whole, whole.num_rows - new.num_rows
            held = whole.slice(max(0, whole.num_rows - before))


def _numbers(table: pa.Table, columns, missing: float = 0.0) -> np.ndarray:
    out = np.empty((table.num_rows, len(columns)))
    for k, c in enumerate(columns):
        values = table.column(c)
        out[:, k] = (values.fill_null(missing) if values.null_count else values).to_numpy()
    return out


def _windows(table: pa.Table, design: Design, first: int):
    """(rows that end a window, their inputs as a view, their category codes). Only a block's own
    rows end windows here; the rows before them, its context included, stand directly before."""
    own = table.column("_own").to_numpy() & (table.column("_pos").to_numpy() >= design.length)
    own &= table.column("_group_rows").to_numpy() > design.length
    own[: max(first, design.length - 1)] = False
    at = np.flatnonzero(own)
    values = _numbers(table, design.columns)
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(values, design.length, axis=0)  # (row, column, step)
        inputs = view[at - (design.length - 1)].transpose(0, 2, 1).reshape(len(at), design.inputs)
    else:
        inputs = np.zeros((0, design.inputs))
    codes = _numbers(table, design.codes, -1.0).astype(np.int64)[at]
    return at, inputs, codes


def _laid_out(df: DataFrame, spec: PanelSpec, design: Design, kept: list[str]) -> DataFrame:
    """The rows in their blocks with what a window needs, in order. A group with no more rows than
    a window has none."""
    used = list(dict.fromkeys([*spec.groups, *spec.order, *design.columns, *design.codes, *kept]))
    spread = spread_blocks(df.select(*used), spec, before=design.length - 1)
    numbers = {c: F.col(c).cast("double") for c in (*design.columns, *design.codes)}
    order = [*spec.groups, "_block", *spec.order]
    return spread.withColumns(numbers).select(*used, "_block", "_own", "_pos", "_group_rows").sortWithinPartitions(*order)


@dataclass(frozen=True)
class Moments:
    """Sums of products of the design's columns and the targets, over ``n`` rows."""

    design: Design
    targets: tuple[str, ...]
    products: np.ndarray

    @property
    def n(self) -> int:
        return round(self.products[self.design.width - 1, self.design.width - 1])

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.design, self.targets, self.products + other.products)

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Covariances of the inputs, of inputs and targets, and the means of both."""
        one = self.design.width - 1
        means = self.products[one] / self.n
        rest = np.delete(np.arange(len(means)), one)
        spread = self.products[np.ix_(rest, rest)] / self.n - np.outer(means[rest], means[rest])
        return spread[:one, :one], spread[:one, one:], means[:one], means[one + 1 :]

    def solved(self) -> np.ndarray:
        """Least-squares weights (width, targets); of several solutions the smallest."""
        inner, cross, x, y = self.centred()
        scale = np.sqrt(np.maximum(np.diag(inner), 0))
        scale[scale == 0] = 1.0
        b = np.linalg.lstsq(inner / np.outer(scale, scale), cross / scale[:, None], rcond=RANK)[0] / scale[:, None]
        return np.vstack([b, y - x @ b])

    def loss(self, weights: np.ndarray) -> float:
        """Mean squared error over all targets."""
        w, p = self.design.width, self.products
        own = np.einsum("ij,ij->", weights, p[:w, :w] @ weights) - 2 * np.einsum("ij,ij->", weights, p[:w, w:])
        return float((own + np.trace(p[w:, w:])) / (self.n * len(self.targets)))


def moments(df: DataFrame, spec: PanelSpec, design: Design, targets: list[str]) -> Moments:
    """One pass over the blocks for all targets. Rows that miss a target are left out."""
    importable(df.sparkSession)
    rows = _laid_out(df, spec, design, list(targets))
    total = design.width + len(targets)

    def run(batches):
        sums = np.zeros((total, total))
        for table, first in _complete(batches, design.length - 1):
            at, inputs, codes = _windows(table, design, first)
            y = _numbers(table, targets, math.nan)[at]
            good = ~np.isnan(y).any(axis=1)
            z = np.concatenate([inputs[good], np.ones((int(good.sum()), 1)), y[good]], axis=1)
            _add(sums, z, codes[good], design)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i * total + j), pa.array(sums[i, j])], ["cell", "value"])

    cells = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    products = np.zeros(total * total)
    products[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    found = Moments(design, tuple(targets), products.reshape(total, total))
    if found.products[design.width - 1, design.width - 1] == 0:
        raise ValueError("no complete window to learn from")
    return found


def _add(sums: np.ndarray, z: np.ndarray, codes: np.ndarray, design: Design) -> None:
    """Adds the products of numeric columns ``z`` and of the marks that ``codes`` stand for."""
    place = np.concatenate([np.arange(design.inputs), np.arange(design.width - 1, len(sums))])
    sums[np.ix_(place, place)] += z.T @ z
    starts = design.inputs + np.cumsum([0, *design.sizes])[:-1]
    marks = [np.where((c >= 0) & (c < n), c + s, -1) for c, n, s in zip(codes.T, design.sizes, starts, strict=True)]
    for k, a in enumerate(marks):
        seen = a >= 0
        by_mark = np.zeros((design.sizes[k], z.shape[1]))
        np.add.at(by_mark, a[seen] - starts[k], z[seen])
        rows = np.arange(starts[k], starts[k] + design.sizes[k])
        sums[np.ix_(rows, place)] += by_mark
        sums[np.ix_(place, rows)] += by_mark.T
        for b in marks:
            both = seen & (b >= 0)
            np.add.at(sums, (a[both], b[both]), 1.0)


@dataclass(frozen=True)
class Rounds:
    """Course of a fit by rounds: the losses on held-out rows and the round that was kept."""

    losses: tuple[float, ...]
    kept: int


def descend(train: Moments, held_out: Moments, rounds: int, patience: int, least_gain: float = 1e-6) -> tuple[np.ndarray, Rounds]:
    """Weights by gradient steps from zero on the training rows; the intercept always fits the
    means. After each round the loss on the held-out rows is taken: the best round is kept, and
    the steps end when ``patience`` rounds have not made it better by ``least_gain``."""
    inner, cross, x, y = train.centred()
    rate = 1.0 / max(np.trace(inner), 1e-300)
    b = np.zeros_like(cross)
    whole = lambda b: np.vstack([b, y - x @ b])
    best, kept, losses = whole(b), 0, [held_out.loss(whole(b))]
    lowest = losses[0]
    for k in range(1, rounds + 1):
        b = b + rate * (cross - inner @ b)
        losses.append(held_out.loss(whole(b)))
        if losses[-1] < lowest - least_gain:
            best, kept, lowest = whole(b), k, losses[-1]
        elif k - kept >= patience:
            break
    return best, Rounds(tuple(losses), kept)


def scores(df: DataFrame, spec: PanelSpec, design: Design, weights: np.ndarray, names: list[str], kept: list[str]) -> DataFrame:
    """Keys, ``kept`` columns and one prediction column per target for every row that ends a
    window, block by block: one matrix product for all targets."""
    importable(df.sparkSession)
    keep = list(dict.fromkeys([*spec.keys, *kept]))
    rows = _laid_out(df, spec, design, keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"`{n}` double" for n in names]
    numeric, one = weights[: design.inputs], weights[-1]
    marks = np.split(weights[design.inputs : -1], np.cumsum(design.sizes)[:-1]) if design.sizes else []
    padded = [np.vstack([m, np.zeros((1, m.shape[1]))]) for m in marks]

    def run(batches):
        for table, first in _complete(batches, design.length - 1):
            at, inputs, codes = _windows(table, design, first)
            y = inputs @ numeric + one
            for c, m in zip(codes.T, padded, strict=True):
                y += m[np.where((c >= 0) & (c < len(m) - 1), c, len(m) - 1)]
            out = table.select(keep).take(pa.array(at)).combine_chunks()
            for k, n in enumerate(names):
                out = out.append_column(n, pa.array(y[:, k]))
            yield from out.to_batches()

    return rows.mapInArrow(run, ", ".join(fields))


@dataclass(frozen=True)
class LinearWeights:
    """Weights of one target: ``coefficients`` of the window, those of each category, and the
    intercept. Scores prepared rows, whose vector holds the window and then the codes."""

    coefficients: np.ndarray
    categories: tuple[np.ndarray, ...]
    intercept: float
    features: str
    prediction: str

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.features))
        n = len(self.coefficients)
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        total: Column = F.aggregate(F.zip_with(F.slice(x, 1, n), weights, lambda a, b: a * b), F.lit(float(self.intercept)), lambda s, v: s + v)
        for k, own in enumerate(self.categories):
            table = F.array(*[F.lit(float(w)) for w in own])
            code = F.get(x, n + k).cast("int")
            total = total + F.coalesce(F.when(code >= 0, F.get(table, code)), F.lit(0.0))
        return df.withColumn(self.prediction, total)


def by_target(design: Design, weights: np.ndarray, names: list[str], features: str = "features") -> dict[str, LinearWeights]:
    marks = np.split(weights[design.inputs : -1], np.cumsum(design.sizes)[:-1]) if design.sizes else []
    return {
        n: LinearWeights(weights[: design.inputs, k], tuple(m[:, k] for m in marks), float(weights[-1, k]), features, f"{n}_raw")
        for k, n in enumerate(names)
    }
