"""Co-moments of many columns in one pass.

Every task folds its rows, block by block, into one state of k×k matrices: for each pair (i, j) the rows
where both are present, the mean of i and its squared deviations over these rows, and the centred cross
products. A block is centred by its own means before its matrix products, and states merge by the
pairwise update formula, so large offsets don't cancel digits away. States are merged in a tree: one
exchange hashes them over tasks, a second brings one state per task together. What leaves a task is 4 k² doubles
whatever the rows, and only the last state reaches the driver.

Pairs are complete pairwise, as in a data frame's correlation. Filling gaps needs no second pass: the
states say how many rows lack i, j or both, so :meth:`CoMoments.filled` gives the matrix of the filled
columns for any fill values.

Defined cases: NaN counts as missing; rows whose array is null are left out; an empty table has counts
of 0, and null (NaN) covariances; a constant column has a correlation of NaN; an infinite value makes
its pairs NaN; arrays of other lengths than the first raise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import safe_double

_STATE = "rows long, n array<double>, mean array<double>, cross array<double>, square array<double>"
_ARROW = pa.schema([("rows", pa.int64())] + [(c, pa.list_(pa.float64())) for c in ("n", "mean", "cross", "square")])
#: Rows of one matrix product.
BLOCK = 8192


@dataclass
class CoMoments:
    """For pair (i, j), over the rows that have both: ``n``, ``mean`` of i, ``square`` deviations of i,
    ``cross`` products of the deviations. ``rows`` counts all rows."""

    rows: int
    n: np.ndarray
    mean: np.ndarray
    cross: np.ndarray
    square: np.ndarray

    @classmethod
    def empty(cls, k: int) -> CoMoments:
        return cls(0, *(np.zeros((k, k)) for _ in range(4)))

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """State of a block of rows (NaN: missing)."""
        here = ~np.isnan(x)
        n = here.T.astype(float) @ here
        low, high = np.where(here, x, np.inf).min(0), np.where(here, x, -np.inf).max(0)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            shift = np.where(here, x, 0.0).sum(0) / np.diag(n)
            shift = np.where(low == high, low, shift)  # a constant column deviates by exactly 0
            shift = np.where(np.diag(n) > 0, shift, 0.0)
            d = np.where(here, x - shift, 0.0)
            s = d.T @ here  # of i where j is present
            m = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
            cross = d.T @ d - n * m * m.T
            square = np.maximum((d * d).T @ here - n * m * m, 0.0)
        return cls(len(x), n, np.where(n > 0, shift[:, None] + m, 0.0), cross, square)

    def merge(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        with np.errstate(invalid="ignore"):
            share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
            d = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
            w = self.n * share
            mean = np.where(self.n > 0, self.mean + d * share, other.mean)
            return CoMoments(self.rows + other.rows, n, mean, self.cross + other.cross + w * d * d.T,
                             self.square + other.square + w * d * d)

    def covariance(self, ddof: int = 1) -> np.ndarray:
        """Of complete pairs; NaN where fewer than ``ddof`` + 1 rows have both."""
        return np.divide(self.cross, self.n - ddof, out=np.full_like(self.cross, np.nan), where=self.n > ddof)

    def correlation(self) -> np.ndarray:
        """Pearson's, of complete pairs; NaN where one side doesn't vary."""
        with np.errstate(invalid="ignore"):
            scale = np.sqrt(self.square) * np.sqrt(self.square.T)
            return np.divide(self.cross, scale, out=np.full_like(self.cross, np.nan), where=scale != 0)

    def means(self) -> np.ndarray:
        return np.where(np.diag(self.n) > 0, np.diag(self.mean), np.nan)

    def filled(self, values: Sequence[float | None]) -> CoMoments:
        """The state of the columns with their gaps filled by ``values`` (None: left as gaps)."""
        k = len(self.n)
        gaps = np.array([v is None or v != v for v in values], dtype=bool)
        f = np.array([0.0 if g else float(v) for g, v in zip(gaps, values)])
        own = np.diag(self.n)
        mean = np.diag(self.mean)
        total = float(self.rows)
        mu = mean + (total - own) / max(total, 1.0) * (f - mean)  # exact where the fill is the mean
        both = self.mean - mu[:, None]  # mean deviation of i where j is present
        alone = (own * (mean - mu))[:, None] - self.n * both  # sum of deviations of i where j is missing
        fill = f - mu
        neither = total - own[:, None] - own[None, :] + self.n
        cross = self.cross + self.n * both * both.T + alone * fill[None, :] + alone.T * fill[:, None] + neither * np.outer(fill, fill)
        var = np.diag(self.square) + own * (mean - mu) ** 2 + (total - own) * fill ** 2
        out = CoMoments(self.rows, np.full((k, k), total), np.tile(mu[:, None], (1, k)), cross, np.tile(var[:, None], (1, k)))
        for m, was in ((out.n, self.n), (out.mean, self.mean), (out.cross, self.cross), (out.square, self.square)):
            if gaps.any():  # pairs with a column left as it was: only defined where neither is filled
                m[gaps, :], m[:, gaps] = was[gaps, :], was[:, gaps]
        return out


def _row(state: CoMoments) -> pa.RecordBatch:
    parts = [pa.array([m.ravel().tolist()], t.type) for m, t in zip((state.n, state.mean, state.cross, state.square), list(_ARROW)[1:])]
    return pa.RecordBatch.from_arrays([pa.array([state.rows], pa.int64()), *parts], schema=_ARROW)


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (one array column) -> the task's state."""
    state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        for at in range(0, len(x), BLOCK):
            block = CoMoments.of(x[at:at + BLOCK])
            if state is not None and state.n.shape != block.n.shape:
                raise ValueError("the arrays have different lengths")
            state = block if state is None else state.merge(block)
    if state is not None:
        yield _row(state)


def _fold_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States -> one state a task."""
    state = None
    for batch in batches:
        for row in batch.to_pylist():
            one = _state(row)
            state = one if state is None else state.merge(one)
    if state is not None:
        yield _row(state)


def _state(row) -> CoMoments:
    k = int(round(len(row["n"]) ** 0.5))
    return CoMoments(row["rows"], *(np.asarray(row[c], dtype=float).reshape(k, k) for c in ("n", "mean", "cross", "square")))


def comoments(df: DataFrame, x: Column, width: int | None = None) -> CoMoments:
    """Co-moments of the array column ``x`` over ``df`` (``width``: its length, for an empty table)."""
    states = df.select(x.alias("_x")).filter("_x IS NOT NULL").mapInArrow(_fold_rows, _STATE)
    merged = states.repartition("cross").mapInArrow(_fold_states, _STATE)
    row = merged.repartition(1).mapInArrow(_fold_states, _STATE).first()
    return CoMoments.empty(width or 0) if row is None else _state(row)


def numeric_array(df: DataFrame, cols: Sequence[str]) -> Column:
    """The coerced numbers of ``cols`` as one array; NaN becomes null."""
    return F.array(*[safe_double(c, df.schema[c].dataType) for c in cols])


def column_comoments(df: DataFrame, cols: Sequence[str]) -> CoMoments:
    return comoments(df, numeric_array(df, cols), len(cols))
