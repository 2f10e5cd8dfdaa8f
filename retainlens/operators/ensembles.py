"""Tree ensembles of a whole parameter grid in few Spark jobs (M2–M5).

A grid search fits one boosted model per learning rate, depth, number of rounds and fold. Most of
that work is shared here:

* a model of 100 rounds is the first 100 trees of that of 300, so both are judged in one fit; a
  forest's smaller numbers of trees, its shallower depths and its larger least split sizes are parts of its largest
  in the same way;
* the models of all folds read the same binned rows: a fold only sets which rows count, and rows that
  are left out walk down the trees beside the others and are judged on the way;
* the fits of one group advance together, level by level, in one barrier stage: tasks keep their rows,
  sum histograms by ``allGather`` and take the same splits. A level costs one exchange of histograms
  (their size is set by nodes and bins, not by rows), not a Spark job.
* a boosted level reads the rows of the lighter child of each split, in a few packs of features instead of
  all of them, and takes the other child's sums from the parent's; gradients are rounded so that these sums are exact.

Rows are spread over tasks of at most ``CELLS`` cells. Draws (rows of a round, bootstrap weights,
columns) are hashes of the row's key, the seed and the tree's number, so they don't depend on
partitions. A lost executor fails the stage, which then runs again as a whole. Barrier stages need
free slots for all their tasks and don't work with dynamic allocation.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property
from threading import Semaphore

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature (like Spark ML's ``maxBins``), cells (rows x features) of a task, forest cells (rows x trees) grown at
#: a time by tasks that exchange histograms, and by a task alone, which has no exchange to save.
BINS, CELLS, FOREST_CELLS, FOREST_CELLS_ALONE = 32, 64_000_000, 4_000_000, 60_000
#: Codes of a pack of features where groups have few rows, and where they have more than the third; rows of a tree's level
#: whose cells are found at a time.
CODES, MANY_CODES, MANY_ROWS, PIECE = 256, 1024, 3000, 4096
U64 = np.uint64
#: Of a tree's nodes: feature (-1: leaf), threshold, left child, value.
TREE = (np.int32, np.float64, np.int32, np.float64)


@dataclass(frozen=True)
class Spec:
    """One ensemble: ``fold`` is left out and judged (-1: none); ``sizes`` are the numbers of trees to judge."""
    kind: str  # "xgb" (second order, lambda 1), "gb" (variance splits, Newton leaves), "forest" (Gini)
    fold: int
    sizes: tuple[int, ...]
    depths: tuple[int | None, ...]
    rate: float = 0.1
    min_split: int = 2
    seed: int = 42


# --- binned rows ----------------------------------------------------------------------------------

def bin_edges(train: DataFrame, features: str = "features") -> list[np.ndarray]:
    """Split points of every feature: at most BINS - 1 quantiles; a value up to an edge lies below it."""
    width = train.select(F.size(vector_to_array(features)).alias("n")).first().n
    values = train.select(vector_to_array(features).alias("x"))
    probs = [i / BINS for i in range(1, BINS)]
    row = values.agg(*[F.percentile_approx(F.col("x")[i], probs, 10_000).alias(f"q{i}") for i in range(width)],
                     *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(width)]).first()
    # An edge at the largest value would split nothing off.
    return [np.array([e for e in sorted(set(row[f"q{i}"])) if e < row[f"m{i}"]]) for i in range(width)]


class Rows:
    """A task's rows: the bin of every cell (rows x features), labels, folds and keys. A slot is a feature's bin."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, fold: np.ndarray, key: np.ndarray, edges: list[np.ndarray]):
        self.bins, self.y, self.fold, self.key = np.ascontiguousarray(bins), y.astype(np.float64), fold, key.astype(np.int64).view(U64)
        self.size = np.array([len(e) + 1 for e in edges])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.width = len(edges)
        self.feature = np.repeat(np.arange(len(edges)), self.size)
        # Slots after which a node can be split: all but the last of a feature.
        last = np.zeros(int(self.begin[-1]), bool)
        last[self.begin[1:] - 1] = True
        self.cuts = np.flatnonzero(~last)

    @cached_property
    def columns(self) -> np.ndarray:
        """The bins as features x rows."""
        return np.ascontiguousarray(self.bins.T)

    @cached_property
    def told(self) -> np.ndarray:
        """Two cells for each bin, the second for class 1."""
        return (2 * self.bins + (self.y == 1)[:, None].astype(np.uint8)).ravel()


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bins of values (rows x features)."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def packs(d: Rows, most: int) -> list[tuple[np.ndarray, int, np.ndarray, slice]]:
    """Runs of features whose bins make one code a row, of at most ``most``: the codes, how many, what lies left of each cut (codes x cuts), where
    these cuts are among all. One-hot columns fall together, so a histogram counts a row in far fewer cells than it has
    features, and a product with the third gives the sums left of every cut."""
    out, at, j = [], 0, 0
    while j < d.width:
        code, bins = np.zeros(len(d.y), np.intp), np.zeros((1, 0), np.intp)
        first = j
        while j < d.width:
            joint = code * d.size[j] + d.columns[j]
            found = np.flatnonzero(np.bincount(joint, minlength=1))
            if j > first and len(found) > most:
                break
            new = np.zeros(len(bins) * d.size[j], np.intp)
            new[found] = np.arange(len(found))
            code, bins = new[joint], np.column_stack([bins[found // d.size[j]], found % d.size[j]])
            j += 1
        left = [bins[:, [i - first]] <= np.arange(d.size[i] - 1) for i in range(first, j)]
        left = np.concatenate(left, axis=1).astype(np.float64)
        out.append((code.astype(np.uint16), max(1, len(bins)), left if len(bins) else np.zeros((1, left.shape[1])), slice(at, at + left.shape[1])))
        at += left.shape[1]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draws(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) of each key."""
    h = np.zeros(1, U64)
    for s in salt:
        h = _mixed(h + U64(s) + U64(0x9E3779B97F4A7C15))
    return (_mixed(key + h) >> U64(11)).astype(np.float64) / float(1 << 53)


class Together:
    """Sums over the tasks of a barrier stage."""

    def __init__(self, context):
        self.context = context
        self.first = context is None or context.partitionId() == 0
        self.alone = context is None or len(context.getTaskInfos()) == 1

    def sum(self, x: np.ndarray) -> np.ndarray:
        if self.alone:
            return x
        parts = self.context.allGather(base64.b64encode(np.ascontiguousarray(x, np.float64).tobytes()).decode())
        return np.sum([np.frombuffer(base64.b64decode(p), np.float64) for p in parts], axis=0).reshape(x.shape)


def _class_weights(spec: Spec, d: Rows, train: np.ndarray, together: Together) -> np.ndarray:
    """Row weights: 3 for class 1 (xgb), balanced over the training rows (forest), 1 (gb)."""
    if spec.kind == "gb":
        return np.ones(len(d.y))
    if spec.kind == "xgb":
        return np.where(d.y == 1, 3.0, 1.0)
    n = together.sum(np.bincount(d.y[train].astype(np.int64), minlength=2).astype(np.float64))
    return np.where(d.y == 1, n.sum() / (2 * max(n[1], 1)), n.sum() / (2 * max(n[0], 1)))


def _judged(d: Rows, spec: Spec, predicted: np.ndarray) -> list[int]:
    """True positives, false positives, false negatives of the rows left out."""
    out = d.fold == spec.fold
    y, p = d.y[out] == 1, predicted[out]
    return [int((y & p).sum()), int((~y & p).sum()), int((y & ~p).sum())]


# --- boosting -------------------------------------------------------------------------------------

def boost(specs: Sequence[Spec], d: Rows, together: Together, edges: list[np.ndarray] | None = None) -> Iterator[tuple]:
    """Fits boosted models of one kind and one depth together; yields (spec, trees, depth, counts, model or None).

    A level reads the rows of the lighter child of every split; what the other child sums is the parent's less that. Gradients
    are multiples of a power of two so small that no sum of them is rounded, so neither this nor the tasks change a split, and
    of equal gains the first feature's is taken."""
    second, depth, rounds = specs[0].kind == "xgb", specs[0].depths[0], max(s for x in specs for s in x.sizes)
    lam, least = (1.0, 1.0) if second else (0.0, 1.0)
    counted = [(d.fold >= 0) & (d.fold != s.fold) for s in specs]
    w = np.stack([_class_weights(s, d, c, together) * c for s, c in zip(specs, counted)])
    share = together.sum(np.stack([w @ d.y, w.sum(axis=1)]))
    start = np.zeros(len(specs))
    if not second:  # starts at the log odds of the training rows
        p = np.clip(share[0] / np.maximum(share[1], 1), 1e-9, 1 - 1e-9)
        start = np.log(p / (1 - p))
    fine = 2.0 ** (51 - np.ceil(np.log2(max(1.0, share[1].max()))))  # of a gradient in units: sums stay below 2^52
    margin = np.repeat(start[:, None], len(d.y), 1)
    n, few, many, cuts, rate = len(d.y), packs(d, CODES), packs(d, MANY_CODES), len(d.cuts), np.array([s.rate for s in specs])
    flat, numbers, nodes, grown = d.columns.ravel(), np.arange(n), (2 << depth) - 1, [[] for _ in specs]
    every, small = range(len(specs)), np.min_scalar_type((1 << depth) - 1)

    def sums(m: int, at: np.ndarray, group: np.ndarray | None, groups: int, g: np.ndarray, h: np.ndarray | None, out: np.ndarray) -> None:
        """Left of every cut, and at last of all, for the rows ``at`` in their groups."""
        moved: dict = {}
        for code, size, left, of in many if len(at) > MANY_ROWS * groups else few:
            cell = code.take(at)
            if group is None:
                cell = cell.astype(np.intp)
            else:
                if size not in moved:
                    moved[size] = group * size
                cell = cell + moved[size]
            for k, x in enumerate((g, h)):
                seen = np.bincount(cell, x, groups * size).reshape(groups, size).astype(np.float64, copy=False)
                out[m, k, :, of] = seen @ left
        if group is None:
            out[m, :, 0, -1] = g.sum(), len(at) if h is None else h.sum()
        else:
            out[m, 0, :, -1] = np.bincount(group, g, groups)
            out[m, 1, :, -1] = np.bincount(group, h, groups)

    for r in range(rounds):
        taken = draws(d.key, specs[0].seed, r) < 0.8
        open_ = np.ones(cuts, bool)
        if second and d.width > 1:
            kept = np.argsort(draws(np.arange(d.width, dtype=U64), specs[0].seed, r, 1))[:max(1, int(0.8 * d.width))]
            open_ = np.isin(d.feature[d.cuts], kept)
        used = [c & taken for c in counted]
        rows = [np.flatnonzero(u) for u in used]
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (d.y - p) * fine) / fine, np.rint(w * p * (1 - p) * fine) / fine
        node = np.zeros((len(specs), n), small)  # within the level; rows of a leaf go left from there
        parent = [None] * len(specs)
        split = np.full((len(specs), nodes), -1, np.int64)
        hist = None
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            part = np.zeros((len(specs), 2, max(1, wide >> 1), cuts + 1))
            for m in every:
                at = rows[m] if hist is None else np.flatnonzero(light[m] & used[m])
                group = None if hist is None else parent[m].take(at).astype(np.intp)
                sums(m, at, group, max(1, wide >> 1), g[m].take(at), h[m].take(at) if second else None, part)
            part = together.sum(part)
            if hist is None:
                hist = part
            else:
                # Children side by side: the light one was summed, the other is the rest of a parent that was split.
                both = np.zeros((len(specs), 2, wide >> 1, 2, cuts + 1))
                on, side = (split[:, first - (wide >> 1):first] >= 0)[:, None, :, None], is_right[:, None, :, None]
                rest = hist - part
                both[:, :, :, 0] = np.where(on, np.where(side, rest, part), 0)
                both[:, :, :, 1] = np.where(on, np.where(side, part, rest), 0)
                hist = both.reshape(len(specs), 2, wide, cuts + 1)
            best, gain = _best_split(hist, open_, lam, least)
            good = gain > 1e-9
            split[:, first:first + wide] = np.where(good, d.cuts[best], -1)
            if not good.any():
                node <<= node.dtype.type(depth - level)
                break
            under = np.take_along_axis(hist[:, 1, :, :-1], best[..., None], 2)[..., 0]
            is_right = 2 * under > hist[:, 1, :, -1]
            column = np.where(good, d.feature[d.cuts[best]], 0)
            most = np.where(good, d.cuts[best] - d.begin[column], 255).astype(np.uint8)
            parent, light = node, np.zeros((len(specs), n), bool)  # rows of the light children
            node = np.empty_like(parent)
            for m in every:
                right = np.zeros(n, bool)
                if wide << 10 <= n:  # few nodes: whole columns are compared
                    for k in np.flatnonzero(good[m]).tolist():
                        inside, over = parent[m] == k, d.columns[column[m, k]] > most[m, k]
                        over &= inside
                        right |= over
                        light[m] |= over if is_right[m, k] else inside ^ over
                else:
                    at = parent[m].astype(np.intp)
                    right = flat.take((column[m] * n).take(at) + numbers) > most[m].take(at)
                    light[m] = good[m].take(at) & (right == is_right[m].take(at))
                np.add(parent[m], parent[m], out=node[m])
                node[m] += right
        last = 1 << depth
        leaf = np.zeros((len(specs), 2, last))
        for m, at in enumerate(rows):
            end = node[m].take(at).astype(np.intp)
            leaf[m, 0], leaf[m, 1] = np.bincount(end, g[m].take(at), last), np.bincount(end, h[m].take(at), last)
        leaf = together.sum(leaf)
        value = rate[:, None] * np.divide(leaf[:, 0], leaf[:, 1] + lam, out=np.zeros_like(leaf[:, 0]), where=leaf[:, 1] + lam > 1e-12)
        for m, spec in enumerate(specs):
            margin[m] += value[m].take(node[m])
            if edges is not None and spec.fold < 0:
                heap = np.concatenate([value[m, ::last >> level] for level in range(depth + 1)])  # a leaf's rows went left from it
                grown[m].append(_heap_tree(split[m], heap, d, edges))
            if r + 1 in spec.sizes:
                yield spec, r + 1, depth, _judged(d, spec, margin[m] > 0), grown[m] and (float(start[m]), list(grown[m])) or None


def _best_split(hist: np.ndarray, open_: np.ndarray, lam: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cut at which to split each node, and its gain; hist is (models, 2, nodes, cuts and a total), left of each cut."""
    if not open_.any():
        return np.zeros((hist.shape[0], hist.shape[2]), np.intp), np.full((hist.shape[0], hist.shape[2]), -np.inf)
    cuts = np.flatnonzero(open_)
    left, total = hist[..., cuts], hist[..., -1:]
    right = total - left
    part = lambda x: x[:, 0] ** 2 / np.maximum(x[:, 1] + lam, 1e-12)
    gain = np.where((left[:, 1] >= least) & (right[:, 1] >= least), part(left) + part(right) - part(total), -np.inf)
    best = gain.argmax(axis=2)
    return cuts[best], np.take_along_axis(gain, best[..., None], 2)[..., 0]


def _heap_tree(split: np.ndarray, value: np.ndarray, d: Rows, edges: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """feature (-1: leaf), threshold, left child and value of the reachable nodes."""
    order, at = [0], 0
    while at < len(order):
        if split[order[at]] >= 0:
            order += [2 * order[at] + 1, 2 * order[at] + 2]
        at += 1
    order = np.array(order)
    s = split[order]
    f = np.where(s >= 0, d.feature[s], -1)
    cut = np.array([edges[j][k - d.begin[j]] if j >= 0 else 0.0 for j, k in zip(f, s)])
    child = np.where(s >= 0, 1 + 2 * (np.cumsum(s >= 0) - 1), 0)  # children were listed in the order of their parents
    return f, cut, child, value[order]


# --- forests --------------------------------------------------------------------------------------

def forest(specs: Sequence[Spec], d: Rows, together: Together, edges: list[np.ndarray] | None = None, numbers: range | None = None) -> Iterator[tuple]:
    """Fits forests that differ only in the least split size, and judges all their sizes and depths; trees are grown some at a
    time. A tree whose smaller nodes stay whole is the upper part of the one that splits them. ``numbers``: only these trees
    of a forest of one size that is not judged."""
    numbers = numbers or range(max(specs[0].sizes))
    spec, least = specs[0], tuple(s.min_split for s in specs)
    counted = (d.fold >= 0) & (d.fold != spec.fold)
    weight = _class_weights(spec, d, counted, together)
    votes = {(m, depth): np.zeros(len(d.y)) for m in least for depth in spec.depths}
    step = max(1, (FOREST_CELLS_ALONE if together.alone else FOREST_CELLS) // max(1, int(together.sum(np.array([float(len(d.y))]))[0])))
    grown, ends = [], sorted({*range(numbers.start, numbers.stop, step), numbers.stop, *(s for s in spec.sizes if s < numbers.stop)})
    for a, b in zip(ends, ends[1:]):
        shares, trees = _grow(spec, least, d, together, counted, weight, range(a, b), edges if spec.fold < 0 else None)
        grown += trees
        for of in votes:
            votes[of] += shares[of]
        if b in spec.sizes or b == numbers.stop:
            for s in specs:
                for depth in s.depths:
                    yield s, max(spec.sizes) if b == numbers.stop else b, depth, _judged(d, s, votes[s.min_split, depth] > b / 2), (0.0, list(grown)) if grown and depth == s.depths[-1] else None


def _grow(spec: Spec, least: tuple[int, ...], d: Rows, together: Together, counted: np.ndarray, weight: np.ndarray, numbers: range, edges) -> tuple[dict, list]:
    """Trees level by level; the shares of class 1 that the rows left out get for each least split size and depth, summed over
    the trees. Only rows that a tree drew and rows to be judged walk down it."""
    n, t, tries = len(d.y), len(numbers), max(1, round(np.sqrt(d.width)))
    path = _mixed(np.array([spec.seed * 1_000_003 + i for i in numbers], U64))
    chance = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720]))
    mine = np.flatnonzero(counted)
    times = np.searchsorted(chance, np.concatenate([draws(d.key[mine], spec.seed, 7, i) for i in numbers])).reshape(t, len(mine))  # Poisson(1)
    at, row = np.nonzero(times)
    drawn, row = times[at, row], mine.take(row)
    w = drawn * weight.take(row)
    label = d.y.astype(np.intp)
    judged = np.flatnonzero(d.fold == spec.fold)
    heard, who = np.repeat(np.arange(t), len(judged)), np.tile(np.arange(len(judged)), t)  # node and row of those still open
    place = np.arange(t * len(judged))
    share = {m: np.full(t * len(judged), 0.5) for m in least}  # class 1 in the row's last node
    exists = {m: np.ones(t, bool) for m in least}  # nodes of the trees of each least split size
    two, flat = d.size == 2, d.bins.ravel()
    room, weights = np.empty((len(at), tries), np.intp), np.empty((len(at), tries))
    out, level = {}, 0
    built = {"f": [], "cut": [], "child": [], "v": []}

    def told(depth) -> None:
        for m in least:
            out[m, depth] = np.zeros(n)
            out[m, depth][judged] = share[m].reshape(t, len(judged)).sum(axis=0)

    while True:
        k = len(path)
        y = label.take(row)
        stats = together.sum(np.concatenate([np.bincount(2 * at + y, w, 2 * k), np.bincount(at, minlength=k)]))
        stats = np.stack([stats[0:2 * k:2], stats[1:2 * k:2], stats[2 * k:]])
        part = np.divide(stats[1], stats[0] + stats[1], out=np.full(k, 0.5), where=stats[0] + stats[1] > 0)
        for m in least:
            if exists[m].all():
                share[m][place] = part.take(heard)
            else:
                on = exists[m].take(heard)
                share[m][place[on]] = part.take(heard[on])
        if level in spec.depths:
            told(level)
        deep_enough = spec.depths[-1] is not None and level >= spec.depths[-1]
        may = np.flatnonzero((stats[2] >= min(least)) & (stats[0] > 0) & (stats[1] > 0) & (not deep_enough))
        slot = np.full(k, -1)
        if len(may):
            # Random features of every node, by its path.
            lot = _mixed(path[may, None] + _mixed(np.arange(d.width, dtype=U64) + U64(1)))
            tried = np.sort(np.argpartition(lot, tries - 1, axis=1)[:, :tries], axis=1)
            # Features of two bins have two cells, the others a line of BINS.
            pair = two[tried].ravel()
            cell_of = (np.where(pair, 2, BINS).cumsum() - np.where(pair, 2, BINS)).reshape(tried.shape)
            number = np.full(k, -1)
            number[may] = np.arange(len(may))
            own = number.take(at)
            use = np.flatnonzero(own >= 0)
            cells, cell_of = int(np.where(pair, 2, BINS).sum()), 2 * cell_of
            for a in range(0, len(use), PIECE):
                some = use[a:a + PIECE]
                of = own.take(some)
                cell = tried.take(of, axis=0)
                cell += (row.take(some) * d.width)[:, None]
                np.add(d.told.take(cell), cell_of.take(of, axis=0), out=room[a:a + len(some)])
                weights[a:a + len(some)] = w.take(some)[:, None]
            seen = together.sum(np.bincount(room[:len(use)].ravel(), weights[:len(use)].ravel(), 2 * cells).reshape(cells, 2))
            cell_of >>= 1
            whole = np.repeat(stats[:2, may], tries, axis=1)
            pure = lambda x: (x[0] * x[0] + x[1] * x[1]) / np.maximum(x[0] + x[1], 1e-12)

            def gains(left, total):
                right = total - left
                return np.where((left[0] + left[1] > 1e-9) & (right[0] + right[1] > 1e-9), pure(left) + pure(right) - pure(total), -np.inf)

            top, where = np.full(len(pair), -np.inf), np.zeros(len(pair), np.intp)
            of = np.flatnonzero(pair)
            top[of] = gains(seen.take(cell_of.ravel()[of], axis=0).T, whole[:, of])
            of = np.flatnonzero(~pair)
            if len(of):
                left = np.cumsum(seen.T[:, (cell_of.ravel()[of, None] + np.arange(BINS))], axis=2)
                gain = gains(left, whole[:, of, None])
                gain[np.arange(BINS) >= (d.size[tried.ravel()[of]] - 1)[:, None]] = -np.inf
                where[of] = gain.argmax(axis=1)
                top[of] = gain[np.arange(len(of)), where[of]]
            best = top.reshape(-1, tries).argmax(axis=1) + np.arange(len(may)) * tries
            good = top[best] > 1e-9
            slot[may] = np.where(good, d.begin[tried.ravel()[best]] + where[best], -1)
        open_ = np.flatnonzero(slot >= 0)
        child = np.full(k, -1)
        child[open_] = 2 * np.arange(len(open_))
        column = np.where(slot >= 0, d.feature[slot], 0)
        if edges is not None:
            built["f"].append(np.where(slot >= 0, column, -1))
            built["cut"].append(np.array([edges[j][s - d.begin[j]] if s >= 0 else 0.0 for j, s in zip(column, slot)]))
            built["child"].append(child)
            built["v"].append(part)
        if not len(open_):
            break
        most = np.where(slot >= 0, slot - d.begin[column], 0).astype(np.uint8)

        def below(nodes, rows):
            on = np.flatnonzero(child.take(nodes) >= 0)
            nodes, rows = nodes.take(on), rows.take(on)
            return on, child.take(nodes) + (flat.take(rows * d.width + column.take(nodes)) > most.take(nodes)), rows

        on, at, row = below(at, row)
        w = w.take(on)
        on, heard, _ = below(heard, judged.take(who))
        who, place = who.take(on), place.take(on)
        for m in least:
            exists[m] = np.repeat((exists[m] & (stats[2] >= m))[open_], 2)
        path = _mixed(np.repeat(path[open_], 2) * U64(2) + np.tile(np.array([0, 1], U64), len(open_)))
        level += 1
    for depth in spec.depths:
        if (least[0], depth) not in out:  # no tree is so deep, or none ends the growth
            told(depth)
    return out, [] if edges is None else _level_trees(built, t)


def _level_trees(built: dict, t: int) -> list[tuple[np.ndarray, ...]]:
    """The trees of levels (feature, threshold, child within the next level, value), each with its own numbering."""
    tree = [np.arange(t)]
    for f, child in zip(built["f"], built["child"]):
        tree.append(np.repeat(tree[-1][child >= 0], 2))
    begin = np.concatenate([[0], np.cumsum([len(f) for f in built["f"]])])
    f, cut, v = (np.concatenate(built[x]) for x in ("f", "cut", "v"))
    child = np.concatenate([np.where(c >= 0, c + b, -1) for c, b in zip(built["child"], begin[1:])])
    owner = np.concatenate(tree[:len(built["f"])])
    order = np.argsort(owner, kind="stable")
    new = np.empty(len(order), np.int64)
    starts = np.searchsorted(owner[order], np.arange(t + 1))
    new[order] = np.arange(len(order)) - starts[owner[order]]
    return [(f[o], cut[o], np.where(child[o] >= 0, new[child[o]], 0), v[o]) for o in (order[a:b] for a, b in zip(starts, starts[1:]))]


def _packed(trees: Sequence[tuple]) -> bytes:
    """Trees (feature, threshold, left child, value) as bytes."""
    size = np.array([len(trees), *(len(t[0]) for t in trees)], np.int64)
    joined = [np.concatenate([np.asarray(t[i], kind) for t in trees] or [np.zeros(0, kind)]) for i, kind in enumerate(TREE)]
    return zlib.compress(b"".join(x.tobytes() for x in [size, *joined]), 1)


def _unpacked(data: bytes) -> list[tuple[np.ndarray, ...]]:
    data = zlib.decompress(data)
    size = np.frombuffer(data, np.int64, 1 + int(np.frombuffer(data, np.int64, 1)[0]))[1:]
    at, parts, cut = 8 * (1 + len(size)), [], np.cumsum(size)[:-1]
    for kind in TREE:
        parts.append(np.split(np.frombuffer(data, kind, int(size.sum()), at), cut) if len(size) else [])
        at += int(size.sum()) * np.dtype(kind).itemsize
    return list(zip(*parts))


# --- jobs -----------------------------------------------------------------------------------------

def _groups(specs: Sequence[Spec], parts: int = 1) -> list[list[int]]:
    """Fits that share a stage: boosted ones of one kind, depth, seed and number of rounds, dealt to ``parts`` stages
    (that many can run at once); every forest has its own (but see ``_shared``). The longest come first."""
    found: dict = {}
    for i, s in enumerate(specs):
        found.setdefault(i if s.kind == "forest" else (s.kind, s.depths, s.seed, max(s.sizes)), []).append(i)
    out = []
    for group in found.values():
        size = -(-len(group) // max(1, parts))
        out += [group[a:a + size] for a in range(0, len(group), size)]
    # A forest's trees cost about as much as boosted ones of 20 levels.
    cost = lambda g: len(g) * max(specs[g[0]].sizes) * (20 if specs[g[0]].kind == "forest" else specs[g[0]].depths[0])
    return sorted(out, key=cost, reverse=True)


def _shared(specs: Sequence[Spec], groups: list[list[int]]) -> list[list[int]]:
    """The groups, those of forests that differ only in the least split size as one."""
    found: dict = {}
    for g in groups:
        s = specs[g[0]]
        again = specs[:g[0]].count(s)  # equal ones stay apart
        found.setdefault((s.fold, s.sizes, s.depths, s.seed, again) if s.kind == "forest" and s.fold >= 0 else g[0], []).extend(g)
    return list(found.values())


def _ranges(spec: Spec, parts: int) -> list[range | None]:
    """The trees of a forest that is not judged, dealt to ``parts`` stages; None: all trees in one."""
    if spec.kind != "forest" or spec.fold >= 0 or len(spec.sizes) > 1:
        return [None]
    size = -(-spec.sizes[0] // parts)
    return [range(a, min(a + size, spec.sizes[0])) for a in range(0, spec.sizes[0], size)]


def fit(train: DataFrame, specs: Sequence[Spec], edges: list[np.ndarray], features: str = "features", label: str = "label",
        fold: str = "fold", key: str = "key", busy: Sequence[Future] = ()) -> list[tuple[int, int, int | None, tuple[int, int, int], tuple | None]]:
    """(number of the spec, trees, depth, (tp, fp, fn) of the rows left out, model where none are left out).

    ``train`` should be a stored or cached frame; its rows need a ``key`` (long) that tells them apart. Jobs that run beside
    (``busy``) get a slot each where stages of few tasks leave a choice.
    """
    spark = train.sparkSession
    kinds = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("fold", pa.int32()), ("key", pa.int64())])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            found = pa.array([row.tobytes() for row in binned(x, edges)], pa.binary())
            yield pa.RecordBatch.from_arrays([found, *(batch.column(c) for c in kinds.names[1:])], schema=kinds)

    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                        F.coalesce(F.col(fold), F.lit(0)).cast("int").alias("fold"), F.col(key).cast("long").alias("key")).mapInArrow(
        bins, "bins binary, y double, fold int, key long").persist()  # every stage reads them: a byte a cell
    slots = spark.sparkContext.defaultParallelism
    tasks = min(slots, max(1, -(-rows.count() * len(edges) // CELLS)))
    at_once = max(1, slots // tasks)
    free = Semaphore(at_once)
    for job in busy[:at_once - 1]:
        free.acquire()
        job.add_done_callback(lambda _: free.release())

    def run(group: list[int], numbers: range | None):
        chosen = [specs[i] for i in group]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = BarrierTaskContext.get()
            together = Together(context)
            held = list(batches)
            got = (pa.Table.from_batches(held) if held else kinds.empty_table()).sort_by("key")
            cells = np.frombuffer(b"".join(got.column("bins").to_pylist()), np.uint8).reshape(got.num_rows, len(edges))
            d = Rows(cells, *(got.column(c).to_numpy() for c in ("y", "fold", "key")), edges)
            fits = forest(chosen, d, together, edges, numbers) if chosen[0].kind == "forest" else boost(chosen, d, together, edges)
            for spec, size, depth, counts, model in fits:
                start, blob = (None, None) if model is None or not together.first else (model[0], _packed(model[1]))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (group[chosen.index(spec)], size, -1 if depth is None else depth, *counts)] + [
                    pa.array([numbers.start if numbers else 0]), pa.array([start], pa.float64()), pa.array([blob], pa.binary())],
                    names=["spec", "size", "depth", "tp", "fp", "fn", "first", "start", "trees"])

        with free:
            return rows.repartition(tasks).mapInArrow(work, "spec long, size long, depth long, tp long, fp long, fn long, first long, start double, trees binary",
                                                      barrier=True).collect()

    try:
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            jobs = [(g, n) for g in _shared(specs, _groups(specs, at_once)) for n in _ranges(specs[g[0]], at_once)]
            found = [r for part in pool.map(run, *zip(*jobs)) for r in part]
    finally:
        rows.unpersist()
    total: dict = {}
    for r in found:
        counts, model = total.setdefault((r.spec, r.size, r.depth), ([0, 0, 0], []))
        for i, v in enumerate((r.tp, r.fp, r.fn)):
            counts[i] += v
        if r.trees is not None:
            model.append((r.first, r.start, r.trees))
    joined = lambda parts: (parts[0][1], [t for _, _, trees in sorted(parts) for t in _unpacked(bytes(trees))])
    return [(spec, size, None if depth < 0 else depth, tuple(counts), joined(model) if model else None) for (spec, size, depth), (counts, model) in sorted(total.items())]


# --- the fitted model -----------------------------------------------------------------------------

class TreeEnsembleModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble as a Spark ML stage: adds ``probability`` (vector) and ``prediction``. The trees are a
    parameter, so the stage is saved and loaded with its pipeline."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "margin or share", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "start and trees as JSON, the trees packed or as lists", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "parameters of the fit", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol: str = "features", kind: str = "margin", trees: str = "[0.0, []]", settings: str = ""):
        super().__init__()
        self._setDefault(featuresCol="features", kind="margin", trees="[0.0, []]", settings="")
        self._set(**self._input_kwargs)

    def arrays(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        start, trees = json.loads(self.getOrDefault("trees"))
        trees = _unpacked(base64.b64decode(trees)) if isinstance(trees, str) else trees
        root = np.concatenate([[0], np.cumsum([len(t[0]) for t in trees])]).astype(np.int64)
        join = lambda i, kind: np.concatenate([np.array(t[i], kind) for t in trees] or [np.zeros(0, kind)])
        f = join(0, np.int64)
        child = join(2, np.int64) + np.repeat(root[:-1], np.diff(root))
        depth = max((_height(t) for t in trees), default=0)
        return start, root[:-1], f, join(1, np.float64), child, join(3, np.float64), depth

    def _transform(self, df: DataFrame) -> DataFrame:
        start, root, f, cut, child, value, depth = self.arrays()
        margin = self.getOrDefault("kind") == "margin"

        @F.pandas_udf("double")
        def chance(x):
            out = np.empty(len(x))
            for at in range(0, len(x), 1000):
                rows = np.stack(x.iloc[at:at + 1000].to_numpy())
                node = np.tile(root, len(rows))
                open_ = np.arange(len(node))  # walks that have not come to a leaf
                for _ in range(depth):
                    here = node.take(open_)
                    on = f.take(here)
                    inner = np.flatnonzero(on >= 0)
                    open_, here, on = open_.take(inner), here.take(inner), on.take(inner)
                    node[open_] = child.take(here) + (rows.ravel().take(open_ // len(root) * rows.shape[1] + on) > cut.take(here))
                got = value[node].reshape(len(rows), -1)
                out[at:at + 1000] = 1 / (1 + np.exp(-(start + got.sum(axis=1)))) if margin else got.mean(axis=1)
            return pd.Series(out)

        p = chance(vector_to_array(self.getOrDefault("featuresCol")))
        return df.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(F.lit(1.0) - F.col("__p"), F.col("__p")))).withColumn(
            "prediction", F.when(F.col("__p") > 0.5, 1.0).otherwise(0.0)).drop("__p")


def ensemble_model(kind: str, model: tuple[float, list], settings: dict) -> TreeEnsembleModel:
    """The stage of a fit's model."""
    return TreeEnsembleModel(kind="share" if kind == "forest" else "margin", trees=json.dumps([model[0], base64.b64encode(_packed(model[1])).decode()]),
                             settings=",".join(f"{k}={v}" for k, v in sorted(settings.items())))


def _height(tree) -> int:
    """Levels below the root."""
    f, child = np.array(tree[0]), np.array(tree[2])
    level, at = 0, np.array([0])
    while True:
        at = at[f[at] >= 0]
        if not len(at):
            return level
        at = np.concatenate([child[at], child[at] + 1])
        level += 1
