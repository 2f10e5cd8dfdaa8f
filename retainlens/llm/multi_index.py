"""Near duplicates among embeddings by an inverted multi-index (operator 12).

Equal vectors are one class. Unit vectors are cut into two halves, each with a codebook of its own
(k-means on at most ``SAMPLE_BYTES`` of classes, chosen by hash); a class lies in the cell of its two
nearest codewords, so the codebooks form a product grid of k * k cells. Every class is indexed.

Each class then walks the cells by the multi-sequence algorithm, nearest first: a cell's excess is the
sum over both halves of the squared distance to its codeword beyond that to the nearest one. The walk
ends at the excess ``reach`` by which, on the sample, a share of ``target`` of near pairs has met: pairs
displaced at random to exactly the threshold, the hardest ones, and the near pairs within the sample.
A pair is met if either end's walk comes to the other's cell.

Where classes meet, they are compared in full: tiles of at most about ``TILE`` residents and ``TILE``
visitors of one cell, however many it has, with cosines in double precision. A tile gives each row's
number of links and one link to the least row that it is connected with there, not the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are components of their own; vectors of different lengths never link; rows that repeat an
id are rows of their own, those that repeat a vector link with each other; rows with a null id take
part, and have the least id of their component (null if none has one); an empty table gives an empty
result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut
from .jaccard import components

#: Classes per cell that the grid is made for; codewords of a half at most; bytes of the sample; rows of a tile's side.
CELL, MOST_CODES, SAMPLE_BYTES, TILE = 512, 256, 8 << 20, 2048
#: Sampled rows whose pairs calibrate the walk.
CALIBRATION = 4096
NAMES = ["c", "dim", "m", "home", "cells", "v"]


# --- codebooks ----------------------------------------------------------------------------------

def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component is taken out first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k centers; starts from rows spread over the sample, an empty center takes the farthest row."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        d = squared(x, centers)
        near = d.argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        far = np.argsort(-d[np.arange(len(x)), near], kind="stable")[:k]
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[far])
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * x @ centers.T, 0)


class Grid:
    """The two codebooks of one vector length and how far a walk goes."""

    def __init__(self, dim: int, codes: tuple[np.ndarray, np.ndarray], reach: float):
        self.dim, self.half, self.codes, self.reach = dim, dim // 2, codes, reach
        self.k = len(codes[0])

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's excess for the codewords of both halves, and its cell."""
        a, b = squared(x[:, :self.half], self.codes[0]), squared(x[:, self.half:], self.codes[1])
        home = a.argmin(axis=1) * self.k + b.argmin(axis=1)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True), home

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) of every visit, and each row's own cell: the multi-sequence algorithm for all rows at a time.

        Codewords of each half are sorted by excess. A row's frontier holds, for each codeword of the first half,
        the next one of the second; each round takes the frontier's nearest cell, until that is beyond ``reach``.
        """
        a, b, home = self.excess(x)
        by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        b = np.concatenate([b, np.full((len(x), 1), np.inf)], axis=1)
        rows, depth = np.arange(len(x)), np.zeros((len(x), self.k), np.int64)
        visits = []
        while len(rows):
            ahead = a + np.take_along_axis(b, depth, 1)
            # A codeword's next cell is open once the codeword before it has passed that depth.
            ahead[:, 1:][depth[:, 1:] >= depth[:, :-1]] = np.inf
            i = ahead.argmin(axis=1)
            at = np.arange(len(rows))
            go = (ahead[at, i] <= self.reach) & (ahead[at, i] < np.inf)  # infinite: no cell is left
            a, b, by_a, by_b, depth, rows, i = a[go], b[go], by_a[go], by_b[go], depth[go], rows[go], i[go]
            at = np.arange(len(rows))
            visits.append((rows, by_a[at, i] * self.k + by_b[at, depth[at, i]]))
            depth[at, i] += 1
        row, cell = (np.concatenate(v) for v in zip(*visits)) if visits else (np.zeros(0, np.int64),) * 2
        # Equal distances may give a row's own cell a place other than the first: it is always visited.
        own = np.arange(len(x))
        pairs = np.unique(np.concatenate([np.stack([row, cell], 1), np.stack([own, home], 1)]), axis=0)
        return pairs[:, 0], pairs[:, 1], home


def fit_grid(sample: np.ndarray, rows: int, threshold: float, target: float) -> Grid:
    """Codebooks for ``rows`` classes of the sample's length, and the walk's reach for the target recall."""
    dim = sample.shape[1]
    k = max(1, min(MOST_CODES, int(np.ceil(np.sqrt(rows / CELL))), len(sample) // 8))
    half = dim // 2
    grid = Grid(dim, (k_means(sample[:, :half], k), k_means(sample[:, half:], k)), 0.0)
    x = sample[np.linspace(0, len(sample) - 1, min(len(sample), CALIBRATION)).astype(np.int64)]
    u = np.random.default_rng(7).normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    needed = [_needed(grid, x, threshold * x + np.sqrt(1 - threshold ** 2) * u)]
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at:at + 512] @ x.T >= threshold)
        needed.append(_needed(grid, x[at + i], x[j])[at + i < j])
    near = np.concatenate(needed[1:])
    grid.reach = max(float(np.quantile(n, target, method="higher")) for n in (needed[0], near) if len(n))
    return grid


def _needed(grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The reach from which on x meets y or y meets x."""
    (a, b, hx), (c, d, hy) = grid.excess(x), grid.excess(y)
    r, k = np.arange(len(x)), grid.k
    return np.minimum(a[r, hy // k] + b[r, hy % k], c[r, hx // k] + d[r, hx % k])


def _grids(classes: DataFrame, threshold: float, target: float) -> dict[int, Grid]:
    """A grid for every vector length with more classes than a cell holds; the others need none."""
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {CELL} AND dim > 1").collect()
    grids = {}
    for r in sizes:
        most = max(1024, SAMPLE_BYTES // (8 * r.dim))
        got = classes.filter(F.col("dim") == r.dim).orderBy("h1", "h2").limit(most).select("v").toArrow()
        x = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, r.dim)
        grids[r.dim] = fit_grid(unit(x), r.n, threshold, target)
    return grids


# --- index and tiles ----------------------------------------------------------------------------

def _index(classes: DataFrame, grids) -> DataFrame:
    """c, dim, m, home, cells (visited ones, sorted) and the vector as bytes, of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = column(b, "dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == dim))
                x = column(rows, "v").flatten().to_numpy(zero_copy_only=False)
                x = np.ascontiguousarray(x).reshape(-1, dim)
                grid = grids.value.get(dim)
                step = 1024 if grid else len(x)
                for at in range(0, len(x), step):
                    part, n = x[at:at + step], min(step, len(x) - at)
                    if grid:
                        row, cell, home = grid.walk(unit(part.astype(np.float64)))
                    else:
                        row, cell, home = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                    cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(cell))
                    size = part.itemsize * dim
                    raw = part.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [column(rows, "c")[at:at + n], column(rows, "dim")[at:at + n], column(rows, "m")[at:at + n], pa.array(home), cells,
                         pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())], names=NAMES)

    return classes.select("c", "dim", "m", "v").mapInArrow(run, "c long, dim int, m long, home long, cells array<long>, v binary")


_KEY = ["dim", "cell", "part", "side"]


def _met(index: DataFrame) -> DataFrame:
    """Residents (role 0) and visitors (role 1) of every tile (dim, cell, part, side)."""
    homes = index.groupBy("dim", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("residents"))
    guests = index.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("guests"))
    # A cell's own classes visit it, so every home is among the visited; cells without a resident drop out.
    cells = cut(homes.join(guests, ["dim", "cell"]).select(
        "dim", "cell", F.ceil(F.col("residents") / TILE).cast("long").alias("parts"), F.ceil(F.col("guests") / TILE).cast("long").alias("sides")))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "c"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    carried = ["role", "c", "m", "home", "cells", "v"]
    resident = (index.withColumn("cell", F.col("home")).join(cells, ["dim", "cell"]).withColumn("role", F.lit(0))
                .withColumn("part", own("part", F.col("parts"))).withColumn("side", F.explode(upto("sides"))).select(*_KEY, *carried))
    guest = (index.withColumn("cell", F.explode("cells")).withColumn("cells", F.array().cast("array<bigint>")).join(cells, ["dim", "cell"])
             .withColumn("role", F.lit(1)).withColumn("side", own("side", F.col("sides"))).withColumn("part", F.explode(upto("parts"))).select(*_KEY, *carried))
    return resident.unionAll(guest)


def _connected(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label in each row's and column's connected part of a boolean matrix."""
    far = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(mask, right, far).min(axis=1))
        new_right = np.minimum(right, np.where(mask.T, new_left, far).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _tile_links(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c, number of links and a connected class of the rows of one tile."""
    role = t.column("role").to_numpy()
    split = int(np.searchsorted(role, 1))
    empty = (np.zeros(0, np.int64),) * 3
    if split == 0 or split == len(role):
        return empty
    dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
    raw = b"".join(t.column("v").to_pylist())
    v = unit(np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(role) else np.float64).reshape(-1, dim).astype(np.float64))
    c, m, home = (t.column(x).to_numpy() for x in ("c", "m", "home"))
    cells = t.column("cells").combine_chunks()
    flat, owner = cells.flatten().to_numpy(), np.repeat(np.arange(len(role)), np.diff(cells.offsets.to_numpy()))
    # Whether a resident visits a visitor's own cell: then both tiles meet the pair, and the smaller cell counts it.
    homes = np.unique(home[split:])
    place = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
    back = np.zeros((split, len(homes)), bool)
    hit = homes[place] == flat
    back[owner[hit], place[hit]] = True
    out = []
    r = np.arange(split)
    for at in range(split, len(role), 512):
        g = np.arange(at, min(at + 512, len(role)))
        near = v[r] @ v[g].T >= threshold
        if not near.any():
            continue
        other = home[g] != cell
        near &= np.where(other, ~back[:, np.searchsorted(homes, home[g])] | (cell < home[g]), c[r][:, None] < c[g])
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(i):
            near = near[np.ix_(i, j)]
            left, right = _connected(near, c[i], c[g[j]])
            out += [(c[i], near @ m[g[j]], left), (c[g[j]], near.T @ m[i], right)]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else empty


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """c, n, to: partial numbers of links, and a class that is connected."""
    def close(t: pa.Table, last: bool) -> tuple[pa.Table, pa.RecordBatch]:
        key = np.stack([t.column(x).to_numpy().astype(np.int64) for x in _KEY], 1)
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        if not last:
            edges = edges[:-1]
        found = [_tile_links(t.slice(a, b - a), threshold) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        c, n, to = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        # One row for each class and connected class of the tiles closed here.
        pair, back = np.unique(np.stack([c, to], 1), axis=0, return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, back.reshape(-1), n)
        return t.slice(int(edges[-1])), pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(total), pa.array(pair[:, 1])], names=["c", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows > 4 * TILE:
                rest, out = close(pa.concat_tables(held).combine_chunks(), False)
                held, rows = [rest], rest.num_rows if rest.num_rows < 4 * TILE else 0
                yield out
        if held and sum(t.num_rows for t in held):
            yield close(pa.concat_tables(held).combine_chunks(), True)[1]

    near = tiles.repartition(*(F.col(k) for k in _KEY)).sortWithinPartitions(*_KEY, "role")
    return near.mapInArrow(run, "c long, n long, to long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, target: float = 0.999, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``; ``target`` is the recall that walks are fitted for."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    whole = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    # Floats stay floats, which halves what is moved; every other number becomes a double.
    kind = "array<float>" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "array<double>"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast(kind).alias("v"), whole.alias("usable")).withColumns(
        {"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")})
    classes = rows.filter("usable").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("dim", F.size("v")).withColumn("c", F.monotonically_increasing_id()))
    grids = vectors.sparkSession.sparkContext.broadcast(_grids(classes, threshold, target))
    found = cut(_links(_met(cut(_index(classes, grids))), threshold))
    comp = components(found.select(F.col("c").alias("a"), F.col("to").alias("b")))
    count = found.groupBy("c").agg(F.sum("n").alias("n"))
    known = classes.select("c", "h1", "h2", "m", "least").join(count, "c", "left").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    known = cut(known)
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.join(least, "comp").select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter("usable").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
