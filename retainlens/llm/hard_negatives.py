"""Hard-negative mining with Four-Russians scoring (operator 11).

Components become integers, floor(scale * x). Candidates are packed into tiles of at most about
``TILE`` rows as bit planes: plane b of eight neighbouring dimensions is one byte, so a tile of p
planes takes p / 8 bytes a component. Anchors come in blocks of about ``BLOCK`` rows. For each
group of eight dimensions an anchor's 256 subset sums are precomputed once; a candidate's byte
looks its sum up, groups are added, planes are joined by shift and add (the top plane counts
negative: two's complement). The result is the exact inner product.

Anchor blocks, the smaller side, are copied to every tile of their length (an equi-join on the
tile's number) and scored there twice:

1. against the tile's rows of the anchor's own label, for its best ``positives``;
2. with those known, against the rows of other labels: for each positive the best ``negatives``
   whose score lies between ``low`` percent of the positive's score and that score.

Lists of a tile are merged per group of ``FAN`` tiles, then over the groups. Tiles and blocks are
dealt by a hash of the whole row, so a label that holds most rows is spread over all of them.

Defined cases: rows with a null id, a null label, a null or empty vector, or a null or non-finite
component take no part; rows that repeat id, label and vector are one row; rows that repeat only
an id are rows of their own, but never positives or negatives of an anchor with that id; vectors
of different lengths never meet; a positive with a negative score has no negative (its range is
empty); anchors without a positive and positives without a negative give no row; an empty table
gives an empty result. Other columns are not looked at, whatever their names. Scores are exact
while 100 times a score fits in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut

TILE, BLOCK, FAN = 8192, 512, 16
#: Anchors and candidates of one step; their tables and sums stay in the processor's cache.
STEP_A, STEP_C = 64, 2048
NEVER = np.iinfo(np.int64).min


# --- bit planes and subset sums -----------------------------------------------------------------

def bit_planes(m: np.ndarray) -> np.ndarray:
    """Two's-complement planes of an integer matrix (rows x dims): uint8 (planes, groups of 8 dims, rows)."""
    top = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    planes = top.bit_length() + 1
    bits = np.stack([(m >> b) & 1 for b in range(planes)]).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little").transpose(0, 2, 1))


def subset_sums(a: np.ndarray, dtype) -> np.ndarray:
    """Of each group of 8 dimensions the sums of all 256 subsets, for every anchor: (groups, 256, anchors)."""
    n, dim = a.shape
    groups = -(-dim // 8)
    padded = np.zeros((groups * 8, n), dtype)
    padded[:dim] = a.T
    sums = np.zeros((groups, 256, n), dtype)
    for k in range(8):
        sums[:, 1 << k:2 << k] = sums[:, :1 << k] + padded[k::8][:, None]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (rows x anchors) from subset sums and bit planes, by shift and add from the top plane."""
    rows = planes.shape[2]
    total = np.zeros((rows, sums.shape[2]), sums.dtype)
    plane, found = np.empty_like(total), np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        for g in range(len(sums)):
            np.take(sums[g], planes[b, g], axis=0, out=found if g else plane, mode="clip")
            if g:
                plane += found
        if b == len(planes) - 1:
            np.negative(plane, out=total)
        else:
            total <<= 1
            total += plane
    return total


def _exact_type(anchors: np.ndarray, planes: np.ndarray):
    """int32 where no sum can leave it, int64 otherwise."""
    bound = int(np.abs(anchors).sum(axis=1, dtype=np.int64).max(initial=0)) << len(planes)
    return np.int32 if bound < 2 ** 31 else np.int64


# --- packing ------------------------------------------------------------------------------------

_TILE = "dim int, tile long, ids binary, labels binary, planes binary, n_planes int"
_BLOCK = "dim int, block long, ids binary, keys binary, labels binary, m binary, given binary"


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _longs(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype("<i8")


def _as_batch(schema: str, **values) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return pa.Table.from_pydict({n: [values[n]] for n, _ in fields}, schema=pa.schema(fields))


def _tiles(rows: DataFrame, tiles: int) -> DataFrame:
    """Rows (id, label, v, dim, key) packed as bit planes; in a tile they are ordered by label."""
    def pack(key, t):
        dim = key[0].as_py()
        t = t.sort_by([("label", "ascending"), ("id", "ascending")])
        planes = bit_planes(_matrix(t, dim))
        return _as_batch(_TILE, dim=dim, tile=key[1].as_py(), ids=_longs(t, "id").tobytes(), labels=_longs(t, "label").tobytes(),
                         planes=planes.tobytes(), n_planes=len(planes))

    dealt = rows.withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "id", "key"), F.lit(tiles)))
    return dealt.select("dim", "tile", "id", "label", "v").groupBy("dim", "tile").applyInArrow(pack, _TILE)


def _blocks(anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows (id, key, label, v, dim, given: array<long>) packed; ``given`` are numbers that scoring needs."""
    def pack(key, t):
        dim = key[0].as_py()
        t = t.sort_by([("label", "ascending"), ("id", "ascending"), ("key", "ascending")])
        given = t.column("given").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        return _as_batch(_BLOCK, dim=dim, block=key[1].as_py(), ids=_longs(t, "id").tobytes(), keys=_longs(t, "key").tobytes(),
                         labels=_longs(t, "label").tobytes(), m=_matrix(t, dim).astype("<i8").tobytes(), given=given.tobytes())

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id", "key"), F.lit(blocks)))
    return dealt.select("dim", "block", "id", "key", "label", "v", "given").groupBy("dim", "block").applyInArrow(pack, _BLOCK)


def _met(tiles: DataFrame, blocks: DataFrame, n_tiles: int) -> DataFrame:
    """Every block beside every tile of its length: the blocks, the smaller side, are copied."""
    copies = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))))
    copies = copies.withColumnsRenamed({"ids": "a_ids", "keys": "a_keys", "labels": "a_labels"}).drop("block")
    return tiles.join(copies, ["dim", "tile"]).select("dim", "tile", "ids", "labels", "planes", "n_planes", "a_ids", "a_keys", "a_labels", "m", "given")


class _Pair:
    """A tile beside a block, unpacked."""

    def __init__(self, r: dict):
        self.tile, self.dim = r["tile"], r["dim"]
        self.ids, self.labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
        self.planes = np.frombuffer(r["planes"], np.uint8).reshape(r["n_planes"], -1, len(self.ids))
        self.a_ids, self.a_keys, self.a_labels = (np.frombuffer(r[x], "<i8") for x in ("a_ids", "a_keys", "a_labels"))
        self.m = np.frombuffer(r["m"], "<i8").reshape(len(self.a_ids), -1)
        self.given = np.frombuffer(r["given"], "<i8").reshape(len(self.a_ids), -1)
        self.dtype = _exact_type(self.m, self.planes)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _lists(tile: int, anchor: np.ndarray, key: np.ndarray, pos: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, key, pos, np.full(len(ids), tile // FAN), ids, score.astype(np.int64))],
                                      names=["anchor_id", "key", "pos", "grp", "id", "score"])


def _best_positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each anchor's own label in each tile."""
    for b in batches:
        for r in b.to_pylist():
            p = _Pair(r)
            out = []
            for label in np.unique(p.a_labels):
                lo, hi = np.searchsorted(p.labels, [label, label + 1])
                mine = np.flatnonzero(p.a_labels == label)
                for at in range(0, len(mine) if hi > lo else 0, STEP_A):
                    a = mine[at:at + STEP_A]
                    sums = subset_sums(p.m[a], p.dtype)
                    best = [np.zeros(0, np.int64) for _ in range(3)]
                    for c in range(lo, hi, STEP_C):
                        ids = p.ids[c:min(c + STEP_C, hi)]
                        s = scores(sums, p.planes[:, :, c:min(c + STEP_C, hi)]).T
                        other = p.a_ids[a][:, None] != ids
                        # Only what reaches the k-th score of this step can be among the k first.
                        masked = np.where(other, s.astype(np.int64), NEVER)
                        kth = np.partition(masked, -k, axis=1)[:, -k, None] if len(ids) > k else NEVER
                        i, j = np.nonzero(other & (masked >= kth))
                        entries = [np.concatenate(x) for x in zip(best, (i, masked[i, j], ids[j]))]
                        keep = _first(*entries, k)
                        best = [x[keep] for x in entries]
                    out.append((a[best[0]], best[1], best[2]))
            if out:
                a, s, ids = (np.concatenate(x) for x in zip(*out))
                yield _lists(p.tile, p.a_ids[a], p.a_keys[a], np.zeros(len(a), np.int64), ids, s)


def _best_negatives(batches: Iterator[pa.RecordBatch], k: int, low: int) -> Iterator[pa.RecordBatch]:
    """For each anchor and positive (its score in ``given``) the k best rows of other labels in each tile, in the range."""
    for b in batches:
        for r in b.to_pylist():
            p = _Pair(r)
            given = np.where(p.given == NEVER, -1, p.given)
            least, most = -(-low * given // 100), given  # a positive below 0 has an empty range
            out = []
            for at in range(0, len(p.a_ids), STEP_A):
                a = np.arange(at, min(at + STEP_A, len(p.a_ids)))
                ok = given[a] >= 0
                if not ok.any():
                    continue
                floor = np.where(ok, least[a], np.iinfo(np.int64).max).min(axis=1)[:, None]
                ceiling = np.where(ok, most[a], -1).max(axis=1)[:, None]
                sums = subset_sums(p.m[a], p.dtype)
                best = [np.zeros(0, np.int64) for _ in range(3)]
                for c in range(0, len(p.ids), STEP_C):
                    ids = p.ids[c:c + STEP_C]
                    s = scores(sums, p.planes[:, :, c:c + STEP_C]).T
                    i, j = np.nonzero((s >= floor) & (s <= ceiling))
                    fine = (p.labels[c + j] != p.a_labels[a[i]]) & (ids[j] != p.a_ids[a[i]])
                    i, j = i[fine], j[fine]
                    found = s[i, j].astype(np.int64)
                    entries = [best]
                    for n in range(given.shape[1]):
                        inside = (given[a[i], n] >= 0) & (found >= least[a[i], n]) & (found <= most[a[i], n])
                        entries.append([i[inside] * given.shape[1] + n, found[inside], ids[j[inside]]])
                    entries = [np.concatenate(x) for x in zip(*entries)]
                    keep = _first(*entries, k)
                    best = [x[keep] for x in entries]
                i, n = np.divmod(best[0], given.shape[1])
                out.append((a[i], n, best[1], best[2]))
            if out:
                a, n, s, ids = (np.concatenate(x) for x in zip(*out))
                yield _lists(p.tile, p.a_ids[a], p.a_keys[a], n, ids, s)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k first of each (anchor_id, key, pos): per group of FAN tiles, then over the groups."""
    for by in (["anchor_id", "key", "pos", "grp"], ["anchor_id", "key", "pos"]):
        first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))), 1, k)
        lists = lists.groupBy(*by).agg(first.alias("b")).select(*by, F.posexplode("b").alias("rank", "b")).select(
            *by, (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.i").alias("id"), (-F.col("b.s")).alias("score"))
    return lists


_LISTS = "anchor_id long, key long, pos long, grp long, id long, score long"


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80,
         vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (and positive_rank) of the rows where
    ``is_anchor`` holds; ``label`` is an integer, ``low`` the least share of a positive's score, in percent."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    usable = F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size(vector) > 0)
    rows = vectors.filter(usable).select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"))
    rows = cut(rows.distinct().select("*", F.size("v").alias("dim"), F.xxhash64("label", "v").alias("key")))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anchor").alias("anchors")).first()
    n_tiles, n_blocks = max(1, -(-n.rows // TILE)), max(1, -(-n.anchors // BLOCK))
    tiles = cut(_tiles(rows, n_tiles))
    anchors = rows.filter("is_anchor").select("id", "key", "label", "v", "dim")
    first = _met(tiles, _blocks(anchors.withColumn("given", F.array().cast("array<bigint>")), n_blocks), n_tiles)
    found = cut(_merged(first.mapInArrow(lambda it: _best_positives(it, positives), _LISTS), positives))
    # At most ``positives`` rows an anchor: their scores, best first, filled up to that number.
    scored = found.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("p")).select(
        F.col("anchor_id").alias("id"), "key",
        F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(-F.get("p", i - 1)["s"], F.lit(NEVER))).alias("given"))
    second = _met(tiles, _blocks(anchors.join(scored, ["id", "key"]), n_blocks), n_tiles)
    lists = _merged(second.mapInArrow(lambda it: _best_negatives(it, negatives, low), _LISTS), negatives)
    best = found.select("anchor_id", "key", (F.col("rank") - 1).cast("long").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return lists.join(best, ["anchor_id", "key", "pos"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        (F.col("pos") + 1).cast("int").alias("positive_rank"))
