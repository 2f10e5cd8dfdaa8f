"""Exact top-k search by tiled matrix products (operator 8).

Vectors are packed into tiles (matrices of at most ``TILE`` rows, as binary rows), queries into
blocks of at most ``BLOCK``. Each tile meets each query block once, in an equi-join on the block
number; the product is a float64 matrix product (exact for integers below 2^53), each query keeps
the ``k`` best of the tile by (score descending, id ascending), and the lists are merged in a
tree: per group of ``FAN`` tiles, then over the groups. No row is left out, and no task holds
more than one tile, one block and their lists.

Defined cases: null vectors and vectors with null or non-finite components take no part, nor do
rows with a null id; vectors of different lengths are only compared within their length; rows
that repeat an id are candidates each, but never of a query with the same id; fewer than k
candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, BLOCK, FAN = 8192, 1024, 16


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows (id, v: array<double>, dim) -> (dim, ``name``, ids binary, matrix binary)."""
    def run(key, t):
        t = t.sort_by("id")
        ids = t.column("id").to_numpy().astype("<i8")
        m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.Table.from_pydict({"dim": [key[0].as_py()], name: [key[1].as_py()], "ids": [ids.tobytes()], "m": [m.tobytes()]},
                                    schema=pa.schema([("dim", pa.int32()), (name, pa.int64()), ("ids", pa.binary()), ("m", pa.binary())]))

    return df.groupBy("dim", name).applyInArrow(run, f"dim int, {name} long, ids binary, m binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k best by (score descending, id ascending); ids ascend.
    Partial selection, then all ties with the k-th score are looked at."""
    n = scores.shape[1]
    if n > 4 * k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    else:
        kth = scores.min(axis=1)
    q, c = np.nonzero(scores >= kth[:, None])
    s = scores[q, c]
    order = np.lexsort((ids[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    ok = (rank < k) & np.isfinite(s)
    return q[ok], np.stack([ids[c[ok]], s[ok].astype(np.int64)], 1)


def _score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("query_id", pa.int64()), ("grp", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for b in batches:
        for r in b.to_pylist():
            qi, ci = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            q = np.frombuffer(r["q_m"], "<f8").reshape(len(qi), r["dim"])
            c = np.frombuffer(r["m"], "<f8").reshape(len(ci), r["dim"])
            for at in range(0, len(qi), 128):
                scores = q[at:at + 128] @ c.T
                scores[qi[at:at + 128][:, None] == ci[None, :]] = -np.inf
                row, got = _best(ci, scores, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[at + row]), pa.array(np.full(len(row), r["tile"] // FAN)), pa.array(got[:, 0]), pa.array(got[:, 1])], schema=schema)


def _merge(df: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of each key; a key has at most FAN (or tiles / FAN) lists of k."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k)
    return df.groupBy(*key).agg(best.alias("b")).select(*key, F.posexplode("b").alias("rank", "b")).select(
        *key, (F.col("rank") + 1).alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row where ``is_query`` holds.

    Components become floor(``scale`` * x), so scores are exact integers (below 2^53).
    """
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    src = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size(vector) > 0))
    src = src.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim"), is_query.alias("is_query"))
    sizes = src.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    tiles, blocks = -(-sizes.n // (TILE // 2)) or 1, -(-sizes.q // (BLOCK // 2)) or 1
    # Dealt by a hash of the whole row's id and content: even also when ids repeat.
    spread = F.xxhash64(F.lit("t"), "id", "v")
    cand = _packed(src.withColumn("tile", F.pmod(spread, F.lit(tiles))).select("dim", "tile", "id", "v"), TILE, "tile")
    query = _packed(src.filter("is_query").withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "id", "v"), F.lit(blocks))).select("dim", "block", "id", "v"), BLOCK, "block")
    cand = cand.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = cand.join(query.select("dim", "block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m")), ["dim", "block"])
    pairs = pairs.repartition(min(tiles * blocks, 4096), "tile", "block")
    lists = pairs.mapInArrow(lambda it: _score(it, k), "query_id long, grp long, vec_id long, score long")
    return _merge(_merge(lists, ["query_id", "grp"], k).drop("rank"), ["query_id"], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
