"""Shared helpers of the text operators: table access, bounded Arrow slices, vectorised hashing.

All hashing is content-only (fixed seeds), so every task, retry and executor names equal
content equally and a lost task can be recomputed with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of text that one numpy step holds at a time (a single longer text is its own step).
SLICE_BYTES = 2 << 20
U64 = np.uint64
#: Bits of the bitmap that tells which rows may have a partner in a join.
SLOTS = 1 << 25


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the data folder, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, cuts the lineage."""
    return cut_lineage(df)


def aside(df: DataFrame, used: set[str]):
    """``df`` with the columns that an operator needs for itself renamed, and the way back to ``df``'s columns."""
    own = {c: f"__own_{c}" for c in df.columns if c in used}
    back = [F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns]
    return df.withColumnsRenamed(own), lambda got: got.select(*back)


def may_match(df: DataFrame, on: list[Column | str], keys: DataFrame, key: list[Column | str]) -> DataFrame:
    """``df`` with a boolean ``_may``: true wherever ``keys`` has a row of equal values (null equals null, types must
    agree), and by chance for about (rows of ``keys``) / ``SLOTS`` of the others. A join that must move texts reads only
    these; the join itself still decides. The broadcast bitmap is bounded: ``SLOTS`` bits."""
    slot = lambda cols: F.pmod(F.xxhash64(F.lit("slot"), *cols), F.lit(SLOTS))
    within = F.col("_slot").bitwiseAND(F.lit((1 << 15) - 1))  # a bitmap of Spark's has 2^15 bits
    bits = keys.select(slot(key).alias("_slot")).groupBy(F.shiftright("_slot", 15).alias("_part")).agg(F.bitmap_construct_agg(within).alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(within, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    may = F.coalesce(F.getbit(byte, F.col("_slot").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return df.withColumn("_slot", slot(on)).join(F.broadcast(bits), F.shiftright("_slot", 15) == F.col("_part"), "left").select(
        *(F.col(f"`{c}`") for c in df.columns), may.alias("_may"))


def row_key(*cols: str) -> Column:
    """64-bit content key; beside ``doc_id`` it tells apart rows that repeat an id."""
    return F.xxhash64(*cols)


def string_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets) of a string/binary Arrow array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = string_parts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)


def is_space(data: np.ndarray) -> np.ndarray:
    """Separators of ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte (start, end) of each word and the first word index of each text (length texts + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~is_space(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (spreads every input bit over the word)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(28)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


BASE = 0x5851F42D4C957F2D  # odd, 5 modulo 8
_INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(bits: int, inverse: bool) -> np.ndarray:
    p = np.full(1 << bits, _INVERSE if inverse else BASE, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2^64."""
    return _powers(max(16, int(n).bit_length()), inverse)[:n]


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 2654435761 + 1))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; :func:`span_hash` turns two of them into a span's hash."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of values[start:end]."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    return mix(raw + (end - start).astype(U64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """One 64-bit hash a word."""
    return span_hash(prefix_hash(byte_values(seed)[data]), start, end)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return x.view(np.int64) if x.dtype == U64 else x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
