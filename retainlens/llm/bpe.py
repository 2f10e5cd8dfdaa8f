"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices (operator 5).

Each batch's pre-token matches are reduced to distinct ones; those not yet known to the task go
into padded matrices, one per length bucket. In each round every row merges its leftmost pair of
lowest rank (looked up in an open-addressing hash table of pairs), and rows are compacted; rows
without a mergeable pair leave the matrix. Long matches go one by one through the same rule
(:func:`_merge_long`), which merges all equal-rank pairs that precede any better new pair.

Defined cases: null text encodes as empty (no ids, empty bytes); an empty table gives an empty
result; repeated rows are encoded alike; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, slices

#: Distinct matches that a task remembers; beyond it, the memory is emptied (results don't change).
CACHE_MATCHES = 300_000
#: Matches of more bytes than this are merged one by one.
LONG_BYTES = 96
_NONE = np.int64(1 << 40)


class Merger:
    """The merge rule: ids of single bytes (and of a match's last byte), and a hashed table
    (left id, right id) -> merged id, where a lower merged id is the earlier merge."""

    def __init__(self, byte_id: np.ndarray, last_id: np.ndarray, pairs: dict[tuple[int, int], int]):
        self.byte_id, self.last_id = byte_id, last_id
        self._build(np.array([(a << 32) | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64))

    def _build(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.vals = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left):
            free = self.keys[slot[left]] == -1
            want = left[free]
            at, first = np.unique(slot[want], return_index=True)
            self.keys[at], self.vals[at] = keys[want[first]], vals[want[first]]
            done = np.zeros(len(keys), bool)
            done[want[first]] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (size - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above all ranks where the pair does not merge."""
        shape = left.shape
        keys = ((left << 32) | right).ravel()
        bad = (left.ravel() < 0) | (right.ravel() < 0)
        out = np.full(len(keys), _NONE, np.int64)
        slot, left_ = self._slot(keys), np.flatnonzero(~bad)
        for _ in range(self.probes):
            found = self.keys[slot[left_]]
            hit = found == keys[left_]
            out[left_[hit]] = self.vals[slot[left_[hit]]]
            left_ = left_[~hit & (found != -1)]
            if not len(left_):
                break
            slot[left_] = (slot[left_] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)

    def encode_matches(self, matches: list[bytes]) -> list[np.ndarray]:
        """Ids of each match."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(matches)
        size = np.fromiter(map(len, matches), np.int64, len(matches))
        for i in np.flatnonzero(size > LONG_BYTES):
            raw = np.frombuffer(matches[i], np.uint8)
            ids = self.byte_id[raw]
            ids[-1] = self.last_id[raw[-1]]
            out[i] = self._merge_long(ids)
        edges = [0, 4, 8, 12, 16, 24, 32, 48, 64, LONG_BYTES]
        for low, high in zip(edges, edges[1:]):
            rows = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(rows), 65_536):
                part = rows[at:at + 65_536]
                for i, ids in zip(part, self._merge_matrix([matches[i] for i in part], high)):
                    out[i] = ids
        return out

    def _merge_matrix(self, matches: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in matches), np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, matches), np.int64, len(matches))
        ids = np.where(np.arange(width) < length[:, None], self.byte_id[raw], -1)
        at = np.arange(len(raw))
        ids[at, length - 1] = self.last_id[raw[at, length - 1]]
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(ids), 0), _NONE)
        out: list[np.ndarray] = [None] * len(matches)  # type: ignore[list-item]
        row = np.arange(len(matches))
        while len(row):
            at = rank.argmin(axis=1)  # the leftmost of the lowest
            best = rank[np.arange(len(row)), at]
            over = best == _NONE
            for r, x, n in zip(row[over], ids[over], length[over]):
                out[r] = x[:n].copy()
            row, ids, rank, length, at, best = (x[~over] for x in (row, ids, rank, length, at, best))
            if not len(row):
                break
            # Compaction: drop the merged pair's right half by shifting the rest one place left.
            n, w = ids.shape
            take = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ids[np.arange(n), at] = best
            rank = np.take_along_axis(np.concatenate([rank, np.full((n, 1), _NONE)], 1), take, 1)[:, :w - 2]
            length = length - 1
            for side in (-1, 0):  # the two pairs that hold the new id
                p = at + side
                ok = np.flatnonzero((p >= 0) & (p < w - 2))
                rank[ok, p[ok]] = self.pair_rank(ids[ok, p[ok]], ids[ok, p[ok] + 1])
            keep = max(2, int(length.max()))
            ids, rank = ids[:, :keep], rank[:, :keep - 1]
            if rank.shape[1] == 0:
                rank = np.full((n, 1), _NONE)
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long match. A round merges the leftmost lowest pair and, up to the first merge that
        opens a pair of lower rank, the further pairs of the same rank: the sequential order."""
        while len(ids) > 1:
            rank = self.pair_rank(ids[:-1], ids[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            # Of touching pairs, every second one (from the left of each chain) merges.
            chain = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            merged = ids.copy()
            merged[at] = best
            alive = np.ones(len(ids), bool)
            alive[at + 1] = False
            # Neighbours as they stand at each merge: left ones merged already, right ones not yet.
            left = np.where(at > 0, merged[np.maximum(at - 1 - ~alive[np.maximum(at - 1, 0)], 0)], -1)
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            new = np.full(len(at), best)
            worse = np.flatnonzero(np.minimum(self.pair_rank(left, new), self.pair_rank(new, right)) < best)
            if len(worse):
                keep = at[:worse[0] + 1]
                merged, alive = ids.copy(), np.ones(len(ids), bool)
                merged[keep] = best
                alive[keep + 1] = False
            ids = merged[alive]
        return ids


class Vocabulary(Merger):
    """A rank file: tokens are byte strings, and a pair's rank is that of the bytes it makes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = pattern
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (byte_id < 0).any():
            raise ValueError("the vocabulary lacks a rank for some single byte")
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        super().__init__(byte_id, byte_id, pairs)


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One table a worker process."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary(path, pattern)
    return _VOCABULARIES[path, pattern]


def _units(text: str) -> list[str]:
    """Cut where a space follows a non-space: no match of the pattern crosses such a place, and
    the matches after it don't depend on what is before it. Texts with a space after another
    white-space character are not cut."""
    if _SPACE_RUN.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if rest else [first]


_SPACE_RUN = re.compile(r"\s ")


def encode_texts(vocab: Vocabulary, texts: list[str], known: dict[str, tuple[int, ...]]) -> list[list[int]]:
    """Ids of each text. ``known`` maps matches, and units (runs of matches from a space on), to
    ids and is filled here."""
    find = regex.compile(vocab.pattern).findall
    split = [_units(t) for t in texts]
    units = {u: find(u) for u in {u for units in split for u in units if u not in known}}
    new = list({m for words in units.values() for m in words if m not in known})
    for m, ids in zip(new, vocab.encode_matches([m.encode("utf-8", "surrogatepass") for m in new])):
        known[m] = tuple(ids.tolist())  # tuples of numbers don't burden the garbage collector
    for u, words in units.items():
        if len(words) != 1:
            known[u] = tuple(chain.from_iterable(map(known.__getitem__, words)))
    return [list(chain.from_iterable(map(known.__getitem__, units))) for units in split]


def decode_ids(vocab: Vocabulary, ids: list[int]) -> bytes:
    return b"".join(map(vocab.token.__getitem__, ids))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int) for the text; the other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path, pattern), {}
        for part in slices(batches, text):
            got = encode_texts(vocab, [t or "" for t in column(part, text).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.int32()))],
                                             names=[*part.schema.names, ids])
            if len(known) > CACHE_MATCHES:
                known.clear()

    base = df.drop(ids)
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary) for the ids; null ids decode as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [decode_ids(vocab, x or []) for x in column(part, ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())],
                                                 names=[*part.schema.names, out])

    base = df.drop(out)
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Digests of encoding and decoding, in one pass: n_tokens, ids_sha256, decoded_sha256.

    The same as :func:`encode`, then :func:`decode`, then hashing, without moving ids through
    the JVM.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path, pattern), {}
        shown = [str(i) for i in range(len(vocab.token))]
        for part in slices(batches, text):
            n, left, right = [], [], []
            for ids in encode_texts(vocab, [t or "" for t in column(part, text).to_pylist()], known):
                n.append(len(ids))
                left.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                right.append(hashlib.sha256(decode_ids(vocab, ids)).hexdigest())
            keep = [i for i, f in enumerate(part.schema.names) if f != text]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in keep), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())],
                names=[*(part.schema.names[i] for i in keep), "n_tokens", "ids_sha256", "decoded_sha256"])
            if len(known) > CACHE_MATCHES:
                known.clear()

    kept = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, T.StructType([
        *kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())]))
