"""Byte substring dedup by suffix arrays and longest-previous-factor arrays (operator 10).

Equal strings of ``length`` bytes are brought together by content: each window of ``length`` bytes
picks, of the ``GRAM``-byte strings inside it, the one of least hash; runs of windows with the same
pick are a segment (``f``: hash of the picked string, ``g``: hash of the segment's bytes). Segments
whose f occurs once hold no repeat. Where all segments of an f are equal, or a segment occurs
twice, all their windows repeat. What is left are the borders of repeats: one representative of
each (f, g) goes, with its bytes, to a bucket, where a suffix array is built by prefix doubling and
the longest previous factor of each window start follows from the previous and next smaller
positions in suffix order.

Buckets hold at most about ``BUCKET`` representatives of one f: an f with more (a passage in very
many surroundings) is split by a hash of g, and the first copies that each part finds are then
matched across parts by window hash, as counts. So no group is gathered, however many texts share
a passage.

Texts move only where they may have something to join: a bounded bitmap of the texts with listed
segments, and one of those with copies, keep the others out of the exchange. Files of a finished
step are released before the next.

``keep="none"`` removes every copy, ``keep="first"`` all but the first by (doc_id, content, place).

Defined cases: a null text has no bytes; texts shorter than ``length`` are kept whole; overlapping
copies count; rows that repeat a doc_id are texts of their own; a null doc_id orders first; an empty
table gives an empty result. Removal works on bytes and can cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release
from .common import U64, byte_values, column, cut, may_match, mix, prefix_hash, signed, slices, span_hash, string_parts

LENGTH, BUCKET, BATCH = 400, 512, 1 << 20
_LOW = U64((1 << 28) - 1)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` adjacent keys, by doubling."""
    out, have = key, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int | None = None) -> dict[str, np.ndarray]:
    """Segments of all texts: f, g, text number, first window (byte in the text), number of windows."""
    gram = gram or max(1, length * 5 // 8)
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return {"f": z.astype(U64), "g": z.astype(U64), "doc": z, "at": z, "n": z}
    prefix = prefix_hash(byte_values(3)[data])
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    best = sliding_min((h & ~_LOW) | at.astype(U64), length - gram + 1)  # of window start 0..n-length
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    w = np.arange(n - length + 1)
    w = w[doc[:n - length + 1] == doc[length - 1:]]
    if not len(w):
        z = np.zeros(0, np.int64)
        return {"f": z.astype(U64), "g": z.astype(U64), "doc": z, "at": z, "n": z}
    pick = (best[w] & _LOW).astype(np.int64)
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (w[1:] != w[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(w)))
    start, pick = w[first], pick[first]
    g = mix(span_hash(prefix, start, start + count - 1 + length) + (pick - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    return {"f": h[pick], "g": g, "doc": doc[start], "at": start - offsets[doc[start]], "n": count}


class SuffixOrder:
    """Suffix order by prefix doubling up to ``depth`` bytes (a power of two from 8 on); ranks of each
    doubling are kept for longest-common-prefix queries."""

    def __init__(self, data: np.ndarray, depth: int = 256):
        n = len(data)
        pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
        key = np.zeros(n, U64)
        for i in range(8):
            key = (key << U64(8)) | pad[i:n + i]
        self.n, self.ranks, h = n, {}, 8
        rank = self._rank(key)
        self.ranks[8] = rank
        while h < depth:
            nxt = np.zeros(n, U64)
            if h < n:
                nxt[:n - h] = rank[h:] + 1
            rank = self._rank((rank.astype(U64) << U64(32)) | nxt)
            h *= 2
            self.ranks[h] = rank
        self.depth = h

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        k = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)])) if len(k) else 0
        return out

    def array(self, at: np.ndarray, length: int) -> np.ndarray:
        """The positions ``at`` in order of their first ``length`` bytes (depth < length <= 2 depth), ties by position."""
        a = self.ranks[self.depth][at]
        b = self.ranks[self.depth][np.minimum(at + length - self.depth, self.n - 1)]
        return at[np.lexsort((at, b, a))]

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, at most ``most``, to a multiple of 8 below,
        or exactly ``most``."""
        out, ok = np.zeros(len(i), np.int64), np.minimum(self.n - i, self.n - j)
        # First the whole length by two overlapping ranks, then the ladder.
        last = most - self.depth
        whole = (ok >= most) & (self.ranks[self.depth][i] == self.ranks[self.depth][j])
        ii, jj = np.minimum(i + last, self.n - 1), np.minimum(j + last, self.n - 1)
        whole &= self.ranks[self.depth][ii] == self.ranks[self.depth][jj]
        for h in sorted(self.ranks, reverse=True):
            a, b = np.minimum(i + out, self.n - 1), np.minimum(j + out, self.n - 1)
            out = np.where((out + h <= ok) & (self.ranks[h][a] == self.ranks[h][b]), out + h, out)
        return np.where(whole, most, np.minimum(out, most - 1))


def smaller_before(a: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, or -1, by pointer jumping."""
    p = np.arange(-1, len(a) - 1)
    bad = np.flatnonzero((p >= 0) & (a[np.maximum(p, 0)] > a))
    while len(bad):
        p[bad] = p[p[bad]]
        q = p[bad]
        bad = bad[(q >= 0) & (a[np.maximum(q, 0)] > a[bad])]
    return p


def previous_factors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes starting at ``at``: positions in suffix order, the longest previous factor of
    each (cut at ``length``), and the earlier position that has it (-1: none)."""
    depth = 8
    while depth * 2 < length:
        depth *= 2
    order = SuffixOrder(data, depth)
    sa = order.array(at, length)
    psv = smaller_before(sa)
    nsv = smaller_before(sa[::-1])[::-1]
    nsv = np.where(nsv >= 0, len(sa) - 1 - nsv, -1)
    lpf, source = np.zeros(len(sa), np.int64), np.full(len(sa), -1)
    for p in (psv, nsv):
        has = np.flatnonzero(p >= 0)
        got = order.common(sa[has], sa[p[has]], length)
        better = got > lpf[has]
        lpf[has[better]], source[has[better]] = got[better], sa[p[has[better]]]
    return sa, lpf, source


_TEXT = ["doc_id", "_k"]
_SEGS = "f long, g long, part long, parts long, doc_id long, _k long, place long, bytes binary"
_FOUND = "doc_id long, _k long, at long, n long, w long, parts long, later boolean"


def _occurrences(src: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            x = segments(*string_parts(column(part, "text")), length)
            who = pa.array(x["doc"])
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id").take(who), column(part, "_k").take(who), pa.array(signed(x["f"])), pa.array(signed(x["g"])),
                 pa.array((x["at"] << 20) | x["n"])], names=["doc_id", "_k", "f", "g", "place"])

    return src.mapInArrow(run, "doc_id long, _k long, f long, g long, place long")


def _cut_segments(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the listed segments of each text."""
    names = ["f", "g", "part", "parts", "doc_id", "_k", "place", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            data, offsets = string_parts(column(part, "text"))
            raw, segs = data.tobytes(), column(part, "segs")
            row = np.repeat(np.arange(part.num_rows), np.diff(segs.offsets.to_numpy()))
            flat = segs.flatten()
            place = flat.field("place").to_numpy()
            a = offsets[row] + (place >> 20)
            b = a + (place & ((1 << 20) - 1)) - 1 + length
            for i in range(0, len(row), 2000):
                j = slice(i, i + 2000)
                who = pa.array(row[j])
                cutout = pa.array([raw[x:y] for x, y in zip(a[j].tolist(), b[j].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(c)[i:i + 2000] for c in names[:4]), column(part, "doc_id").take(who),
                                                  column(part, "_k").take(who), pa.array(place[j]), cutout], names=names)

    return docs.mapInArrow(run, _SEGS)


def _bucket_matches(table: pa.Table, length: int) -> pa.RecordBatch:
    """Windows of a bucket's segments that occur twice in it, and those that must meet other parts."""
    # A bucket may hold several parts of one f: earlier means earlier by document, not by part.
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("f", "doc_id", "_k", "place")], null_placement="at_start"))
    data, offsets = string_parts(table.column("bytes"))
    size = np.diff(offsets)
    n = size - length + 1
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    sa, lpf, source = previous_factors(data, offsets[row] + start, length)
    later, first = np.zeros(len(data), bool), np.zeros(len(data), bool)
    copy = lpf >= length
    later[sa[copy]] = True
    first[source[copy]] = True  # every first copy is the source of a neighbour in suffix order
    at = offsets[row] + start
    split = table.column("parts").to_numpy()[row] > 1
    first &= ~later
    keep = np.flatnonzero(later[at] | first[at] | split)
    prefix = prefix_hash(byte_values(3)[data])
    f = table.column("f").to_numpy().view(U64)[row[keep]]
    w = mix(span_hash(prefix, at[keep], at[keep] + length) ^ (f * U64(0xD1342543DE82EF95)))
    who = pa.array(row[keep])
    state = np.where(later[at[keep]], 1, np.where(first[at[keep]], 0, -1))
    return pa.RecordBatch.from_arrays(
        [table.column("doc_id").combine_chunks().take(who), table.column("_k").combine_chunks().take(who),
         pa.array((table.column("place").to_numpy() >> 20)[row[keep]] + start[keep]), pa.array(np.ones(len(keep), np.int64)), pa.array(signed(w)),
         table.column("parts").combine_chunks().take(who), pa.array(state == 1, mask=state < 0)],
        names=["doc_id", "_k", "at", "n", "w", "parts", "later"])


def _buckets(segs: DataFrame, length: int) -> DataFrame:
    """Rows sorted by (f, part): whole groups are put together to batches of about ``BATCH`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in slices(iter([b]), "bytes", BATCH // 4):
                key = np.stack([column(part, "f").to_numpy(), column(part, "part").to_numpy()], 1)
                if held and size >= BATCH:
                    # Close the batch at the first change of group.
                    last = held[-1]
                    prev = np.array([[column(last, "f")[-1].as_py(), column(last, "part")[-1].as_py()]])
                    change = np.flatnonzero((np.concatenate([prev, key])[1:] != np.concatenate([prev, key])[:-1]).any(1))
                    if len(change):
                        if change[0]:
                            held.append(part.slice(0, int(change[0])))
                        yield _bucket_matches(pa.Table.from_batches(held), length)
                        held, size, part = [], 0, part.slice(int(change[0]))
                held.append(part)
                size += sum(string_parts(column(part, "bytes"))[1][-1:])
        if held:
            yield _bucket_matches(pa.Table.from_batches(held), length)

    near = segs.repartition(F.col("f"), F.col("part")).sortWithinPartitions("f", "part", "doc_id", "_k", "place")
    return near.mapInArrow(run, _FOUND)


def copies(src: DataFrame, length: int = LENGTH, keep: str = "none", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, _k, at, n): runs of window starts whose bytes also start elsewhere (or, with
    ``keep="first"``, earlier) of the rows (doc_id, _k, text)."""
    who = F.struct("doc_id", "_k", "place")
    occ = _occurrences(src, length)
    stats = occ.groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    # Written first, so that the join reads two exchanges and a hot f is split.
    stats = cut(stats.filter("c > 1").select("f", (F.col("g0") != F.col("g1")).alias("mixed")))
    release(src.sparkSession)
    hits = cut(occ.join(stats, "f"))
    release(src.sparkSession)
    per = cut(hits.groupBy("f", "g").agg(F.count(F.lit(1)).alias("c"), F.min(who).alias("rep"), F.first("mixed").alias("mixed")))
    settled = hits.join(per.filter("c > 1").select("f", "g", "rep"), ["f", "g"])
    if keep == "first":
        settled = settled.filter(~who.eqNullSafe(F.col("rep")))
    settled = settled.select("doc_id", "_k", F.shiftright("place", 20).alias("at"), F.col("place").bitwiseAND((1 << 20) - 1).alias("n"))
    mixed = per.filter("mixed")
    parts = mixed.groupBy("f").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("long").alias("parts"))
    reps = mixed.join(parts, "f").select(F.col("rep.doc_id").alias("doc_id"), F.col("rep._k").alias("_k"),
                                         F.struct("f", "g", F.pmod(F.xxhash64("g"), "parts").alias("part"), "parts", F.col("rep.place").alias("place")).alias("s"))
    lists = reps.groupBy("doc_id", "_k").agg(F.collect_list("s").alias("segs"))  # at most a text's own segments
    listed = may_match(src, _TEXT, mixed.select("rep.doc_id", "rep._k"), _TEXT).filter("_may").drop("_may")
    texts = listed.alias("d").join(lists.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._k") == F.col("r._k")))
    # Rows that repeat an id and a text stand for one text here: the (f, g) counts know of the others.
    found = _buckets(_cut_segments(texts.select("d.doc_id", "d._k", "text", "segs").dropDuplicates(["doc_id", "_k"]), length), length)
    found = cut(found)
    release(src.sparkSession)
    inside = found.filter("later" if keep == "first" else "later is not null")
    # Between parts of a split f: the first copy of each part, matched by hash.
    place = F.struct("doc_id", "_k", "at")
    cross = found.filter("parts > 1")
    firsts = cross.filter("later is null or not later").groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("rep")).filter("c > 1")
    across = cross.join(firsts.select("w", "rep"), "w")
    if keep == "first":
        across = across.filter(~place.eqNullSafe(F.col("rep")))
    cols = ["doc_id", "_k", "at", "n"]
    return settled.select(cols).unionAll(inside.select(cols)).unionAll(across.select(cols))


def dedup(df: DataFrame, length: int = LENGTH, keep: str = "first", text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row of ``df``."""
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("_k"), F.col(text).alias("text"))
    runs = cut(copies(src, length, keep, bucket).groupBy("doc_id", "_k").agg(F.collect_set(F.struct("at", "n")).alias("runs")))
    release(df.sparkSession)
    marked = may_match(src, _TEXT, runs, _TEXT)
    rows = marked.filter("_may").alias("d").join(runs.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._k") == F.col("r._k")), "left").select("d.doc_id", "text", "runs")
    rows = rows.unionAll(marked.filter("not _may").select("doc_id", "text", F.lit(None).cast(rows.schema["runs"].dataType).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = string_parts(column(part, "text"))
            listed = column(part, "runs")
            row = np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy())) if len(listed.flatten()) else np.zeros(0, np.int64)
            if len(row) and listed.null_count:
                row = np.repeat(np.arange(part.num_rows), [len(x) if x.is_valid else 0 for x in listed])
            flat = listed.flatten()
            a = offsets[row] + flat.field("at").to_numpy() if len(row) else np.zeros(0, np.int64)
            b = a + flat.field("n").to_numpy() - 1 + length if len(row) else a
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
            gone = np.cumsum(depth[:-1]) > 0
            raw_removed = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offsets[:-1][offsets[:-1] < len(data)]] = gone[offsets[:-1][offsets[:-1] < len(data)]]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(np.diff(offsets)), pa.array(raw_removed[offsets[1:]] - raw_removed[offsets[:-1]]),
                 pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]))
