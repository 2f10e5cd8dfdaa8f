"""Near-duplicate components by an exact n-gram Jaccard join (operator 9).

Each text becomes its set of hashed word n-grams; equal sets are one class. Two classes that reach
the threshold share one of the first ``(1 - t) n + 1`` grams of both in any common order of grams;
the order here puts grams that many texts have last. From there:

1. grams shared by several classes are found by a partial aggregate (least and largest class);
2. every class is compared with the least class of each of its shared grams (a star, not all pairs);
   links give first components by alternating large-star / small-star rounds;
3. the least class of a gram is done with it, so grams of two classes are settled. Of the others only
   rows are left whose gram has classes of several components in their size band or the next ones
   (sizes within the threshold lie in the same or the next band);
4. the rows still left meet in tiles of one band, split into blocks of ``BLOCK`` rows, with bitmap
   signatures; pairs of different components are listed there if sizes and bitmaps allow them, in the
   first gram that both have. In crowded grams (more than ``CROWD`` rows of a band) a first round lists
   only the ``NEAREST`` of every row, by differing bits: their links contract groups of near copies, so
   that step 3 leaves few of their rows for the second round, which lists all pairs that are left;
5. a pair is checked first by its hashed bitmaps (their differing bits bound the overlap from
   above), then, if it passes, by an exact intersection of the sorted gram arrays.

So copies in a large group cost one check each, and no link between different components is missed.
The grams that count as frequent are those that lossy counting over all texts finds in at least one
of ``RARE`` texts; there are at most RARE times the mean set size of them, which bounds the
broadcast. Which they are changes the work only, never the result.

Defined cases: fewer words than n are one gram; texts without words (or null) are linked with nothing
and are their own component; rows that repeat an id share its component; a null doc_id gets the
component of its class, and null if nothing there has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release
from .common import U64, aside, byte_values, column, cut, mix, prefix_hash, signed, slices, span_hash, string_parts, word_spans

RARE, LEAST_FREQUENT, BLOCK, STAR, BITS, TILE_BITS, FILTER_BITS = 500, 32, 2048, 256, 1024, 1024, 1 << 24
CROWD, NEAREST, SKETCH, SLICE = 32, 2, 4, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each text, one after the other, and where each set begins."""
    low = _LOWER[data]
    s, e, first = word_spans(low, offsets)
    h = span_hash(prefix_hash(byte_values(5)[low]), s, e)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    prefix = prefix_hash(h)
    at = np.arange(max(0, len(h) - n + 1))
    at = at[doc[at] == doc[at + n - 1]] if len(at) else at
    short = np.flatnonzero((words > 0) & (words < n))
    gram = np.concatenate([span_hash(prefix, at, at + n), span_hash(prefix, first[short], first[short + 1])])
    doc = np.concatenate([doc[at], short])
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[keep], doc[keep]
    return gram, np.searchsorted(doc, np.arange(len(words) + 1))


def class_ids(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit id of each set."""
    size = np.diff(first)
    return mix(span_hash(prefix_hash(mix(gram + U64(17))), first[:-1], first[1:]) ^ (size.astype(U64) * U64(0xD1342543DE82EF95)))


def bitmaps(gram: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: bit b is the parity of the grams hashed to b. A bitmap has at least
    ``BITS`` bits and at least one a gram (a power of two), so large sets don't saturate theirs."""
    size = np.diff(first)
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(size, BITS))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(begin[:-1], size) + ((mix(gram) >> U64(20)).astype(np.int64) & (np.repeat(bits, size) - 1))
    raw = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist())]


def differing_bits(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Differing bits of each pair of bitmaps; a longer one is first folded (by parity) to the shorter."""
    (x, xo), (y, yo) = string_parts(a), string_parts(b)
    nx, ny, out = np.diff(xo), np.diff(yo), np.zeros(len(a), np.int64)
    for u, v in {*zip(nx.tolist(), ny.tolist())}:
        rows, w = np.flatnonzero((nx == u) & (ny == v)), min(u, v)
        fold = lambda z, o, n: np.bitwise_xor.reduce(z[o[rows][:, None] + np.arange(n)].reshape(len(rows), -1, w), axis=1)
        out[rows] = np.bitwise_count((fold(x, xo, u) ^ fold(y, yo, v)).view("<u8")).sum(1)
    return out


def may_link(n1, n2, differing, num: int, den: int):
    """Whether sizes and differing bits allow overlap / union >= num / den: the sets differ in at least
    ``differing`` grams, so the overlap is at most (n1 + n2 - differing) / 2."""
    # 2 * overlap * (den + num) >= 2 * num * (n1 + n2)
    most = np.minimum((n1 + n2 - differing) // 2, np.minimum(n1, n2))
    return most * (den + num) >= num * (n1 + n2)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Exact test by the intersection of two sorted arrays."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


# --- per-text passes --------------------------------------------------------------------------

def _classes(src: DataFrame, n: int) -> DataFrame:
    """kind 0: a row per text (doc_id, _k, c, n, bitmap); kind 1: a task's frequent grams."""
    names = ["kind", "doc_id", "_k", "c", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = np.zeros(0, U64), np.zeros(0, np.int64)
        for part in slices(batches, limit=SLICE):
            gram, first = gram_sets(*string_parts(column(part, "text")), n)
            for at in range(0, part.num_rows, 2000):
                f = first[at:min(at + 2000, part.num_rows) + 1]
                bits = bitmaps(gram[f[0]:f[-1]], f - f[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(f) - 1, np.int32)), column(part, "doc_id")[at:at + 2000], column(part, "_k")[at:at + 2000],
                     pa.array(signed(class_ids(gram, f))), pa.array(np.diff(f)), pa.array(bits, pa.binary())], names=names)
            # Lossy counting: a gram stays while it comes in about every slice.
            t, c = np.unique(gram, return_counts=True)
            t, c = t[c > 1], c[c > 1]
            token, back = np.unique(np.concatenate([token, t]), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([np.maximum(count - 1, 0), c]), minlength=len(token)).astype(np.int64)
            token, count = token[count > 0], count[count > 0]
        if len(token):
            blob = np.stack([token, count.astype(U64)]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.array([None], pa.int64()) for _ in range(2)),
                                              pa.array([0], pa.int64()), pa.array([len(token)], pa.int64()), pa.array([blob], pa.binary())], names=names)

    return src.mapInArrow(run, "kind int, doc_id long, _k long, c long, n long, bits binary")


def _frequent(classes: DataFrame, rows: int) -> np.ndarray:
    """Sorted frequent grams beside their order among themselves (2 x count)."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in column(b, "bits").to_pylist():
                t = np.frombuffer(x, U64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(signed(t[0].copy())), pa.array(signed(t[1].copy()))], names=["t", "k"])

    got = (classes.filter("kind = 1").select("bits").mapInArrow(unpack, "t long, k long").groupBy("t").agg(F.sum("k").alias("k"))
           .filter(F.col("k") >= max(LEAST_FREQUENT, rows // RARE)).toArrow())
    t, k = got.column("t").to_numpy().view(U64), got.column("k").to_numpy()
    order = np.argsort(t)
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((t, k))] = np.arange(len(t))
    return np.stack([t[order], rank[order].astype(U64)]) if len(t) else np.zeros((2, 0), U64)


def _prefix_grams(src: DataFrame, n: int, num: int, den: int, shared) -> DataFrame:
    """(t, c, n2): the grams of each text's prefix; n2 is its size doubled, plus 1 if the gram is in the
    shorter prefix that suffices where the text is the smaller of a pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = shared.value
        for part in slices(batches, limit=SLICE):
            gram, first = gram_sets(*string_parts(column(part, "text")), n)
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            order = mix(gram) >> U64(1)
            if len(often):
                at = np.minimum(np.searchsorted(often, gram), len(often) - 1)
                order = np.where(often[at] == gram, U64(1 << 63) + rank[at], order)
            by = np.lexsort((gram, order, doc))
            place = np.arange(len(gram)) - first[doc]
            probe = size - -(-num * size // den) + 1
            index = size - -(-2 * num * size // (num + den)) + 1
            keep = np.flatnonzero(place < probe[doc])
            c = class_ids(gram, first)
            for i in range(0, len(keep), 100_000):
                j = keep[i:i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram[by[j]])), pa.array(signed(c[doc[j]])), pa.array(2 * size[doc[j]] + (place[j] < index[doc[j]]))], names=["t", "c", "n2"])

    return src.select("text").mapInArrow(run, "t long, c long, n2 long")


# --- pairs ------------------------------------------------------------------------------------

def _plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int, sized: bool = False) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow; ``sized``: their sizes are known to allow them."""
    one = classes.select(F.col("c").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    if not sized:  # sizes first: few pairs get to carry bitmaps
        pairs = pairs.join(one.select("a", "n1"), "a").join(two.select("b", "n2"), "b").filter(
            F.least("n1", "n2") * den >= F.greatest("n1", "n2") * num).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                p = b.slice(at, 5_000)
                ok = may_link(column(p, "n1").to_numpy(), column(p, "n2").to_numpy(), differing_bits(column(p, "b1"), column(p, "b2")), num, den)
                yield pa.RecordBatch.from_arrays([column(p, "a"), column(p, "b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _asked_only(src: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``src`` whose key may be among ``asked`` (r_id, r_k): a filter of ``FILTER_BITS`` bits,
    whatever the input, that spares most texts the exchange. It lets rows through in vain, never drops one."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[column(b, "h").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    key = lambda *c: F.pmod(F.xxhash64(*c), F.lit(FILTER_BITS)).alias("h")
    got = asked.select(key("r_id", "r_k")).coalesce(4).mapInArrow(mark, "bits binary").collect()
    merged = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in got:
        merged |= np.frombuffer(bytes(r.bits), np.uint8)
    shared = src.sparkSession.sparkContext.broadcast(merged)
    names = src.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = column(b, "h").to_numpy()
            yield b.select(names).filter(pa.array((shared.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1))

    return src.withColumn("h", key("doc_id", "_k")).mapInArrow(keep, src.schema)


def _verified(pairs: DataFrame, reps: DataFrame, src: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link. Members b meet a's text in groups of at most about STAR members."""
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / STAR).cast("long").alias("parts"))
    member = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("role"), F.col("b").alias("c"))
    center = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("c"))
    asked = member.unionAll(center).join(reps.select("c", F.col("rep.doc_id").alias("r_id"), F.col("rep._k").alias("r_k")), "c")
    asked = cut(asked)
    # One text of each class; rows that repeat an id and a text are the same text.
    texts = _asked_only(src, asked).alias("s").join(asked.alias("q"), F.col("s.doc_id").eqNullSafe(F.col("q.r_id")) & (F.col("s._k") == F.col("q.r_k"))).select("a", "part", "role", "c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left = None, np.zeros(0, U64)
        for part in slices(batches, limit=SLICE):
            gram, first = gram_sets(*string_parts(column(part, "text")), n)
            out = []
            for i, (a, p, role, c) in enumerate(zip(*(column(part, x).to_pylist() for x in ("a", "part", "role", "c")))):
                own = gram[first[i]:first[i + 1]]
                if role == 0:
                    group, left = (a, p), own
                elif group == (a, p) and links(left, own, num, den):
                    out.append((a, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    near = texts.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "role", "c")
    return near.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(c, comp): the least node of each node's component, by large-star and small-star rounds.
    ``edges`` (a, b) in any direction, read twice; nodes without an edge are not listed."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    while True:
        # Written, so that the join reads two exchanges and a node with very many neighbours is split.
        near = cut(pairs.select(ends).select("x.u", "x.v").groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("z")))
        # A node with a smaller neighbour has no other: every component is a star around its least node.
        if near.filter("m < u and m <> z").isEmpty():
            return near.filter("m < u").select(F.col("u").alias("c"), F.col("m").alias("comp"))
        large = pairs.join(near.select(F.col("u").alias("v"), "m"), "v").select("u", F.least("v", "m").alias("v"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pairs = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())


def _folded(bits: bytes, n: int) -> bytes:
    """The bitmap folded by parity to the least power of two of bits from n / 2 (and ``TILE_BITS``) on: still
    enough for unrelated sets of n grams to differ in more bits than the threshold allows."""
    width = max(TILE_BITS // 8, 1 << max(0, ((n + 1) // 2 - 1).bit_length() - 3))
    if width >= len(bits):
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).tobytes()


_TILE = ["t", "band", "i", "j"]
_NONE = np.iinfo(np.int64).max


def _signatures(classes: DataFrame, live: DataFrame) -> DataFrame:
    """(c, sig, sketch) of the classes in ``live``: the folded bitmap; the ``SKETCH`` least live grams, and in a last
    byte which of them are in the shorter prefix."""
    own = live.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("t", F.col("n2").bitwiseAND(1).alias("s")))), 1, SKETCH).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = [_folded(x, n) for x, n in zip(column(b, "bits").to_pylist(), column(b, "n").to_pylist())]
            sketch = [np.array(t + [_NONE] * (SKETCH - len(t)), "<i8").tobytes() + bytes([sum(bool(x) << i for i, x in enumerate(s))])
                      for t, s in zip(column(b, "t").to_pylist(), column(b, "s").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(b, "c"), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], names=["c", "sig", "sketch"])

    both = classes.join(own, "c").select("c", "n", "bits", F.col("g.t").alias("t"), F.col("g.s").alias("s"))
    return both.mapInArrow(run, "c long, sig binary, sketch binary")


def _first_common(t: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, grams: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Whether gram t is the least one by which the pairs (x, y) meet. The least grams of both decide it, as all that
    are smaller than a common one are among them; pairs without a common one there are kept in every gram."""
    n1, n2 = m[x, 3] >> 1, m[y, 3] >> 1
    a, b = grams[x][:, :, None], grams[y][:, None, :]
    of_a, of_b = short[x][:, :, None], short[y][:, None, :]
    # The smaller set must have the gram in its shorter prefix.
    fine = np.where((n1 < n2)[:, None, None], of_a, np.where((n1 > n2)[:, None, None], of_b, of_a | of_b))
    least = np.where((a == b) & fine, a, _NONE).min(axis=(1, 2))
    return (least == _NONE) | (least == t)


def _tile_matches(t: int, m: np.ndarray, data: np.ndarray, off: np.ndarray, grams: np.ndarray, short: np.ndarray, num: int, den: int, most: int | None) -> np.ndarray:
    """Pairs (c, c) of one tile of gram t, the ``most`` nearest of each row at most. Rows of m: side (0 first, 1 second,
    2 both), c, comp, n2; data and off: their bitmaps."""
    left, right = np.flatnonzero(m[:, 0] != 1), np.flatnonzero(m[:, 0] != 0)
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    # All bitmaps of the tile, folded to its shortest.
    size, begin = np.diff(off), off[:-1]
    w = int(size.min())
    sig = np.zeros((len(m), w // 8), U64)
    for u in np.unique(size):
        rows = np.flatnonzero(size == u)
        sig[rows] = np.bitwise_xor.reduce(data[begin[rows][:, None] + np.arange(u)].reshape(len(rows), -1, w), axis=1).copy().view(U64)
    out = []
    for at in range(0, len(left), 256):
        a, b = left[at:at + 256][:, None], right[None, :]
        n1, n2 = m[a, 3] >> 1, m[b, 3] >> 1
        # The smaller set of a pair must have the gram in its shorter prefix.
        small = np.where(n1 < n2, m[a, 3] & 1, np.where(n1 > n2, m[b, 3] & 1, (m[a, 3] | m[b, 3]) & 1))
        ok = (m[a, 2] != m[b, 2]) & (small == 1) & (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num)
        i, j = np.nonzero(ok)
        i, j = left[at + i], right[j]
        for k in range(0, len(i), 100_000):
            x, y = i[k:k + 100_000], j[k:k + 100_000]
            differing = np.bitwise_count(sig[x] ^ sig[y]).sum(1).astype(np.int64)
            good = np.flatnonzero(may_link(m[x, 3] >> 1, m[y, 3] >> 1, differing, num, den))
            good = good[_first_common(t, x[good], y[good], m, grams, short)]
            if most is not None:
                good = good[np.lexsort((differing[good], x[good]))]
                own = x[good]
                good = good[np.arange(len(own)) - np.searchsorted(own, own) < most]
            out.append(np.stack([m[x[good], 1], m[y[good], 1]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _live(rows: DataFrame, num: int, den: int, more: int = 0) -> DataFrame:
    """The rows (t, c, comp, n2) with their size band, where the gram's classes of that band and its
    neighbours lie in several components; no other row can have part in a new link. ``more``: only bands
    of more than so many of the gram's rows."""
    banded = rows.withColumn("band", F.floor(F.log(F.shiftright("n2", 1).cast("double")) / float(np.log(den / num)) + 1e-9).cast("long"))
    size = banded.groupBy("t", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
    near = size.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("d"))
    near = near.groupBy("t", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.when(F.col("d") == 0, F.col("m"))).alias("m"))
    several = cut(near.filter(F.expr("lo <> hi") & (F.col("m") > more)).select("t", "band"))
    return banded.join(several, ["t", "band"]).select("t", "band", "c", "comp", "n2")


def _tile_pairs(banded: DataFrame, signatures: DataFrame, num: int, den: int, most: int | None = None) -> DataFrame:
    """Pairs of different components in tiles (t, band, block, block) of rows (t, band, c, comp, n2) that sizes and
    bitmaps allow (with ``most``: so many of each row in a tile). The signatures join the rows when their tiles are known;
    without sketches among them, a pair is listed in every gram that it shares."""
    if "sketch" not in signatures.columns:
        signatures = signatures.withColumn("sketch", F.lit(bytearray(np.full(SKETCH, _NONE, "<i8").tobytes() + b"\0")))
    zero = F.lit(0).cast("long")
    # A band's rows meet those of their band and of the band below: both come to the upper band's tile.
    size = banded.groupBy("t", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    near = size.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("d"))
    of = lambda d: F.max(F.when(F.col("d") == d, F.col("blocks")))
    size = cut(near.groupBy("t", "band").agg(of(0).alias("home"), of(1).alias("below"), of(-1).alias("above")).filter("home is not null"))
    home = banded.join(size, ["t", "band"]).withColumn("block", F.pmod(F.xxhash64("c"), "home"))
    cell = lambda i, j, side, up=0: F.struct((F.col("band") + up).alias("band"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    # Home block i meets home blocks below i (as the first of the pair), itself, the blocks of the band below, and as a
    # guest those of the band above.
    block, none = F.col("block"), F.array().cast("array<struct<band:bigint,i:bigint,j:bigint,side:int>>")
    cells = F.concat(
        F.array(cell(block, block, 2)),
        F.when(block > 0, F.transform(F.sequence(zero, block - 1), lambda j: cell(block, j, 0))).otherwise(none),
        F.when(block < F.col("home") - 1, F.transform(F.sequence(block + 1, F.col("home") - 1), lambda i: cell(i, block, 1))).otherwise(none),
        F.when(F.col("below") > 0, F.transform(F.sequence(zero, F.col("below") - 1), lambda j: cell(block, -1 - j, 0))).otherwise(none),
        F.when(F.col("above") > 0, F.transform(F.sequence(zero, F.col("above") - 1), lambda i: cell(i, -1 - block, 1, 1))).otherwise(none))
    met = home.withColumn("x", F.explode(cells)).select("t", "x.band", "x.i", "x.j", "x.side", "c", "comp", "n2")

    def close(t: pa.Table, last: bool) -> tuple[pa.Table, pa.RecordBatch]:
        m = np.stack([t.column(x).to_numpy() for x in (*_TILE, "side", "c", "comp", "n2")], 1).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero((m[1:, :4] != m[:-1, :4]).any(1)) + 1, [len(m)]])
        done = edges[-1] if last else edges[-2]
        data, off = string_parts(t.column("sig"))
        raw = string_parts(t.column("sketch"))[0].reshape(len(m), 8 * SKETCH + 1)
        grams, short = raw[:, :-1].copy().view("<i8"), (raw[:, -1:] >> np.arange(SKETCH, dtype=np.uint8)) & 1 == 1
        # Tiles of a single component have no pair.
        lo, hi = np.minimum.reduceat(m[:, 6], edges[:-1]), np.maximum.reduceat(m[:, 6], edges[:-1])
        found = [_tile_matches(int(m[a, 0]), m[a:b, 4:], data, off[a:b + 1], grams[a:b], short[a:b], num, den, most)
                 for a, b in zip(edges[:-1][lo != hi].tolist(), edges[1:][lo != hi].tolist()) if b <= done]
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
        return t.slice(done), pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_ = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows_ += b.num_rows
            if rows_ > 20_000:
                rest, out = close(pa.concat_tables(held).combine_chunks(), False)
                held, rows_ = [rest], 0
                yield out
        if held and sum(t.num_rows for t in held):
            yield close(pa.concat_tables(held).combine_chunks(), True)[1]

    near = met.join(signatures, "c").select(*_TILE, "side", "c", "comp", "n2", "sig", "sketch").repartition(*(F.col(k) for k in _TILE)).sortWithinPartitions(*_TILE)
    return near.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(t, c, comp, n2): the rows with the components found so far."""
    return rows.select("t", "c", "n2").join(comp, "c", "left").select("t", "c", F.coalesce("comp", "c").alias("comp"), "n2")


def _grouped(df: DataFrame, n: int, num: int, den: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, _k (content key), n (grams) and comp (a number of the component, null without grams) of every row of ``df``."""
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("_k"), F.col(text).alias("text"))
    everything = cut(_classes(src, n))
    rows = everything.filter("kind = 0")
    classes = cut(rows.filter("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("doc_id", "_k")).alias("rep")))
    often = src.sparkSession.sparkContext.broadcast(_frequent(everything, rows.count()))
    grams = _prefix_grams(src, n, num, den, often)
    stats = cut(grams.groupBy("t").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z").select("t", "a"))
    shared = cut(grams.join(stats, "t").distinct())
    del grams, stats
    release(df.sparkSession)
    star = shared.filter("c <> a").select("a", F.col("c").alias("b")).distinct()
    found = cut(_verified(cut(_plausible(star, classes, num, den)), classes, src, n, num, den))
    comp = components(found)
    del star
    release(df.sparkSession)
    # A gram's least class has met all others; the pairs among those are left. First the nearest in crowded grams.
    for most in (NEAREST, None):
        live = cut(_live(_labelled(shared.filter("c <> a"), comp), num, den, CROWD if most else 0))
        late = cut(_plausible(_tile_pairs(live, cut(_signatures(classes, live)), num, den, most), classes, num, den, sized=True))
        if not late.isEmpty():
            found = cut(_verified(late, classes, src, n, num, den))
            # The stars found so far stand for their components' links.
            comp = components(comp.select(F.col("c").alias("a"), F.col("comp").alias("b")).unionAll(found))
        del live, late
        release(df.sparkSession)
    return rows.join(comp, "c", "left").select("doc_id", "_k", "n", F.when(F.col("n") > 0, F.coalesce("comp", "c")).alias("comp"))


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, _k (content key), n_shingles, comp (a number of the component) and component_id of every row of ``df``."""
    own = _grouped(df, n, num, den, text, doc_id)
    least = cut(own.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    return own.join(least, "comp", "left").select(
        "doc_id", "_k", F.col("n").alias("n_shingles"), "comp",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, that with its smallest id (then content), with the columns of ``df``.
    Texts without words are components of their own; of rows that repeat id and text one stays."""
    found = _grouped(df, n, num, den, text, doc_id)
    # How many rows repeat each: only those few need to be made single.
    rows = cut(found.groupBy(F.col("doc_id").alias("_d"), F.col("_k").alias("_h")).agg(F.count(F.lit(1)).alias("_m"), F.first("n").alias("n"), F.first("comp").alias("comp")))
    linked = rows.filter("n > 0").groupBy("comp").agg(F.min(F.struct(F.col("_d").isNull().alias("no_id"), "_d", "_h", "_m")).alias("w")).select("w._d", "w._h", "w._m")
    winners = cut(linked.unionAll(rows.filter("n = 0").select("_d", "_h", "_m")))
    df, back = aside(df, {"_d", "_h", "_m"})
    got = df.join(winners, F.col(doc_id).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h")))
    single = got.filter("_m = 1").unionAll(got.filter("_m > 1").dropDuplicates(["_d", "_h"]))
    return back(single)
