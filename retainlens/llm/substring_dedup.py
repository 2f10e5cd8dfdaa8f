"""Substring dedup over words by recompression (operator 2).

Each text's words are named by content hashes and then recompressed in rounds: runs of equal symbols
become one symbol (symbol, length), then adjacent pairs whose left and right names fall into the
left and right half of a round's hash partition become one symbol. A name is a hash of what it
stands for, so tasks agree on all names without exchanging them. With every symbol goes its
context: the words that decide that the symbol stands there. Equal word sequences therefore have
equal symbols wherever the context lies inside them.

Every window of ``WINDOW`` words picks an interior symbol (the highest level up to ``TOP_LEVEL`` that
has one inside; of those the least hash), which depends on the window's words alone; runs of windows
that pick the same symbol are a segment. Segments meet in Spark by the hash of the symbol's context
(``f``), with the hash of all their words (``g``):

* f in one document: nothing to remove;
* all segments of f equal: those outside the first document are repeats;
* else the windows of one representative of each (f, g) are compared by their hashes, as
  (window, least doc_id) aggregates.

All groups are aggregates with partial sums or skew-splittable joins; no group is gathered, so
passages that a third of all documents share are spread like any others. A window counts as equal
when f and its own 64-bit hash are equal.

Defined cases: a null text has no words; a document shorter than a window keeps all words; copies
inside one document stay; rows that repeat a doc_id are judged each against smaller ids only; a null
doc_id counts as larger than all ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, aside, column, cut, mix, prefix_hash, signed, slices, span_hash, string_parts, word_hashes, word_spans

WINDOW, TOP_LEVEL = 50, 3


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = TOP_LEVEL) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels 0..rounds of symbols: (name, context start, context end) in word positions. A context
    that needs to know a text's edge reaches one place beyond it."""
    n = len(names)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = first[:-1] - 1, first[1:] + 1
    name, cs, ce = names.copy(), np.arange(n), np.arange(n) + 1
    levels = [(name, cs, ce)]
    for r in range(rounds):
        if not len(name):
            levels.append((name, cs, ce))
            continue
        # Runs.
        edge = np.concatenate([[True], doc[1:] != doc[:-1]])  # first symbol of its text
        head = edge.copy()
        head[1:] |= name[1:] != name[:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(name)))
        tail = at + size - 1
        left = np.where(edge[at], low[doc[at]], np.minimum(cs[at], cs[at - 1]))
        nxt = np.minimum(tail + 1, len(name) - 1)
        last = np.append(edge[1:], True)[tail]
        right = np.where(last, high[doc[at]], np.maximum(ce[tail], ce[nxt]))
        run = name[at]
        name = np.where(size > 1, mix(run * U64(0x9E3779B97F4A7C15) + size.astype(U64)), run)
        cs, ce, doc = left, right, doc[at]
        # Pairs: a left-half name followed by a right-half name of the same text.
        edge = np.concatenate([[True], doc[1:] != doc[:-1]])
        half = (mix(name ^ U64(0xA5A5A5A5 * (2 * r + 1))) >> U64(40)) & U64(1)
        is_left = half == 0
        merge = np.zeros(len(name), bool)
        merge[:-1] = is_left[:-1] & ~is_left[1:] & ~edge[1:]
        gone = np.concatenate([[False], merge[:-1]])
        prev_cs = np.where(edge, low[doc], np.concatenate([cs[:1], cs[:-1]]))
        last = np.append(edge[1:], True)
        next_ce = np.where(last, high[doc], np.append(ce[1:], ce[-1:]))
        # An unmerged left-half name depends on its successor, a right-half one on its predecessor.
        new_cs = np.where(~is_left & ~gone, np.minimum(cs, prev_cs), cs)
        new_ce = np.where(is_left, np.maximum(ce, next_ce), ce)
        joined = mix(name + np.append(name[1:], U64(0)) * U64(0xD1342543DE82EF95))
        keep = ~gone
        name, cs, ce, doc = np.where(merge, joined, name)[keep], new_cs[keep], new_ce[keep], doc[keep]
        levels.append((name, cs, ce))
    return levels


def segments(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, top: int = TOP_LEVEL) -> dict[str, np.ndarray]:
    """Segments of all texts: f, g, text number, first window (word in the text), number of windows."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    w = np.arange(max(0, n - window + 1))
    w = w[doc[w] == doc[w + window - 1]] if len(w) else w
    lo, hi = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    left = np.ones(len(w), bool)
    for level, (name, cs, ce) in reversed(list(enumerate(recompress(hashes, first, top)))):
        rows = np.flatnonzero(left)
        if not len(rows):
            break
        # Symbols whose context lies in the window: numbers a..b-1.
        before = np.concatenate([[0], np.cumsum(np.bincount(np.maximum(cs, -1) + 1, minlength=n + 2))])
        upto = np.cumsum(np.bincount(ce, minlength=n + 2))
        a, b = before[w[rows] + 1], upto[w[rows] + window]
        ok = b > a
        rows, a, b = rows[ok], a[ok], b[ok]
        if not len(rows):
            continue
        key = np.append((mix(name) & ~U64((1 << 28) - 1)) | np.arange(len(name), dtype=U64), ~U64(0))
        pairs = np.empty(2 * len(a), np.int64)
        pairs[::2], pairs[1::2] = a, b
        pick = (np.minimum.reduceat(key, pairs)[::2] & U64((1 << 28) - 1)).astype(np.int64)
        lo[rows], hi[rows] = cs[pick], ce[pick]
        left[rows] = False
    if not len(w):
        z = np.zeros(0, np.int64)
        return {"f": z.astype(U64), "g": z.astype(U64), "doc": z, "at": z, "n": z}
    same = (w[1:] == w[:-1] + 1) & (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1]) & (doc[w[1:]] == doc[w[:-1]])
    at = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.append(at, len(w)))
    prefix = prefix_hash(hashes)
    start, ctx = w[at], lo[at]
    f = span_hash(prefix, ctx, hi[at])
    g = mix(span_hash(prefix, start, start + count - 1 + window) + (ctx - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    return {"f": f, "g": g, "doc": doc[start], "at": start - first[doc[start]], "n": count}


def _parsed(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = string_parts(column(part, text))
    s, e, first = word_spans(data, offsets)
    return data, offsets, s, e, first, word_hashes(data, s, e)


def occurrences(src: DataFrame, window: int, top: int) -> DataFrame:
    """All segments of the rows (doc_id, _k, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            *_, first, h = _parsed(part, "text")
            x = segments(h, first, window, top)
            who = pa.array(x["doc"])
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id").take(who), column(part, "_k").take(who), pa.array(signed(x["f"])), pa.array(signed(x["g"])),
                 pa.array((x["at"] << 20) | np.minimum(x["n"], (1 << 20) - 1))], names=["doc_id", "_k", "f", "g", "place"])

    # A segment has at most ``window`` windows, so its length fits beside its place.
    return src.mapInArrow(run, "doc_id long, _k long, f long, g long, place long")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, _k, w, at) for every window of the listed segments; w is the window's hash joined with f."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            *_, first, h = _parsed(part, "text")
            prefix = prefix_hash(h)
            segs = column(part, "segs")
            size = np.diff(segs.offsets.to_numpy())
            flat = segs.flatten()
            f, place = flat.field("f").to_numpy().view(U64), flat.field("place").to_numpy()
            at, n = place >> 20, place & ((1 << 20) - 1)
            row = np.repeat(np.arange(part.num_rows), size)
            rep = np.repeat(np.arange(len(f)), n)
            start = at[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            abs_ = first[row[rep]] + start
            w = mix(span_hash(prefix, abs_, abs_ + window) ^ (f[rep] * U64(0xD1342543DE82EF95)))
            for i in range(0, len(w), 200_000):
                j = slice(i, i + 200_000)
                who = pa.array(row[rep[j]])
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(who), column(part, "_k").take(who), pa.array(signed(w[j])), pa.array(start[j])],
                                                 names=["doc_id", "_k", "w", "at"])

    return docs.mapInArrow(run, "doc_id long, _k long, w long, at long")


def _later(doc_id: str, least: str):
    """Whether the row's id comes after the least id (null ids come last)."""
    return F.col(least).isNotNull() & (F.col(doc_id).isNull() | (F.col(doc_id) > F.col(least)))


def repeats(src: DataFrame, window: int = WINDOW, top: int = TOP_LEVEL) -> DataFrame:
    """(doc_id, _k, at, n): runs of windows whose words also start in a document of smaller id."""
    occ = occurrences(src, window, top)
    stats = occ.groupBy("f").agg(F.min("doc_id").alias("least"), F.max(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("most"),
                                 F.min("g").alias("g0"), F.max("g").alias("g1"))
    # Written first, so that the join reads two exchanges and a hot f is split.
    stats = cut(stats.filter(F.col("least") < F.col("most")).select("f", "least", (F.col("g0") != F.col("g1")).alias("mixed")))
    hits = cut(occ.join(stats, "f").filter(_later("doc_id", "least") | F.col("mixed")))
    plain = hits.filter(~F.col("mixed")).select("doc_id", "_k", "place")
    unsure = hits.filter("mixed").select("doc_id", "_k", "f", "g", "place")
    # The same segment in an earlier document settles it; else its windows are compared.
    first = unsure.groupBy("f", "g").agg(F.min("doc_id").alias("least"))
    unsure = unsure.join(first, ["f", "g"])
    settled = unsure.filter(_later("doc_id", "least")).select("doc_id", "_k", "place")
    reps = unsure.filter(~_later("doc_id", "least")).groupBy("doc_id", "_k").agg(F.collect_set(F.struct("f", "place")).alias("segs"))
    texts = src.alias("d").join(reps.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._k") == F.col("r._k"))).select("d.doc_id", "d._k", "text", "segs")
    windows = _window_rows(texts, window)
    known = windows.groupBy("w").agg(F.min("doc_id").alias("least"), F.max(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("most"))
    known = known.filter(F.col("least") < F.col("most")).select("w", "least")
    late = windows.join(known, "w").filter(_later("doc_id", "least")).select("doc_id", "_k", F.col("at").alias("at"), F.lit(1).cast("long").alias("n"))
    runs = plain.unionAll(settled).select("doc_id", "_k", F.shiftright("place", 20).alias("at"), F.col("place").bitwiseAND((1 << 20) - 1).alias("n"))
    return runs.unionAll(late)


def dedup(df: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", top: int = TOP_LEVEL, digests: bool = False) -> DataFrame:
    """``df`` with later copies of word windows removed: a text that lost words becomes its kept words
    joined by one space (others stay as they are).

    ``digests``: instead doc_id, n_words, n_removed and kept_sha256 of every document.
    """
    df, back = aside(df, {"_k", "_runs", "_r_id", "_r_k"})
    keyed = df.withColumn("_k", F.xxhash64(text))
    src = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), "_k", F.col(text).alias("text"))
    runs = repeats(src, window, top).groupBy("doc_id", "_k").agg(F.collect_set(F.struct("at", "n")).alias("_runs"))
    runs = runs.select(F.col("doc_id").alias("_r_id"), F.col("_k").alias("_r_k"), "_runs")
    base = keyed.select(F.col(doc_id).alias("doc_id"), "_k", F.col(text).alias("text")) if digests else keyed
    id_type = df.schema[doc_id].dataType
    if digests:
        text, doc_id = "text", "doc_id"
    rows = base.join(runs, F.col(doc_id).cast("long").eqNullSafe(F.col("_r_id")) & (F.col("_k") == F.col("_r_k")), "left").drop("_r_id", "_r_k", "_k")
    names = [f.name for f in rows.schema.fields if f.name != "_runs"]
    out = (T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()),
                         T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
           if digests else T.StructType([f for f in rows.schema.fields if f.name != "_runs"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            data, _ = string_parts(column(part, text))
            raw = data.tobytes()
            _, _, s, e, first, _ = _parsed(part, text)
            listed = column(part, "_runs").to_pylist()
            texts, removed, sha = column(part, text).to_pylist() if not digests else [], [], []
            for i, marks in enumerate(listed):
                a, b = first[i], first[i + 1]
                keep = np.ones(b - a, bool)
                for m in marks or ():
                    keep[m["at"]:m["at"] + m["n"] - 1 + window] = False
                removed.append(int(b - a - keep.sum()))
                if digests or removed[-1]:
                    kept = b" ".join([raw[x:y] for x, y in zip(s[a:b][keep].tolist(), e[a:b][keep].tolist())])
                    if digests:
                        sha.append(hashlib.sha256(kept).hexdigest())
                    else:
                        texts[i] = kept.decode("utf-8")
            if digests:
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(texts, column(part, n).type) if n == text else column(part, n) for n in names], names=names)

    got = rows.mapInArrow(run, out)
    return got if digests else back(got)
