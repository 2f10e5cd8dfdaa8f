"""Ranked lexical search with pair-bound MaxScore (operator 13).

Terms are runs of ASCII letters and digits and of all characters from U+0080 on; A-Z are lower-cased.
The queries are taken in blocks of about ``BLOCK_TERMS`` different terms. For each block:

1. one pass over the texts writes, for every document, its number of terms and how often it holds each
   of the block's terms (written to the shared folder), with the tasks' partial document counts;
2. from their sums come the weights: w = floor(1000 ln((2N + 2) / (2 df + 1))); a term's impact in a
   document is w * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L, all in 64-bit integers;
3. tasks build inverted lists with impacts over shards of at least ``SHARD`` documents. The terms of a
   query are paired in the order of their largest impact in the shard; of every pair the intersection
   of the two lists is computed once, with its largest joint impact. What a document can get from a
   pair is at most the largest of that and of the two single maxima, which is often far below their
   sum (two rare terms seldom meet);
4. a query goes through a shard by MaxScore over those pairs: while the bounds of the weakest pairs add
   up to less than the task's 10th best score so far, documents that hold only such terms are skipped;
   of the others, those drop out whose score so far and remaining bounds cannot reach it. What is left
   is scored in full. Equal scores are never skipped, so ties keep their order;
5. the tasks' lists are merged per group of tasks, then over the groups.

Defined cases: null texts and texts without terms have no score, and don't count in N; rows that repeat a
doc_id are documents of their own, as are rows with a null id (last among equal scores); the rows of an
item_id are one query with the terms of all of them, null like any other id; items without terms or
without a match give no row; long texts are taken whole; empty tables give an empty result. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_values, column, cut, prefix_hash, signed, slices, span_hash, string_parts

BLOCK_TERMS, SHARD, GROUPS = 100_000, 2048, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# --- terms --------------------------------------------------------------------------------------

def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte (start, end) of each term and the first term's number of each text (length texts + 1)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _TERM[data]
    cut_here = np.zeros(len(data) + 1, bool)
    cut_here[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | cut_here))
    end = np.flatnonzero(before & (~inside | cut_here))
    return start, end, np.searchsorted(start, offsets)


def _term_hashes(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every term of the texts, and the first term's number of each text."""
    data, offsets = string_parts(part)
    low = _LOWER[data]
    start, end, first = term_spans(low, offsets)
    return span_hash(prefix_hash(byte_values(13)[low]), start, end), end - start, first


class Queries:
    """A block of queries: the terms' hashes (sorted) and lengths, and the terms of each query."""

    def __init__(self, items: list, hashes: list[np.ndarray], lengths: list[np.ndarray]):
        self.items = items
        whole, size = np.concatenate([*hashes, np.zeros(0, U64)]), np.concatenate([*lengths, np.zeros(0, np.int64)])
        self.hash, at = np.unique(whole, return_index=True)
        self.length = size[at]
        self.terms = [np.unique(np.searchsorted(self.hash, h)) for h in hashes]

    def find(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that a query has, and their numbers."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[at] == h) & (self.length[at] == length))
        return hit, at[hit]


# --- first pass ---------------------------------------------------------------------------------

_INDEX = "kind int, docs long, terms long, ids binary, lengths binary, doc binary, term binary, tf binary"


def _index(docs: DataFrame, shared) -> DataFrame:
    """kind 0: a row per slice of texts with its documents (id, null flag, terms) and entries (document, term, tf);
    kind 1: a task's document counts of the terms."""
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def row(kind: int, docs: int, terms: int, *blobs: np.ndarray) -> pa.RecordBatch:
        whole = [pa.array([b.tobytes()], pa.binary()) for b in blobs]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([docs], pa.int64()), pa.array([terms], pa.int64()), *whole], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        df, none = np.zeros(len(q.hash), np.int64), np.zeros(0, np.int64)
        for part in slices(batches):
            h, length, first = _term_hashes(column(part, "text"))
            size = np.diff(first)
            hit, term = q.find(h, length)
            doc = np.searchsorted(first, hit, side="right") - 1
            key, tf = np.unique(doc * max(1, len(q.hash)) + term, return_counts=True)
            doc, term = np.divmod(key, max(1, len(q.hash)))
            df += np.bincount(term, minlength=len(df))
            keep = np.flatnonzero(size > 0)
            ids = column(part, "doc_id")
            marked = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)]).astype("<i8")[:, keep]
            place = np.zeros(len(size), np.int64)
            place[keep] = np.arange(len(keep))
            yield row(0, len(keep), int(size.sum()), marked, size[keep].astype("<i8"), place[doc].astype("<i4"), term.astype("<i4"), tf.astype("<i4"))
        held = np.flatnonzero(df)
        yield row(1, 0, 0, none, none, none, held.astype("<i4"), df[held].astype("<i8"))

    return docs.mapInArrow(run, _INDEX)


def _document_counts(index: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the block: at most one number a term comes to the driver."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, n in zip(column(b, "term").to_pylist(), column(b, "tf").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, "<i4").astype(np.int64)), pa.array(np.frombuffer(n, "<i8"))], names=["term", "n"])

    got = index.filter("kind = 1").select("term", "tf").mapInArrow(unpack, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Score of each entry; n is the number of terms of its document."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:  # beyond 64 bits before the division
        m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 10 + 90 * n * n_docs // max(1, n_terms)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


# --- second pass --------------------------------------------------------------------------------

class Shard:
    """Inverted lists (documents ascending, impacts) of a block's terms over some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, term))
        self.ids, self.doc = ids, doc[order]
        self.impact = impacts(w[term[order]], tf[order], n[self.doc], n_docs, n_terms)
        self.begin = np.searchsorted(term[order], np.arange(len(w) + 1))
        filled = np.flatnonzero(np.diff(self.begin))
        self.most = np.zeros(len(w), np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.impact, self.begin[filled])
        self.joint: dict[tuple[int, int], int] = {}
        self.sum = np.zeros(ids.shape[1], np.int64)  # scratch of a query, zero between queries

    def entries(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[self.begin[t]:self.begin[t + 1]], self.impact[self.begin[t]:self.begin[t + 1]]

    def joint_most(self, a: int, b: int) -> int:
        """Largest joint impact over the intersection of two lists (0 if that is empty), computed once a shard."""
        got = self.joint.get((a, b))
        if got is None:
            (da, ia), (db, ib) = self.entries(a), self.entries(b)
            if len(da) > len(db):
                da, ia, db, ib = db, ib, da, ia
            at = np.minimum(np.searchsorted(db, da), len(db) - 1)
            both = db[at] == da
            got = self.joint[(a, b)] = int((ia[both] + ib[at[both]]).max(initial=0))
        return got

    def pairs(self, terms: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
        """(bound, terms) of the pairs of a query's terms, weakest first."""
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(-self.most[terms], kind="stable")].tolist()
        out = []
        for i in range(0, len(terms), 2):
            own = tuple(terms[i:i + 2])
            single = int(self.most[own[0]])  # the larger of the two
            out.append((max(single, self.joint_most(*own)) if len(own) == 2 else single, own))
        return sorted(out)


def max_score(s: Shard, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that score at least ``least`` and above 0 for a query."""
    pairs = s.pairs(terms)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    below = np.cumsum([b for b, _ in pairs])
    weak = int(np.searchsorted(below, least))  # pairs whose bounds add up to less than ``least``
    if weak == len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = [s.entries(t) for _, own in pairs[weak:] for t in own]
    for d, i in lists:
        s.sum[d] += i  # a list has a document once
    found = np.unique(np.concatenate([d for d, _ in lists]))
    score = s.sum[found]
    s.sum[found] = 0
    for k in range(weak - 1, -1, -1):
        on = score + below[k] >= least
        found, score = found[on], score[on]
        for t in pairs[k][1]:
            d, i = s.entries(t)
            at = np.minimum(np.searchsorted(d, found), len(d) - 1)
            hit = d[at] == found
            score[hit] += i[at[hit]]
    on = (score >= least) & (score > 0)
    return found[on], score[on]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first: higher scores, then smaller ids, null ids last."""
    return np.lexsort((ids[0], ids[1], -score))[:k]


def _search(batches: Iterator[pa.RecordBatch], q: Queries, w: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k first documents of each query (q, doc_id, score)."""
    best = [(np.zeros(0, np.int64), np.zeros((2, 0), np.int64)) for _ in q.items]
    held: list[dict] = []

    def go() -> None:
        at = np.concatenate([[0], np.cumsum([r["docs"] for r in held])])
        read = lambda name, kind: [np.frombuffer(r[name], kind) for r in held]
        ids = np.concatenate([x.reshape(2, -1) for x in read("ids", "<i8")], axis=1)
        doc = np.concatenate([x.astype(np.int64) + a for x, a in zip(read("doc", "<i4"), at)])
        n, term, tf = (np.concatenate(read(name, kind)).astype(np.int64) for name, kind in (("lengths", "<i8"), ("term", "<i4"), ("tf", "<i4")))
        s = Shard(ids, n, doc, term, tf, w, n_docs, n_terms)
        for i, terms in enumerate(q.terms):
            score, own = best[i]
            found, new = max_score(s, terms, int(score[-1]) if len(score) == k else 0)
            if len(found):
                score, own = np.concatenate([score, new]), np.concatenate([own, ids[:, found]], axis=1)
                first = _best(score, own, k)
                best[i] = (score[first], own[:, first])

    for b in batches:
        for r in b.to_pylist():
            held.append(r)
            if sum(x["docs"] for x in held) >= SHARD:
                go()
                held.clear()
    if held:
        go()
    number = np.repeat(np.arange(len(best)), [len(score) for score, _ in best])
    ids = np.concatenate([own for _, own in best] or [np.zeros((2, 0), np.int64)], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids[0], mask=ids[1] != 0), pa.array(np.concatenate([s for s, _ in best] or [ids[0]]))],
                                     names=["q", "doc_id", "score"])


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k first of each query: per group of tasks, then over the groups."""
    lists = lists.withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("d")))), 1, k)
    for by in (["q", "grp"], ["q"]):
        lists = lists.groupBy(*by).agg(first.alias("b")).select(*by, F.posexplode("b").alias("rank", "b")).select(
            *by, (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.d").alias("doc_id"), (-F.col("b.s")).alias("score"))
    return lists


# --- queries ------------------------------------------------------------------------------------

def _query_terms(queries: DataFrame) -> DataFrame:
    """item_id, h, length: the different terms of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, length, first = _term_hashes(column(part, "text"))
            item = np.repeat(np.arange(part.num_rows), np.diff(first))
            _, at = np.unique(np.stack([item.astype(U64), h], 1), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([column(part, "item_id").take(pa.array(item[at])), pa.array(signed(h[at])), pa.array(length[at])], names=["item_id", "h", "length"])

    return queries.mapInArrow(run, "item_id long, h long, length long").distinct()


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of ``docs`` for each item of ``queries``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = cut(_query_terms(queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(query).alias("text"))))
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for i in range(blocks):
        rows = asked.filter(block == i).groupBy("item_id").agg(F.collect_list("h").alias("h"), F.collect_list("length").alias("length")).collect()
        q = Queries([r.item_id for r in rows], [np.array(r.h, np.int64).view(U64) for r in rows], [np.array(r.length, np.int64) for r in rows])
        shared = spark.sparkContext.broadcast(q)
        index = cut(_index(docs, shared))
        total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        w = spark.sparkContext.broadcast(weights(_document_counts(index, len(q.hash)), total.docs))
        n_docs, n_terms = total.docs, total.terms
        lists = index.filter("kind = 0").mapInArrow(
            lambda it, shared=shared, w=w, n_docs=n_docs, n_terms=n_terms: _search(it, shared.value, w.value, n_docs, n_terms, k), "q long, doc_id long, score long")
        names = spark.createDataFrame([(n, x) for n, x in enumerate(q.items)], "q long, item_id long")
        got = _merged(lists, k).join(names, "q").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionAll(got)
    return out
