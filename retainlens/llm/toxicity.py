"""Toxicity: a convolutional text classifier trained in numpy (operator 1).

Words (runs of letters, digits and non-ASCII bytes, ASCII lower-cased) and their stems (first
``STEM`` bytes) are hashed to 64 bits; those hashes that occur in enough training documents have an
embedding, all others share a zero vector. A word's vector is the sum of its own and its stem's.
Filters of widths 1, 2 and 3 slide over the whole text, each is max-pooled over it, and a logistic
layer gives the score. Only the text enters the score. ``MEMBERS`` networks are fitted from different
starts and their logits averaged, as single fits vary much; side by side they are one network of more
filters. The decision point is calibrated on training rows kept aside, and shifted to 0.5; thresholds per
language are calibrated likewise and given beside the score.

Training takes every labelled row that is not held out, each whole, and one text of an id that repeats
(that of least hash); scoring reads every text whole. Up to ``LOCAL_ROWS`` rows are fitted in one place.
More are written as word numbers and dealt to shards of about ``SHARD_ROWS``: in each round every shard
fits from the same parameters on a part of its rows, and the parameters are averaged, weighted by rows.
All members read one exchange of a round's rows, and its files are released before the next round. Texts
without a label are left out before the join, as far as a bounded bitmap of the ids tells.
All rows set the vocabulary and the class weights, and all that are kept aside (a fifth) the decision
points, from counts of logits in steps of 1 / ``STEPS``. The size of the model is bounded: the
``MAX_VOCABULARY`` words and stems of most training texts have embeddings.

Defined cases: null or empty texts get the score of a text without words; documents that repeat an
id are scored each; without any labelled row of both classes all scores are 0; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, release
from .common import byte_values, column, may_match, prefix_hash, slices, span_hash, string_parts

MIN_DOCS, MAX_VOCABULARY = 3, 60_000  # numbers of words fit 16 bits
#: Rows fitted in one place and rows of a shard; parts of a shard's rows, each followed by an average; visits of rows
#: that a small shard is run through again for; calibration steps of a logit and their greatest number.
LOCAL_ROWS, SHARD_ROWS, ROUNDS, VISITS, STEPS, TOP = 3_000, 32_000, 4, 45_000, 1024, 1 << 16
POOLED_WORDS = 4096
WIDTHS, FILTERS, DIM, STEM, MEMBERS = (1, 2, 3), 12, 16, 6, 3
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each word and of its stem, index of each text's first word)."""
    if not len(data):
        return np.zeros((0, 2), np.uint64), np.zeros(len(offsets), np.int64)
    word = _IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    prefix = prefix_hash(byte_values(7)[_LOWER[data]])
    # Stems differ from words by their lowest bit.
    word, stem = span_hash(prefix, s, e) | np.uint64(1), span_hash(prefix, s, np.minimum(e, s + STEM)) & ~np.uint64(1)
    return np.stack([word, stem], 1), np.searchsorted(s, offsets)


@dataclass
class Model:
    vocabulary: np.ndarray                    # sorted hashes; embedding row i + 1
    parts: list[dict[str, np.ndarray]]        # parameters of each member
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    cut: float = 0.0

    @cached_property
    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width and place, the response of each embedding row: some times larger than ``parts``, so never sent."""
        return {w: [np.concatenate([p["E"] @ p[f"W{w}"][j] for p in self.parts], axis=1) for j in range(w)] for w in WIDTHS}

    @cached_property
    def bias(self) -> dict[int, np.ndarray]:
        return {w: np.concatenate([p[f"c{w}"] for p in self.parts]) for w in WIDTHS}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "bias")}

    def logits(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        tok = ids_of(self.vocabulary, hashes)
        return pooled(tok, first, self.tables, self.bias) @ self.out + self.shift - self.cut if n else np.zeros(0)


def ids_of(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _laid_out(tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with max(WIDTHS) zero words after each, where each begins, and the places between texts at which no
    filter may start: it would see two texts. One place of zero words alone stays, also in an empty text."""
    n, pad = len(first) - 1, max(WIDTHS) - 1
    size = np.diff(first)
    start = first[:-1] + np.arange(n) * (pad + 1)
    out = np.zeros((len(tok) + n * (pad + 1) + pad, 2), np.int64)
    doc = np.repeat(np.arange(n), size)
    out[np.arange(len(tok)) + doc * (pad + 1)] = tok
    return out, start, ((start + size)[:, None] + np.arange(1, pad + 1)).ravel()


def pooled(tok: np.ndarray, first: np.ndarray, tables, bias) -> np.ndarray:
    """Max-pooled, rectified responses (texts x filters), some texts of about ``POOLED_WORDS`` words at a time, so that
    what is added stays in the processor's cache."""
    rows, at = [], 0
    while at < len(first) - 1:
        end = max(at + 1, int(np.searchsorted(first, first[at] + POOLED_WORDS, side="right")) - 1)
        end = min(end, len(first) - 1)
        t, start, between = _laid_out(tok[first[at]:first[end]], first[at:end + 1] - first[at])
        last, word, stem, out = len(t) - (max(WIDTHS) - 1), np.ascontiguousarray(t[:, 0]), np.ascontiguousarray(t[:, 1]), []
        for w in WIDTHS:
            r = tables[w][0].take(word[:last], 0)
            r += tables[w][0].take(stem[:last], 0)
            for j in range(1, w):
                r += tables[w][j].take(word[j:last + j], 0)
                r += tables[w][j].take(stem[j:last + j], 0)
            r[between] = -np.inf
            out.append(np.maximum(np.maximum.reduceat(r, start, axis=0) + bias[w], 0))
        rows.append(np.concatenate(out, axis=1))
        at = end
    return np.concatenate(rows)


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str], seed: int = 11, epochs: int = 14) -> Model:
    """Fit on word-hash arrays; a fifth is kept aside for the calibration."""
    words, df = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    order = np.argsort(-df, kind="stable")[:MAX_VOCABULARY]
    vocab = np.sort(words[order][df[order] >= MIN_DOCS])
    docs = [ids_of(vocab, t) for t in texts]
    perm = np.random.default_rng(seed).permutation(len(docs))
    hold, fit = perm[:len(docs) // 5], perm[len(docs) // 5:]
    model = _joined(vocab, [_fitted(docs, y, fit, len(vocab), np.random.default_rng([seed, i]), epochs) for i in range(MEMBERS)])
    first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in hold])])
    z = model.logits(np.concatenate([texts[i] for i in hold]) if len(hold) else np.zeros((0, 2), np.uint64), first)
    model.cut = _best_cut(z, y[hold])
    lang = np.array([langs[i] for i in hold], dtype=object)
    for name in sorted(set(lang)):
        at = lang == name
        both = 0 < y[hold][at].sum() < at.sum()
        model.thresholds[name] = float(1 / (1 + np.exp(-(_best_cut(z[at], y[hold][at]) - model.cut)))) if both else 0.5
    return model


def _joined(vocab: np.ndarray, parts: list[dict[str, np.ndarray]]) -> Model:
    """The members side by side: filters of all, their output weights divided by the number of members."""
    out = np.concatenate([p["v"].reshape(len(WIDTHS), FILTERS)[i] for i in range(len(WIDTHS)) for p in parts]) / MEMBERS
    return Model(vocab, parts, out, float(np.mean([p["b"][0] for p in parts])))


def _start(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"E": rng.normal(0, 0.3, (n_words + 1, DIM)), "v": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "b": np.zeros(1)}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS))
        p[f"c{w}"] = np.zeros(FILTERS)
    p = {k: x.astype(np.float32) for k, x in p.items()}
    p["E"][0] = 0
    return p


def _fitted(docs: list[np.ndarray], y: np.ndarray, fit: np.ndarray, n_words: int, rng: np.random.Generator, epochs: int,
            p: dict[str, np.ndarray] | None = None, classes: tuple[int, int] | None = None, batch: int = 32, slow: int = 4) -> dict[str, np.ndarray]:
    """Parameters of one member, by Adam on batches of texts, from ``p`` or a random start; ``classes``: rows of each class
    (of ``y`` by default); the last ``slow`` epochs take smaller steps."""
    p = _start(n_words, rng) if p is None else p
    m, s, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    n0, n1 = classes or ((y == 0).sum(), (y == 1).sum())
    weight = np.where(y == 1, 0.5 / max(1, n1), 0.5 / max(1, n0)) * (n0 + n1)
    grads = {"E": np.zeros_like(p["E"])}
    for epoch in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at:at + batch]
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in rows])])
            t, start, between = _laid_out(np.concatenate([docs[i] for i in rows]), first)
            last, e, saved, feats = len(t) - (max(WIDTHS) - 1), p["E"].take(t[:, 0], 0), [], []
            e += p["E"].take(t[:, 1], 0)
            size = np.diff(np.append(start, last))
            for w in WIDTHS:
                r = sum(e[j:last + j] @ p[f"W{w}"][j] for j in range(w)) + p[f"c{w}"]
                r[between] = -np.inf
                top = np.maximum.reduceat(r, start, axis=0)
                pos, f = np.divmod(np.flatnonzero(r == np.repeat(top, size, axis=0)), FILTERS)
                d = np.searchsorted(start, pos, side="right") - 1
                _, one = np.unique(d * FILTERS + f, return_index=True)
                saved.append((w, pos[one].reshape(len(rows), FILTERS)))
                feats.append(np.maximum(top, 0))
            x = np.concatenate(feats, axis=1)
            drop = (rng.random(x.shape) > 0.3) / 0.7
            z = (x * drop) @ p["v"] + p["b"]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            grads["E"].fill(0)
            grads |= {k: np.zeros_like(a) for k, a in p.items() if k != "E"}
            grads["v"], grads["b"] = (x * drop).T @ g + 1e-4 * p["v"], np.array([g.sum()], np.float32)
            gx = (g[:, None] * p["v"] * drop * (x > 0)).reshape(len(rows), len(WIDTHS), FILTERS)
            for i, (w, pos) in enumerate(saved):
                gf = gx[:, i]
                live = np.flatnonzero(gf)  # dropped and rectified ones add nothing
                grads[f"c{w}"] = gf.sum(0)
                for j in range(w):
                    word = t[pos + j]
                    ev = p["E"][word].sum(2)
                    grads[f"W{w}"][j] = np.einsum("nf,nfd->df", gf, ev)
                    ge = gf.ravel()[live, None] * p[f"W{w}"][j].T[live % FILTERS]
                    for kind in (0, 1):
                        np.add.at(grads["E"], word[..., kind].ravel()[live], ge)
            step += 1
            rate = 0.01 * min(1, step / 50) * (0.3 if epoch >= epochs - slow else 1)
            _step_in_place(p["E"].ravel(), m["E"].ravel(), s["E"].ravel(), grads["E"].ravel(), rate, step)
            for k in p.keys() - {"E"}:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
            p["E"][0] = 0
    return p


def _step_in_place(p: np.ndarray, m: np.ndarray, s: np.ndarray, grad: np.ndarray, rate: float, step: int, decay: float = 2e-6, size: int = 1 << 14) -> None:
    """The same step of Adam for the embeddings, which are most of the parameters: by pieces that stay in the cache."""
    t, u = np.empty(size, p.dtype), np.empty(size, p.dtype)
    for a in range(0, len(p), size):
        x, mm, ss, g = p[a:a + size], m[a:a + size], s[a:a + size], grad[a:a + size]
        tt, uu = t[:len(x)], u[:len(x)]
        g += np.multiply(x, decay, out=tt)
        mm *= 0.9
        mm += np.multiply(g, 0.1, out=tt)
        ss *= 0.999
        np.square(g, out=tt)
        ss += np.multiply(tt, 0.001, out=tt)
        np.divide(mm, 1 - 0.9 ** step, out=tt)
        tt *= rate
        np.divide(ss, 1 - 0.999 ** step, out=uu)
        np.sqrt(uu, out=uu)
        uu += 1e-7
        tt /= uu
        x -= tt


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates best (balanced accuracy; of equals, the middle of the widest gap)."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    right = (np.cumsum(ys == 0) / (ys == 0).sum() + (ys.sum() - np.cumsum(ys)) / ys.sum())[:-1]
    gap = np.diff(zs)
    at = np.lexsort((gap, right))[-1]
    return float((zs[at] + zs[at + 1]) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int | None = None) -> Model | None:
    """A model from all labelled rows that are not held out (with ``per_class``: so many of each class, those of smallest
    id hash); None if a class has no rows."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out("_id"))
    if per_class is not None:
        spread = F.xxhash64(F.lit("train"), "_id")
        chosen = [named.filter(F.col("_y") == c).distinct().orderBy(spread, "_id").limit(per_class) for c in (0, 1)]
        named = chosen[0].unionAll(chosen[1])
    ids = named.groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = documents.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).filter(~held_out())
    one_type = lambda c: [F.col(c).try_cast("long")]
    rows = may_match(rows, one_type("doc_id"), named, one_type("_id")).filter("_may").join(ids, F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), "text", "lang")).alias("_r")).select(
        "doc_id", "_r.text", "_r.lang", "_y")
    folder = f"{ensure_checkpoint_dir(documents.sparkSession).rstrip('/')}/toxicity-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = documents.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    release(documents.sparkSession)  # the exchange of the texts
    if rows.count() > LOCAL_ROWS:
        return _fit_shards(rows, folder)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = hashed_words(*string_parts(column(part, "text")))
            raw = [h[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "lang"), column(part, "_y"), pa.array(raw, pa.binary())],
                                             names=["doc_id", "lang", "_y", "w"])

    got = rows.mapInArrow(words, "doc_id long, lang string, _y int, w binary").collect()  # at most LOCAL_ROWS
    got = sorted(((r.doc_id, r.w, r.lang, r["_y"]) for r in got), key=lambda r: r[0])
    y = np.array([r[3] for r in got], np.int64)
    if not 0 < y.sum() < len(y):
        return None
    return train([np.frombuffer(bytes(r[1]), np.uint64).reshape(-1, 2) for r in got], y, [r[2] for r in got])


def vocabulary(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the ``MAX_VOCABULARY`` words and stems of most texts, each of ``MIN_DOCS`` at least."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = hashed_words(*string_parts(column(part, "text")))
            doc = np.repeat(np.arange(part.num_rows), 2 * np.diff(first))
            flat = h.ravel()
            by = np.lexsort((flat, doc))
            flat, doc = flat[by], doc[by]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
            word, df = np.unique(flat[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(df)], names=["w", "df"])

    found = rows.select("text").mapInArrow(counts, "w long, df long").groupBy("w").agg(F.sum("df").alias("df")).filter(F.col("df") >= MIN_DOCS)
    # Of equal counts, the smallest unsigned hashes.
    top = found.orderBy(F.desc("df"), F.col("w").bitwiseXOR(F.lit(-(1 << 63)))).limit(MAX_VOCABULARY).select("w").toArrow()
    return np.sort(top.column("w").to_numpy().view(np.uint64))


def _fit_shards(rows: DataFrame, folder: str, seed: int = 11) -> Model | None:
    """The model of any number of rows (doc_id, text, lang, _y); only bounded tables reach the driver."""
    spark = rows.sparkSession
    vocab = vocabulary(rows)
    shared = spark.sparkContext.broadcast(vocab)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = hashed_words(*string_parts(column(part, "text")))
            ids = ids_of(shared.value, h).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "lang"), column(part, "_y"), pa.array(
                [ids[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["doc_id", "lang", "_y", "w"])

    kind = "doc_id long, lang string, _y int, w binary"
    part = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(n)).cast("int")
    rows.mapInArrow(numbered, kind).withColumn("_hold", part("hold", 5) == 0).write.option("compression", "zstd").parquet(f"{folder}/numbered")
    data = spark.read.schema(f"{kind}, _hold boolean").parquet(f"{folder}/numbered")
    sizes = {(r["_hold"], r["_y"]): r["count"] for r in data.groupBy("_hold", "_y").count().collect()}
    classes = sizes.get((False, 0), 0), sizes.get((False, 1), 0)
    if not all(classes):
        return None
    shards = -(-sum(classes) // SHARD_ROWS)
    rounds = 1 if shards == 1 else ROUNDS
    epochs = max(1, min(14, -(-VISITS * shards // sum(classes))))
    dealt = data.filter("not _hold").select("doc_id", "_y", "w", part("shard", shards).alias("_shard"), part("round", rounds).alias("_round"))

    p = [_start(len(vocab), np.random.default_rng([seed, i])) for i in range(MEMBERS)]
    shapes = {k: x.shape for k, x in p[0].items()}
    packed = lambda p: np.concatenate([x.ravel() for x in p.values()]).astype(np.float32)
    unpacked = lambda flat: dict(zip(shapes, (x.reshape(z) for x, z in zip(
        np.split(flat, np.cumsum([int(np.prod(z)) for z in shapes.values()])[:-1]), shapes.values()))))
    for r in range(rounds):
        release(spark)  # the exchanges before this round
        sent = spark.sparkContext.broadcast([packed(x) for x in p])
        for i, flat in _round(dealt.filter(F.col("_round") == r).drop("_round"), lambda t, i: packed(_fitted(
                *_shard_rows(t), len(vocab), np.random.default_rng([seed, i, r, t.column("_shard")[0].as_py()]), epochs,
                unpacked(sent.value[i].copy()), classes, 64 if shards > 1 else 32,
                -(-epochs * 4 // 14) if rounds == 1 else epochs * (r + 1 == rounds)))).items():
            p[i] = unpacked(flat)
        sent.destroy()
    model = _joined(vocab, p)
    release(spark)
    _calibrate(model, data.filter("_hold"))
    return model


def _shard_rows(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word numbers, labels and row numbers of a shard, by doc_id."""
    t = t.sort_by("doc_id")
    return [np.frombuffer(x, np.uint16).reshape(-1, 2).astype(np.int64) for x in t.column("w").to_pylist()], t.column("_y").to_numpy(), np.arange(t.num_rows)


def _members(dealt: DataFrame, fitted: Callable[[pa.Table, int], np.ndarray]) -> DataFrame:
    """Parameters that each member has from each shard, averaged by rows (member, at, x). All members are branches of one
    query over the same exchange, which is written once."""
    def branch(i: int) -> DataFrame:
        def shard(t: pa.Table) -> pa.Table:
            flat = fitted(t, i)
            at = range(0, len(flat), 1 << 16)
            return pa.table({"member": pa.array([i] * len(at), pa.int32()), "at": pa.array(list(at), pa.int64()), "n": pa.array([t.num_rows] * len(at), pa.int64()),
                             "x": pa.array([flat[a:a + (1 << 16)].tobytes() for a in at], pa.binary())})

        return dealt.groupBy("_shard").applyInArrow(shard, "member int, at long, n long, x binary")

    def mean(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy().astype(np.float64)
        x = sum(k * np.frombuffer(v.as_py(), np.float32) for k, v in zip(n, t.column("x"))) / n.sum()
        return pa.table({"member": t.column("member")[:1], "at": t.column("at")[:1], "x": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

    return reduce(DataFrame.unionAll, map(branch, range(MEMBERS))).groupBy("member", "at").applyInArrow(mean, "member int, at long, x binary")


def _round(dealt: DataFrame, fitted: Callable[[pa.Table, int], np.ndarray]) -> dict[int, np.ndarray]:
    """The averaged parameters of each member; none, where no rows are dealt."""
    got = sorted(_members(dealt, fitted).collect(), key=lambda g: (g.member, g["at"]))
    return {i: np.concatenate([np.frombuffer(bytes(g.x), np.float32) for g in got if g.member == i]) for i in {g.member for g in got}}


def _calibrate(model: Model, held: DataFrame) -> None:
    """Decision points from the logits of all rows kept aside, as counts of steps."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "w", 1 << 20):
            raw, first = string_parts(column(part, "w"))
            z = pooled(np.frombuffer(raw.tobytes(), np.uint16).reshape(-1, 2).astype(np.int64), first // 4, m.tables, m.bias) @ m.out + m.shift
            step = np.clip(np.round(z * STEPS), -TOP, TOP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([column(part, "lang"), column(part, "_y"), pa.array(step)], names=["lang", "_y", "z"])

    got = held.select("lang", "_y", "w").mapInArrow(logits, "lang string, _y int, z long").groupBy("lang", "z").agg(
        F.count_if(F.col("_y") == 0).alias("n0"), F.count_if(F.col("_y") == 1).alias("n1")).toArrow()  # bounded by languages and steps
    shared.destroy()
    lang, z = np.array(got.column("lang").to_pylist(), dtype=object), got.column("z").to_numpy() / STEPS
    n0, n1 = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    model.cut = _best_step(z, n0, n1)
    for name in sorted(set(lang)):
        at = lang == name
        both = n0[at].sum() > 0 and n1[at].sum() > 0
        model.thresholds[name] = float(1 / (1 + np.exp(-(_best_step(z[at], n0[at], n1[at]) - model.cut)))) if both else 0.5


def _best_step(z: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """``_best_cut`` from counts of each class at logits that may repeat."""
    zs, back = np.unique(z, return_inverse=True)
    n0, n1 = np.bincount(back, n0, len(zs)), np.bincount(back, n1, len(zs))
    if not (n0.sum() and n1.sum()) or len(zs) < 2:
        return 0.0
    right = (np.cumsum(n0) / n0.sum() + (n1.sum() - np.cumsum(n1)) / n1.sum())[:-1]
    at = np.lexsort((np.diff(zs), right))[-1]
    return float((zs[at] + zs[at + 1]) / 2)


def score(documents: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``documents`` without the text, and score, predicted, lang_threshold, flagged (score >= the language's threshold)."""
    names = ("score", "predicted", "lang_threshold", "flagged")
    kept = [f for f in documents.schema.fields if f.name not in (text, *names)]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, text, 1 << 20):
            if m is None:
                z = np.full(part.num_rows, -np.inf)
            else:
                z = m.logits(*hashed_words(*string_parts(column(part, text)))).astype(np.float64)
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-z))
            limit = np.array([m.thresholds.get(x or "", 0.5) if m else 0.5 for x in column(part, lang).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(column(part, f.name) for f in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(limit), pa.array(s >= limit)],
                names=[*(f.name for f in kept), *names])

    return documents.select(*(f"`{f.name}`" for f in kept), text).mapInArrow(run, T.StructType([
        *kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("lang_threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())]))
