"""Quality rules with robust multivariate outliers (operator 7).

Every text gets counts (words, characters in words, symbols, repeated lines and word windows) and
a vector of transformed statistics. Per language and source, a minimum-covariance-determinant
estimate (deterministic start from medians and MADs, then concentration steps over the
``COVERAGE`` share of rows of least distance) gives a centre and a scatter; a document is
rejected when its squared Mahalanobis distance, scaled by the group's median, exceeds ``CUTOFF``
times the chi-square median, or when a base rule fails.

All steps are grouped aggregates over the statistics table (partial sums before the shuffle), so a
source with a third of all rows is no bottleneck. A source with fewer than ``MIN_ROWS`` rows is
judged by the estimate over all rows of its language; the centre, scatter and scale of a language
with n < ``MIN_ROWS`` rows are its own at weight n / ``MIN_ROWS`` and those of all rows of the corpus
for the rest. So every text with words has a distance at every size of the corpus.

Defined cases: a null or empty text has no words, fails the base rule and takes no part in the
estimates; null ``lang`` or ``source`` is a group of its own; repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, column, cut, is_space, prefix_hash, byte_values, slices, span_hash, string_parts, word_spans

COVERAGE, STEPS, MIN_ROWS = 0.75, 3, 200
#: Distances are in multiples of the group's median; a Gaussian cloud has no row in 1e25 beyond.
CUTOFF = 20.0
#: Standard deviations below these are raised to them (most documents have none of a symptom).
FEATURES = {"log_words": 0.3, "word_length": 0.05, "symbols": 0.03, "dup_lines": 0.15, "repeats": 0.15,
            "upper": 0.03, "digits": 0.06, "distinct": 0.05}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def _same(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its (doc, key) occurred before, and whether it occurs again at all."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    equal = np.zeros(len(order) + 1, bool)
    equal[1:-1] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    later, any_ = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = equal[:-1]  # lexsort is stable: the first of equals keeps its place
    any_[order] = equal[:-1] | equal[1:]
    return later, any_


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and features of each text of a slice."""
    n = len(offsets) - 1
    s, e, first = word_spans(data, offsets)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    chars = (data & 0xC0) != 0x80
    out = {"n_words": words, "word_chars": _sums(chars & ~is_space(data), offsets), "n_symbols": _sums(_SYMBOL[data], offsets)}
    # Lines: cut at \n and at text ends; a line counts if a word starts in it.
    newline = data == 10
    cuts = np.flatnonzero(newline)
    line_start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    # A start at a text's end (its last character is \n, or an empty text) is an empty line.
    ok = line_start < offsets[np.minimum(line_doc + 1, n)] if n else np.zeros(0, bool)
    line_start, line_doc = line_start[ok], line_doc[ok]
    keep = np.concatenate([[True], np.diff(line_start) > 0]) if len(line_start) else np.zeros(0, bool)
    line_start, line_doc = line_start[keep], line_doc[keep]
    nxt = np.searchsorted(cuts, line_start)
    line_end = np.minimum(np.append(cuts, len(data))[nxt], offsets[line_doc + 1])
    has = np.searchsorted(s, line_end) > np.searchsorted(s, line_start)
    line_start, line_end, line_doc = line_start[has], line_end[has], line_doc[has]
    prefix = prefix_hash(byte_values(1)[data])
    later, _ = _same(line_doc, span_hash(prefix, line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n).astype(np.int64)
    # Word windows found twice or more in their text.
    h = span_hash(prefix, s, e)
    k = REPEAT_WINDOW
    at = np.arange(max(0, len(s) - k + 1))
    at = at[doc[at] == doc[at + k - 1]] if len(at) else at
    _, twice = _same(doc[at], span_hash(prefix_hash(h), at, at + k))
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, first)
    later, _ = _same(doc, h)
    some, length = np.maximum(words, 1), np.maximum(_sums(chars, offsets), 1)
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    out |= {"log_words": np.log(some), "word_length": np.log(np.maximum(out["word_chars"], 1) / some),
            "symbols": share(out["n_symbols"], length), "dup_lines": share(out["n_dup_lines"], lines),
            "repeats": share(out["n_repeat_words"], some), "upper": share(_sums(_UPPER[data], offsets), length),
            "digits": share(_sums(_DIGIT[data], offsets), length),
            # log of types per log of tokens hardly depends on the length
            "distinct": np.log(np.maximum(some - np.bincount(doc[later], minlength=n), 1)) / np.log(some + 1)}
    return out


def add_statistics(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` (the text only where asked for) and the counts (long) and features (``_f_*``, double)."""
    names = [*COUNTS, *(f"_f_{f}" for f in FEATURES)]
    read = [f for f in df.schema.fields if f.name not in names]
    kept = [f for f in read if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            got = text_counts(*string_parts(column(part, text)))
            made = [pa.array(got[c].astype(np.int64)) for c in COUNTS] + [pa.array(got[f].astype(np.float64)) for f in FEATURES]
            yield pa.RecordBatch.from_arrays([*(column(part, f.name) for f in kept), *made], names=[*(f.name for f in kept), *names])

    return df.select(*(f"`{f.name}`" for f in read)).mapInArrow(run, T.StructType([
        *kept, *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(f"_f_{f}", T.DoubleType()) for f in FEATURES)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _distance(groups: str = "_g") -> Column:
    """Squared Mahalanobis distance of a row to its group's centre by its packed inverse scatter."""
    x = [F.col(f"_f_{f}") - F.col(f"{groups}.center")[i] for i, f in enumerate(FEATURES)]
    terms, at = [], 0
    for i in range(len(x)):
        for j in range(i, len(x)):
            terms.append(x[i] * x[j] * F.col(f"{groups}.inverse")[at] * (1 if i == j else 2))
            at += 1
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _moments(n, s, q) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows with sums ``s`` and packed sums of products ``q``."""
    p = len(s)
    c = np.asarray(s) / n
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = np.asarray(q) / n
    return c, m + np.triu(m, 1).T - np.outer(c, c)


def _inverses(top):
    """Group rows (sums over the chosen rows) -> centre and packed inverse scatter. Small languages
    are shrunk towards ``top``, the sums of the corpus."""
    def run(batches):
        import pandas as pd
        floor = np.array(list(FEATURES.values()))
        p = len(floor)
        for pdf in batches:
            centers, inverses = [], []
            for lang, rows, n, s, q in zip(pdf["_lang"], pdf["rows"], pdf["n"], pdf["s"], pdf["q"]):
                c, m = _moments(n, s, q)
                if top is not None and lang != ALL and rows < MIN_ROWS:
                    w, (c0, m0) = rows / MIN_ROWS, _moments(*top)
                    c, m = w * c + (1 - w) * c0, w * m + (1 - w) * m0
                sd = np.sqrt(np.maximum(np.diag(m), 1e-18))
                corr = np.clip(m / np.outer(sd, sd), -1, 1) * (sd > floor / 10)[:, None] * (sd > floor / 10)[None, :]
                corr = 0.9 * corr  # shrunk towards independence: never singular
                np.fill_diagonal(corr, 1.0)
                sd = np.maximum(sd, floor)
                centers.append(c)
                inverses.append(np.linalg.inv(corr * np.outer(sd, sd))[np.triu_indices(p)])
            yield pd.DataFrame({"_lang": pdf["_lang"], "_source": pdf["_source"], "rows": pdf["rows"], "center": centers, "inverse": inverses})
    return run


#: Groups of up to this number are broadcast (about 12 MB).
FEW_GROUPS = 20_000
#: Group of all rows of the corpus (both names) or of a language (as its source).
ALL = "*"
_GROUP = "_lang string, _source string, rows long, center array<double>, inverse array<double>"


def _name(c: str) -> Column:
    """Name of a language or source in group keys: never null, never ``ALL``."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~"))


def _few(groups: DataFrame) -> DataFrame:
    """Written groups (at most about 600 bytes each), sent to every task if counting shows at most ``FEW_GROUPS``;
    else both sides are shuffled and adaptive execution splits a hot group."""
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups


def _joined(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    g = groups.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"),
                      F.struct(*[c for c in groups.columns if c not in ("_lang", "_source")]).alias("_g"))
    return rows.join(_few(g), (F.col("_lang") == F.col("_l")) & (F.col("_source") == F.col("_s")), how).drop("_l", "_s")


def pools(stats: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, bool]:
    """Of each (lang, source): the groups (``_lang``, ``_source``) that its rows are estimated in, the one
    that judges them first; and whether a language is small, so that the corpus is a group too."""
    per = cut(stats.groupBy(_name(lang).alias("_pl"), _name(source).alias("_ps")).agg(F.count_if(F.col("n_words") > 0).alias("n")))
    langs = cut(per.groupBy(F.col("_pl").alias("_l")).agg(F.sum("n").alias("n_lang"), F.max(F.col("n") < MIN_ROWS).alias("mixed")))
    rare = not langs.filter(F.col("n_lang") < MIN_ROWS).isEmpty()
    group = lambda on, l, s: F.when(on, F.struct(l.alias("_lang"), s.alias("_source")))
    names = F.array(group(F.col("n") >= MIN_ROWS, F.col("_pl"), F.col("_ps")), group(F.col("mixed"), F.col("_pl"), F.lit(ALL)),
                    group(F.lit(rare), F.lit(ALL), F.lit(ALL)))
    return cut(per.join(langs, F.col("_pl") == F.col("_l")).select("_pl", "_ps", F.array_compact(names).alias("_groups"))), rare


def with_pool(stats: DataFrame, pool: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    return stats.join(_few(pool), (_name(lang) == F.col("_pl")) & (_name(source) == F.col("_ps")), "left").drop("_pl", "_ps")


def fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(pools, estimates): estimates hold centre, inverse scatter and the median distance ``scale``."""
    feats = [f"_f_{f}" for f in FEATURES]
    pool, rare = pools(stats, lang, source)
    own = with_pool(stats.filter(F.col("n_words") > 0), pool, lang, source).select(F.explode("_groups").alias("_to"), *feats)
    rows = cut(own.select("_to.*", *feats))
    key, p = ["_lang", "_source"], len(feats)
    med = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f) for f in feats])
    spread = [F.greatest((F.col(f)[2] - F.col(f)[0]) / 1.349, F.lit(FEATURES[f[3:]])) for f in feats]
    packed = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(i, p)]
    groups = cut(med.select(*key, "rows", F.array(*[F.col(f)[1] for f in feats]).alias("center"), F.array(*packed).alias("inverse")))
    xx = [F.col(feats[i]) * F.col(feats[j]) for i in range(p) for j in range(i, p)]
    whole = (F.col("_lang") == ALL) & (F.col("_source") == ALL)
    for _ in range(STEPS):
        near = _joined(rows, groups).withColumn("_d", _distance())
        limit = cut(near.groupBy(*key).agg(F.percentile_approx("_d", COVERAGE, 2000).alias("limit"), F.first("_g").alias("g"))
                    .select(*key, "limit", "g.rows", "g.center", "g.inverse"))
        chosen = _joined(rows, limit).filter(_distance() <= F.col("_g.limit"))
        sums = cut(chosen.groupBy(*key).agg(F.first("_g.rows").alias("rows"), F.count(F.lit(1)).alias("n"),
                                            F.array(*[F.sum(f) for f in feats]).alias("s"), F.array(*[F.sum(x) for x in xx]).alias("q")))
        top = sums.filter(whole).select("n", "s", "q").first() if rare else None
        groups = cut(sums.mapInPandas(_inverses(top and tuple(top)), _GROUP))
    scale = (_joined(rows, groups).withColumn("_d", _distance())
             .groupBy(*key).agg(F.percentile_approx("_d", 0.5, 2000).alias("scale"), F.first("_g").alias("g")))
    out = cut(scale.select(*key, "g.rows", "g.center", "g.inverse", F.greatest("scale", F.lit(1.0)).alias("scale")))
    top = out.filter(whole).select("scale").first() if rare else None
    if top is not None:
        w = F.least(F.col("rows") / MIN_ROWS, F.lit(1.0))
        out = out.withColumn("scale", F.when(F.col("_lang") == ALL, F.col("scale")).otherwise(w * F.col("scale") + (1 - w) * top.scale))
    return pool, out


def judge(stats: DataFrame, pool: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``base_failed``, ``distance`` (in multiples of the group's median; null only for texts
    without words where no text of their language has any) and ``kept``."""
    group = F.col("_groups")[0]
    rows = with_pool(stats, pool, lang, source).withColumns({"_lang": group["_lang"], "_source": group["_source"]})
    out = _joined(rows, estimates, "left").withColumn("base_failed", base_failed()).withColumn("distance", _distance() / F.col("_g.scale"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))).drop(
        "_lang", "_source", "_groups", "_g", *(f"_f_{f}" for f in FEATURES))


def quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``df`` but the text, the counts, base_failed, distance and kept."""
    taken = {*COUNTS, "base_failed", "distance", "kept", "_lang", "_source", "_groups", "_g"}
    src = df.drop(*(taken & set(df.columns)))
    stats = cut(add_statistics(src, text, keep_text=False))  # one pass over the texts
    pool, est = fit(stats.select(lang, source, "n_words", *(f"_f_{f}" for f in FEATURES)), lang, source)
    return judge(stats, pool, est, lang, source)


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df``."""
    df, back = aside(df, {*COUNTS, "base_failed", "distance", "kept", "_lang", "_source", "_groups", "_g", "_pl", "_ps", "_l", "_s", "_d"})
    # One pass for the estimates, written without texts; one for the verdicts, which keeps them.
    pool, est = fit(cut(add_statistics(df.select(*dict.fromkeys((lang, source, text))), text, keep_text=False)), lang, source)
    return back(judge(add_statistics(df, text), pool, est, lang, source).filter("kept"))
