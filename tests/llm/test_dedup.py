"""Substring, byte and near-duplicate operators against brute force."""
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from .conftest import WORD, shuffle_files
from retainlens.llm import jaccard, substring_dedup, suffix_dedup
from retainlens.llm.common import may_match

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_repeats(docs, k):
    first = {}
    for d, t in sorted(docs):
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), d)
    out = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def byte_repeats(docs, k, keep):
    count, first = collections.Counter(), {}
    for x, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            count[b[i:i + k]] += 1
            first.setdefault(b[i:i + k], (x, i))
    out = {}
    for x, (d, t) in enumerate(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if count[b[i:i + k]] > 1 and (keep == "none" or first[b[i:i + k]] != (x, i)):
                gone[i:i + k] = b"\1" * k
        left = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def near(docs, n, num, den):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def woven():
    """Texts that copy pieces of one another, with runs of one word."""
    r, docs = random.Random(3), []
    for i in range(110):
        w = [r.choice("ab" if i % 2 else "abcdefgh") for _ in range(r.randint(0, 160))]
        if docs and r.random() < .6:
            o = r.choice(docs)[1].split()
            x = r.randint(0, max(0, len(o) - 1))
            p = r.randint(0, len(w))
            w[p:p] = o[x:x + r.randint(20, 90)]
        if r.random() < .1:
            w = ["a"] * r.randint(20, 120) + w
        docs.append((i, " ".join(w)))
    return docs + [(500, None), (501, "")]


@pytest.fixture(scope="module")
def edited():
    r, docs = random.Random(4), []
    for i in range(120):
        w = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(0, 70))]
        if docs and r.random() < .75:
            w = r.choice(docs[-20:])[1].split() or w
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(["Q", "zz", "R"])
        docs.append((i, " ".join(w)))
    return docs + [(500, None)]


@pytest.mark.parametrize("k", [13, 50])
def test_word_windows(spark, woven, k):
    df = spark.createDataFrame(woven, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(df, window=k, digests=True).collect()}
    want = word_repeats(woven, k)
    assert got == want and any(v[1] for v in want.values())


def test_recompression_is_local():
    """Equal word sequences have equal symbols wherever the context lies inside them."""
    import numpy as np
    r = np.random.default_rng(1)
    body = r.integers(1, 6, 200).astype(np.uint64)
    texts = [np.concatenate([r.integers(1, 6, n).astype(np.uint64), body, r.integers(1, 6, 40 - n).astype(np.uint64)]) for n in (3, 17, 40)]
    first = np.cumsum([0, *map(len, texts)])
    for name, cs, ce in substring_dedup.recompress(np.concatenate(texts), first, 3):
        assert (np.diff(cs) >= 0).all() and (np.diff(ce) >= 0).all()
        inside = []
        for i, n in enumerate((3, 17, 40)):
            at = first[i] + n
            ok = (cs >= at) & (ce <= at + len(body))
            inside.append({*zip((cs[ok] - at).tolist(), (ce[ok] - at).tolist(), name[ok].tolist())})
        assert inside[0] == inside[1] == inside[2] and inside[0]


@pytest.mark.parametrize("k,keep,bucket", [(50, "none", 512), (50, "first", 2), (20, "none", 2)])
def test_byte_strings(spark, woven, k, keep, bucket):
    docs = woven[:70] + woven[-2:]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, k, keep, bucket=bucket).collect()}
    assert got == byte_repeats(docs, k, keep)


def test_longest_previous_factors():
    import numpy as np
    text = np.frombuffer(b"abcabcabcxabcabcy" * 3, np.uint8)
    at = np.arange(len(text) - 11)
    sa, lpf, source = suffix_dedup.previous_factors(text, at, 12)
    raw = text.tobytes()
    assert [raw[i:i + 12] for i in sa] == sorted(raw[i:i + 12] for i in at)
    for i, n, s in zip(sa, lpf, source):
        assert (n >= 12) == any(raw[j:j + 12] == raw[i:i + 12] for j in range(i)) and (n < 12 or raw[s:s + 12] == raw[i:i + 12])


@pytest.mark.parametrize("n,num,block", [(4, 85, 2048), (5, 80, 2)])
def test_jaccard(spark, edited, n, num, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, n, num, 100).collect()}
    assert got == near(edited, n, num, 100)


def test_tiles_find_cross_component_pairs(spark):
    """The exact phase alone: all classes in components of their own, several blocks and bands."""
    import numpy as np
    sets = {c: np.sort(np.random.default_rng(c % 7).permutation(4000)[:60 + c % 5]).astype(np.uint64) for c in range(1, 40)}
    rows = [(0, c, c, 2 * len(s) + 1, jaccard._folded(jaccard.bitmaps(s, np.array([0, len(s)]))[0], len(s))) for c, s in sets.items()]
    df = spark.createDataFrame(rows, "t long, c long, comp long, n2 long, sig binary")
    want = {(a, b) for a in sets for b in sets if a < b and jaccard.links(sets[a], sets[b], 85, 100)}
    old, jaccard.BLOCK = jaccard.BLOCK, 3
    try:
        got = {tuple(r) for r in jaccard._tile_pairs(jaccard._live(df.drop("sig"), 85, 100), df.select("c", "sig"), 85, 100).collect()}
    finally:
        jaccard.BLOCK = old
    assert want and want <= got


def jobs_of(spark, work):
    """What ``work`` returns, and how many Spark jobs it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"counted-{random.random()}", "")
    try:
        return work(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_components(spark):
    """Least nodes of stars, paths, rings and random graphs; a graph of stars is read once and not gone over again."""
    r = random.Random(4)
    graphs = [[], [(5, 5)], [(i, 0) for i in range(1, 60)], [(i, i + 1) for i in range(60)], [(i, (i + 1) % 40) for i in range(40)] * 2,
              [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(110)]]
    for edges in graphs:
        least = {x: x for e in edges for x in e}
        while any(least[a] != least[b] for a, b in edges):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        got = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
        assert sorted((x.c, x.comp) for x in got) == sorted((c, m) for c, m in least.items() if m < c)
    star = spark.createDataFrame(graphs[2], "a long, b long")
    got, jobs = jobs_of(spark, lambda: jaccard.components(star).collect())
    assert len(got) == 59 and jobs <= 8


def test_jaccard_jobs(spark):
    """Every job is a wave of tasks over all partitions, with files and event records of its own: near copies in a few
    large groups need few of them."""
    r = random.Random(6)
    base = [[f"w{r.randrange(900)}" for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(160):
        w = list(base[i % 4])
        w[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = near(rows, 5, 80, 100)
    got, jobs = jobs_of(spark, lambda: sorted(x.doc_id for x in jaccard.keep_one(df).collect()))
    assert got == sorted({x[1] for x in want.values()}) and jobs <= 250


def test_suffix_dedup_disk(spark, monkeypatch, tmp_path):
    """Texts without a copy enter no exchange, whatever their number; those with one keep their result."""
    r = random.Random(9)
    passage = r.randbytes(300).hex()
    rows = [(i, r.randbytes(10_000).hex()) for i in range(300)] + [(300 + i, r.randbytes(200).hex() + passage + r.randbytes(200).hex()) for i in range(6)]
    rows += [(400, None), (None, rows[300][1]), (300, rows[300][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(suffix_dedup, "release", lambda spark: None, raising=False)
    before = shuffle_files(spark)
    got = suffix_dedup.dedup(df, 400, "none").select("doc_id", "n_bytes", "n_removed").collect()
    written = sum(n for f, n in shuffle_files(spark).items() if f not in before)
    assert len(got) == 309 and written < 0.2 * sum(len(t or "") for _, t in rows)
    assert all(x.n_removed == 0 for x in got if x.doc_id is not None and (x.doc_id < 300 or x.doc_id == 400))
    removed = sorted(x.n_removed for x in got if x.doc_id is None or 300 <= x.doc_id < 400)
    assert removed[5:] == [1400] * 3 and all(600 <= n < 610 for n in removed[:5])  # some more where two go on alike by chance


def test_may_match(spark):
    """No row with a partner is left out, nulls included; few others pass."""
    keys = spark.range(0, 3000, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b")).repartition(5)
    df = spark.range(0, 30_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"), "id")
    got = may_match(df, [F.col("a"), F.col("b")], keys, [F.col("a"), F.col("b")])
    assert got.columns == ["a", "b", "id", "_may"]
    may = {x.id for x in got.filter("_may").collect()}
    assert may >= set(range(0, 3000, 3)) and len(may) < 1050 and got.filter("not _may").count() == 30_000 - len(may)
    assert not may_match(df, [F.col("a")], keys.limit(0), [F.col("a")]).filter("_may").count()


def test_odd_rows(spark, odd, empty):
    kept = substring_dedup.dedup(odd, window=50)
    assert kept.columns == odd.columns
    by = {(r.doc_id, r.source): r for r in kept.collect()}
    assert by[6, "t"].text == "" and by[5, "s"].text.startswith("w0 w1") and by[2, None].text is None and by[1, "s"]["_k"] == "x"
    assert substring_dedup.dedup(empty, window=50).count() == 0 and substring_dedup.dedup(empty, digests=True).count() == 0
    got = suffix_dedup.dedup(odd, 400, "none").collect()
    assert len(got) == 10 and {(r.doc_id, r.n_removed > 0) for r in got} >= {(5, True), (6, True), (7, True), (2, False), (None, False)}
    assert suffix_dedup.dedup(empty, 400).count() == 0
    one = jaccard.keep_one(odd)
    assert one.columns == odd.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in one.collect())
    assert [i for i, _ in ids] == [-1, -1, 1, 2, 3, 4, 5, 7]
    assert jaccard.near_duplicates(empty).count() == 0
