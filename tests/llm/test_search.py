"""Hard negatives, near duplicates among embeddings, ranked lexical search."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainlens.llm import hard_negatives, lexical, multi_index, queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<float>, label int, dim int, key string, c long, home string, n_links double, score binary"


def vectors(spark, rows):
    """A table of (vec_id, embedding, label) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "k", 1, None, 2.0, b"x") for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def odd_rows():
    r = np.random.default_rng(3)
    vec = lambda: [float(x) for x in r.normal(size=9).astype(np.float32)]
    same, tie = vec(), vec()
    rows = [(i, vec(), i % 3) for i in range(1, 60)]
    rows += [(100, same, 1), (100, same, 1), (101, same, 1), (102, same, 2), (103, same, 2), (103, same, 2), (104, tie, 0), (105, tie, 0)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None], 1), (203, [float("nan")] * 9, 1), (204, [float("inf")] * 9, 2), (205, [0.0] * 9, 2),
             (206, vec(), None), (None, same, 1), (None, None, None), (207, [3.0], 1), (208, [2.5], 1), (209, [-3.0], 2), (300, vec()[:4], 0),
             (301, [x * 1000 for x in same], 2), (302, [x * -1e4 for x in tie], 0)]
    return rows


# --- hard negatives -------------------------------------------------------------------------------

def brute_negatives(rows, is_anchor, k=5, low=80):
    ok = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
          if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in ok:
        if not is_anchor(i):
            continue
        met = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if j != i and len(w) == len(v)]
        for n, (p, pid, _) in enumerate(sorted(x for x in met if x[2] == lab)[:k]):
            fits = sorted((s, j) for s, j, m in met if m != lab and low * -p <= 100 * -s <= 100 * -p)
            out += [(i, pid, r + 1, j, -p, -s, n + 1) for r, (s, j) in enumerate(fits[:k])]
    return sorted(out)


def test_four_russians_scores_are_inner_products():
    r = np.random.default_rng(1)
    for dim in (1, 7, 8, 9, 64):
        for top in (1, 200, 1 << 30):
            a, c = r.integers(-top, top + 1, (5, dim)), r.integers(-top, top + 1, (33, dim))
            planes = hard_negatives.bit_planes(c)
            kind = hard_negatives._exact_type(a, planes)
            assert (hard_negatives.scores(hard_negatives.subset_sums(a, kind), planes).T == a @ c.T).all()
    assert hard_negatives.bit_planes(np.zeros((3, 8), np.int64)).shape == (1, 1, 3)
    assert (hard_negatives.scores(hard_negatives.subset_sums(np.full((1, 8), 5), np.int64), hard_negatives.bit_planes(np.full((2, 8), -1))) == -40).all()


def test_hard_negatives_equal_brute_force(spark, odd_rows, monkeypatch):
    want = brute_negatives(odd_rows, lambda i: i % 5 == 0)
    for tile, block, step in ((8192, 512, 2048), (16, 4, 7)):
        for name, v in (("TILE", tile), ("BLOCK", block), ("STEP_C", step), ("STEP_A", 3)):
            monkeypatch.setattr(hard_negatives, name, v)
        got = hard_negatives.mine(vectors(spark, odd_rows), F.col("vec_id") % 5 == 0, F.col("label"))
        assert sorted(tuple(r) for r in got.collect()) == want
    assert len({w[:2] for w in want}) > 20
    assert hard_negatives.mine(vectors(spark, odd_rows).limit(0), F.lit(True), F.col("label")).count() == 0
    assert hard_negatives.mine(vectors(spark, odd_rows), F.lit(None).cast("boolean"), F.col("label")).count() == 0


def test_hard_negatives_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_hard_negatives"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda i: i % 100 == 0)


# --- near duplicates among embeddings ---------------------------------------------------------------

def unit_or_none(v):
    if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
        return None
    x = np.asarray(v, np.float64)
    return x / np.sqrt(x @ x)


def brute_links(rows, threshold=0.95):
    u = [unit_or_none(v) for _, v, _ in rows]
    near = [[j for j, y in enumerate(u) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for i, x in enumerate(u)]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            least = min([comp[i]] + [comp[j] for j in js])
            if least < comp[i]:
                comp[i], changed = least, True
    low = defaultdict(list)
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            low[comp[i]].append(vec_id)
    return Counter((r[0], len(near[i]), min(low[comp[i]], default=None)) for i, r in enumerate(rows))


def test_near_duplicates_odd_rows(spark, odd_rows):
    got = multi_index.near_duplicates(vectors(spark, odd_rows)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(odd_rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert multi_index.near_duplicates(vectors(spark, odd_rows).limit(0)).count() == 0


@pytest.fixture(scope="module")
def crowded():
    """Groups of near copies of two to hundreds, chains, and unrelated vectors."""
    r = np.random.default_rng(5)
    out = [r.normal(size=(1500, 24))]
    for size, spread in ((2, .05), (7, .2), (40, .1), (400, .15), (400, .26)):
        out.append(r.normal(size=24) + spread * r.normal(size=(size, 24)))
    x = np.concatenate(out)
    return [(int(i), [float(y) for y in v], 0) for i, v in zip(r.permutation(len(x)), x.astype(np.float32))]


def test_multi_index_recall_and_exact_links(spark, crowded, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 40)
    monkeypatch.setattr(multi_index, "TILE", 50)
    x = np.array([unit_or_none(v) for _, v, _ in crowded])
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in multi_index.near_duplicates(vectors(spark, crowded)).collect()}
    found = np.array([got[i].n_links for i, _, _ in crowded])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()
    # With every cell visited the result is exact.
    exact = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(vectors(spark, crowded), target=1.0).collect()}
    assert sum(exact[i][0] for i, _, _ in crowded) >= found.sum()
    monkeypatch.setattr(multi_index, "fit_grid", lambda *a, f=multi_index.fit_grid: _endless(f(*a)))
    every = multi_index.near_duplicates(vectors(spark, crowded)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in every) == brute_links(crowded)


def _endless(grid):
    grid.reach = np.inf
    return grid


def test_walk_visits_nearest_cells_first():
    r = np.random.default_rng(2)
    grid = multi_index.Grid(10, (r.normal(size=(6, 5)), r.normal(size=(6, 5))), 2.5)
    x = r.normal(size=(50, 10))
    row, cell, home = grid.walk(x)
    a, b, _ = grid.excess(x)
    want = {(i, p * 6 + q) for i in range(50) for p in range(6) for q in range(6) if a[i, p] + b[i, q] <= 2.5}
    assert set(zip(row.tolist(), cell.tolist())) == want and all((i, h) in want for i, h in enumerate(home.tolist()))


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_embedding_near_dedup"](spark, sf).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)


# --- ranked lexical search --------------------------------------------------------------------------

def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, k=10):
    bags = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        got = []
        for d, b in bags:
            m = 10 + 90 * b.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                got.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(got, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def test_lexical_search_equals_brute_force(spark, odd, docs, monkeypatch):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(.7))}" for _ in range(400)]
    texts = [" ".join(r.choice(words) + r.choice(["", ",", ".W1", "É"]) for _ in range(r.randint(0, 60))) for _ in range(900)]
    texts += texts[:40] + ["", None, "!? \n", "W1 w1", "a\x00b\x7fc", "é" * 300, " ".join(words * 60)]
    rows = [(None if i % 97 == 5 else i // 2, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(12)]
    items += [(3, "w1 W2 w3"), (None, "w1 a b"), (20, None), (21, "..."), (22, "nowhere"), (23, "é" * 300 + " W1"), (23, "C")]
    frame = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], "doc_id long, text string, item_id int, term string, score long").repartition(5)
    asked = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, doc_id long, h long").repartition(2)
    want = brute_search(rows, items)
    for shard, block in ((2048, 100_000), (64, 40)):
        monkeypatch.setattr(lexical, "SHARD", shard)
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        assert Counter(tuple(x) for x in lexical.search(frame, asked).collect()) == want
    assert lexical.search(frame.limit(0), asked).count() == 0 and lexical.search(frame, asked.limit(0)).count() == 0
    assert {x.doc_id for x in lexical.search(odd, asked.filter("item_id IS NULL")).collect()} == {1, 5, 6}


def test_pair_bounds_skip_and_lose_nothing():
    r = np.random.default_rng(6)
    n_docs, n_terms, k = 3000, 12, 10
    doc, term = np.nonzero(r.random((n_docs, n_terms)) < np.geomspace(.002, .4, n_terms))
    n, tf = r.integers(50, 400, n_docs), r.integers(1, 5, len(doc))
    df = np.bincount(term, minlength=n_terms)
    w = lexical.weights(df, n_docs)
    s = lexical.Shard(np.stack([np.arange(n_docs), np.zeros(n_docs, np.int64)]), n, doc, term, tf, w, n_docs, int(n.sum()))
    full = np.zeros(n_docs, np.int64)
    np.add.at(full, doc, lexical.impacts(w[term], tf, n[doc], n_docs, int(n.sum())))
    least = int(np.sort(full)[-k])
    found, score = lexical.max_score(s, np.arange(n_terms), least)
    assert sorted(found.tolist()) == np.flatnonzero(full >= least).tolist() and (score == full[found]).all()
    pairs = s.pairs(np.arange(n_terms))
    single = sum(int(x) for x in s.most)
    assert sum(b for b, _ in pairs) < single  # joint maxima are tighter than the sum of the single ones
    for bound, own in pairs:
        both = np.zeros(n_docs, np.int64)
        for t in own:
            d, i = s.entries(t)
            both[d] += i
        assert both.max() == bound


def test_lexical_query(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_lexical_search"](spark, sf).collect()
    assert Counter(tuple(x) for x in got) == brute_search(docs, items)
