"""Tokens, packing, personal data, quality, toxicity, archives and search."""
import base64
import gzip
import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from .conftest import WORD, shuffle_files
from retainlens.llm import bpe, packing, pii, quality, queries, topk, toxicity, warc

WEIRD = ["a", "B", "'s", " ", "  ", "\n", "\t", "é", "é", " ", "1", "!?", "<|endoftext|>", "日本", "　", "...", "ab" * 80, "\x1c", "ß"]


def weird_texts(n=300):
    r = random.Random(2)
    return ["".join(r.choice(WEIRD) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", "a" * 3000, "ab" * 900, "日本語" * 300]


def test_bpe_equals_tiktoken(spark, docs, odd, empty):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = weird_texts() + [t or "" for _, t in docs]
    v = bpe.vocabulary(path, P.PATTERN)
    got = bpe.encode_texts(v, texts, {})
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert [bpe.decode_ids(v, x) for x in got] == [t.encode() for t in texts]
    rows = bpe.round_trip(odd.select("doc_id", "text"), path, P.PATTERN).collect()
    assert len(rows) == 10 and all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))
    back = bpe.decode(bpe.encode(odd, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.round_trip(empty.select("doc_id", "text"), path, P.PATTERN).count() == 0


def test_packing(spark, sf, docs, odd, empty):
    from tokenizers import Tokenizer
    path = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = weird_texts()
    assert [list(x) for x in packing.ChunkTokenizer(path).encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    rows = queries.QUERIES["op6_packing"](spark, sf).collect()
    by, ids = {}, {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs}
    seq = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for d, x in ids.items():
        at = 0
        for start, n in sorted(by[d]):
            assert start == at
            at += n
        assert at == len(x)
    for pieces in seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(seq)) > 0.9
    assert packing.pack(empty, path).count() == 0
    assert Counter(r.doc_id for r in packing.pack(odd, path).filter("start = 0").collect())[1] == 2


def test_tightest_fit():
    r = random.Random(1)
    lengths = sorted((r.randint(1, 99) for _ in range(400)), reverse=True)
    number, offset = packing.best_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths:
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(100 - n)
    fill = Counter()
    for w, n in zip(number.tolist(), lengths):
        fill[w] += n
    assert sorted(100 - f for f in fill.values()) == sorted(room)


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii(spark, sf, docs, odd, empty):
    r = random.Random(5)
    parts = ["a", "b@", "@", "x.y", "1", "22", "255.", "4111 1111-1111 1111", "1.2.3.4", "+1 (", "é", " ", "-", "\n", "+", "555-1234", ".com", "@@", ".."]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == brute_spans(t), t
    text = dict(docs)
    for row in queries.QUERIES["op4_pii"](spark, sf).collect():
        base = brute_spans(text[row.doc_id] or "")
        shown = [f"{k}:{s}:{e}" for k, s, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and row.spans.split(",")[:len(shown)] == (shown or row.spans.split(",")[:0])
    assert pii.detect(empty.select("doc_id", "text")).count() == 0 and pii.detect(odd.select("doc_id", "text", "n")).count() == 10
    got = pii.mask(spark.createDataFrame([(1, "call +1 (771) 555-1655 or x@y.com.")], "doc_id long, text string")).first()
    assert got.text == "call <phone> or <email>."


def test_pii_secret_forms(spark):
    """Secrets straight after an equals sign and of more than 200 characters are proposed whole, and masked."""
    r = random.Random(6)
    some = lambda n: "sk-a1" + "".join(r.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    for t, n in (("api_key=", 30), ("the token is ", 400), ("secret=", 5000)):
        key = some(n)
        assert [(k, s, e) for k, s, e, *_ in pii.candidate_spans(t + key + " end") if k == "secret"] == [("secret", len(t), len(t) + len(key))]
    forms = ["the api_key={} was set.", "secret token: {} here"]
    df = spark.createDataFrame([(i, forms[i % 2].format(some(30 if i % 3 else 300))) for i in range(60)], "doc_id long, text string")
    assert {x.text for x in pii.mask(df).collect()} == {f.format("<secret>") for f in forms}


def test_em_learns_reliability():
    """A labeler that is right 95 % of the time must be told from one that guesses."""
    r = np.random.default_rng(0)
    truth = r.random(5000) < 0.4
    votes = np.stack([np.where(r.random(5000) < a, np.where(truth, 1, 2), np.where(truth, 2, 1)) for a in (0.95, 0.9, 0.5)], 1)
    q, rel = pii.em_posteriors(votes, np.ones(5000))
    assert ((q > 0.5) == truth).mean() > 0.9 and rel[0, 1, 1] > 0.85 and abs(rel[2, 1, 1] - 0.5) < 0.1


def test_quality_counts(spark, sf, docs, odd, empty):
    def brute(t):
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        mark = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark), len(w) < 20 or 100 * len(mark) > 30 * len(w))
    got = {r.doc_id: tuple(r)[1:7] for r in queries.QUERIES["op7_quality_rules"](spark, sf).collect()}
    assert got == {d: brute(t or "") for d, t in docs}
    lines = ["x\nx\n\nx", "\n\n", "a  b\n\na  b", "one\n", "p q r s t u v w " * 6]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(lines)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(df).collect()} == dict(enumerate(map(brute, lines)))
    assert quality.keep_good(odd).columns == odd.columns and quality.quality(odd).count() == 10 and quality.quality(empty).count() == 0


def test_quality_rejects_outliers(spark):
    """A cloud of ordinary texts in a source that holds most rows; texts of symbols are outside it."""
    r = random.Random(9)
    good = [(i, ". ".join(" ".join("".join(r.choices("aeiorstln", k=r.randint(2, 9))) for _ in range(12)) for _ in range(r.randint(3, 9))), "en", "hot") for i in range(500)]
    bad = [(1000 + i, " ".join(r.choice(["###", "$$$$", "a&&", "|||"]) + str(i * 40 + j) for j in range(60)), "en", "hot") for i in range(10)]
    rows = {x.doc_id: x.kept for x in quality.quality(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(rows[i] for i in range(500)) and not any(rows[1000 + i] for i in range(10))


def test_quality_distance_against_numpy(spark, sf, monkeypatch):
    """The verdicts' distances, naively from the estimates; the same with groups shuffled instead of broadcast."""
    from retainlens.llm.common import documents
    docs = documents(spark, sf)
    got = {r.doc_id: (r.distance, r.kept) for r in quality.quality(docs).collect()}
    stats = quality.add_statistics(docs)
    pool, est = quality.fit(stats.select("lang", "source", "n_words", *(f"_f_{f}" for f in quality.FEATURES)))
    first = {(r._pl, r._ps): tuple(r._groups[0]) for r in pool.collect()}
    groups = {(r._lang, r._source): r for r in est.collect()}
    name = lambda v: "~" if v is None else "=" + v
    p = len(quality.FEATURES)
    for r in stats.collect():
        g = groups.get(first[name(r.lang), name(r.source)])
        d = np.array([r[f"_f_{f}"] for f in quality.FEATURES]) - np.array(g.center)
        inverse = np.zeros((p, p))
        inverse[np.triu_indices(p)] = g.inverse
        inverse += np.triu(inverse, 1).T
        want = float(d @ inverse @ d) / g["scale"]
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert got[r.doc_id] == (pytest.approx(want, rel=1e-6, abs=1e-9), not failed and want <= quality.CUTOFF)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, (_, k) in got.items() if k}
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    assert {r.doc_id: r.kept for r in quality.quality(docs).collect()} == {i: k for i, (_, k) in got.items()}


def test_quality_judges_small_groups(spark):
    """Few rows of a language, of a null language and of a source beside a hot one: all have a distance, and junk is rejected."""
    r = random.Random(10)
    good = lambda: ". ".join(" ".join("".join(r.choices("aeiorstln", k=r.randint(2, 9))) for _ in range(12)) for _ in range(r.randint(3, 9)))
    bad = lambda: " ".join(r.choice(["###", "$$$$", "a&&", "|||"]) + str(r.randint(0, 3000)) for _ in range(60))
    some = [("en", "hot", 300, 5), ("en", "small", 6, 2), ("xx", "hot", 12, 2), ("xx", "one", 0, 1), (None, None, 3, 1)]
    texts = [(f(), lang, source, f is good) for lang, source, n, m in some for f, k in ((good, n), (bad, m)) for _ in range(k)]
    for rows in (texts, texts[240:]):  # the second part, 12 % of it junk, has fewer than MIN_ROWS rows in all
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, good boolean")
        got = quality.quality(df).collect()
        assert len(got) == len(rows) and all(x.distance is not None and not x.base_failed for x in got)
        assert all(x.kept == x.good for x in got), [x for x in got if x.kept != x.good]


def test_toxicity_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op1_toxicity"](spark, sf).collect()]
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p == y == 1 for p, y in held)
    assert hit / sum(y for _, y in held) > 0.85 and hit / sum(p for p, _ in held) > 0.8
    model = toxicity.train([np.zeros((0, 2), np.uint64), np.ones((2, 2), np.uint64)] * 20, np.array([0, 1] * 20), ["en"] * 40, epochs=2)
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(empty, None).count() == 0


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    """Words far into a text are learnt from, and an id in very many rows displaces no other."""
    a, b, c = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:3]
    rows = [(a, f"repeat {i}", "en") for i in range(1100)] + [(b, "calm day", "en"), (c, "calm " * 4500 + "awful words", "en")]
    got = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, langs: got.extend(zip(map(len, texts), y)))
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4),
                 spark.createDataFrame([(a, 0), (b, 0), (c, 1)], "doc_id long, toxic int"), per_class=2)
    assert got == [(2, 0), (2, 0), (4502, 1)]


def test_toxicity_takes_every_labelled_row(spark, monkeypatch):
    """No class is cut to a number of rows, in one place or in shards; the sharded model learns what all shards hold."""
    ids = [i for i in range(2200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "calm day here" if i % 4 else "calm awful here", "en") for i in ids], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int")
    got = []
    with monkeypatch.context() as m:
        m.setattr(toxicity, "train", lambda texts, y, langs: got.extend(y))
        toxicity.fit(docs, labels)
    assert len(ids) > 1700 and len(got) == len(ids) and sum(got) == sum(i % 4 == 0 for i in ids)
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", 0)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    seen = []
    fitted = toxicity._best_step
    monkeypatch.setattr(toxicity, "_best_step", lambda z, n0, n1: (seen.append((n0.sum(), n1.sum())), fitted(z, n0, n1))[1])
    model = toxicity.fit(docs, labels)
    assert len(model.vocabulary) == 8 and 300 < sum(seen[0]) < 420  # a fifth is kept aside, all of it calibrates
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in toxicity.score(docs, model).collect())


def test_toxicity_disk(spark, monkeypatch, tmp_path):
    """Texts without a label stay out of the exchange, the numbered texts are shuffled once for all members, and what is
    sent of a model is not its response tables."""
    r = random.Random(5)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    named = ids[:60]
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(3000)) if i in named else r.randbytes(10_000).hex(), "en") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    labels = spark.createDataFrame([(i, i % 2) for i in named], "doc_id int, toxic int")  # of another type than the ids of docs
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", 0)
    monkeypatch.setattr(toxicity, "VISITS", 1)
    monkeypatch.setattr(toxicity, "release", lambda spark: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffle_files(spark)
    try:
        model = toxicity.fit(docs, labels)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text, numbered, parameters = (sum(len(t) for i, t, _ in rows if i in named), len(named) * 3000 * 4, sum(x.nbytes for p in model.parts for x in p.values()))
    written = sum(n for f, n in shuffle_files(spark).items() if f not in before)
    assert written < text + 1.2 * numbered + 1.1 * parameters
    model.logits(*toxicity.hashed_words(np.frombuffer(b"w1 w2", np.uint8), np.array([0, 5])))
    sent = pickle.dumps(model)
    assert len(sent) < 1.1 * parameters + model.vocabulary.nbytes + 10_000 < sum(x.nbytes for t in model.tables.values() for x in t)
    again = pickle.loads(sent)
    assert all((x == y).all() for w in toxicity.WIDTHS for x, y in zip(again.tables[w], model.tables[w]))


def test_toxicity_filters_naive():
    """Convolution and pooling against a word-by-word computation; an empty text counts as one word without a vector."""
    r = np.random.default_rng(4)
    tables = {w: [r.normal(size=(9, 5)) for _ in range(w)] for w in toxicity.WIDTHS}
    for w in toxicity.WIDTHS:
        for table in tables[w]:
            table[0] = 0
    bias = {w: r.normal(size=5) for w in toxicity.WIDTHS}
    texts = [r.integers(0, 9, (n, 2)) for n in (4, 0, 1, 7, 2)]
    got = toxicity.pooled(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), tables, bias)
    for row, t in zip(got, texts):
        long = np.concatenate([t, np.zeros((3, 2), np.int64)])
        want = []
        for w in toxicity.WIDTHS:
            at = [sum(tables[w][j][long[i + j]].sum(0) for j in range(w) if i + j < len(long)) + bias[w] for i in range(len(t) + 1)]
            want.append(np.maximum(np.max(at, axis=0), 0))
        assert np.allclose(row, np.concatenate(want))


def test_warc(spark, empty):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", inner * 3), (2, "u", inner * 3), (3, None, None), (4, "x y\r\n", "\r\n\r\n" + inner), (5, "u", ""), (None, "u", "q"), (2, "u", inner * 3), (7, "u", "é" * 10)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, off long").repartition(2)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes, r.payload_digest, r.digest_ok) for r in warc.archive_and_read(df).collect())
    top = {}
    for p, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), p or -1)
    want = sorted(((p or -1), "response" if p is None or p == top[h or ""] else "revisit", -1 if p is None or p == top[h or ""] else top[h or ""], len((h or "").encode()),
                   base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), True) for p, _, h in pages)
    assert got == want
    assert warc.archive_and_read(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive_and_read(df, min_payload=10_000).collect()} == {"response"}


def test_warc_foreign_archives(spark, tmp_path):
    """One gzip member a record, names that the writer would not give, plain files; a cut member raises."""
    record = lambda i, body: (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n"  # noqa: E731
                              f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    bodies = {i: b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" * (i % 3) + str(i).encode() for i in range(40)}
    (tmp_path / "crawl-0001.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in bodies.items() if i < 30))
    (tmp_path / "more.warc").write_bytes(b"".join(record(i, b) for i, b in bodies.items() if i >= 30))
    got = {r.page_id: (r.body_bytes, r.body_sha1) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, b in bodies.items()}
    with pytest.raises(EOFError):
        warc._gunzip(gzip.compress(b"abc" * 1000)[:-9])


def test_top_k(spark):
    r = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in r.normal(0, 1, 8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 330)]
    vecs += [(400, None), (450, [float("nan")] * 8), (500, [1.0] * 7 + [None])]
    df = spark.createDataFrame([(*v, 9) for v in vecs], "vec_id long, embedding array<double>, tile long")
    from pyspark.sql import functions as F
    old, topk.TILE = topk.TILE, 64
    try:
        got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    finally:
        topk.TILE = old
    m = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in vecs[:330]}
    want = [(q, n + 1, i, s) for q in m if q % 50 == 0 for n, (s, i) in enumerate(sorted((-int(m[q] @ m[i]), i) for i in m if i != q)[:5]) for s in [-s]]
    assert got == sorted(want) and topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P
    from .test_dedup import near, word_repeats
    kinds = [n for n, _ in P.STAGES]
    assert kinds == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    first = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id: r.text for r in P.quality_rules(spark, first, sf).collect()}
    verdict = {r.doc_id for r in queries.QUERIES["op7_quality_rules"](spark, sf).filter("kept").collect()}
    assert set(good) == verdict
    comp = near(list(good.items()), 5, 80, 100)
    stay = {d: t for d, t in good.items() if comp[d][1] == d}
    left = word_repeats(list(stay.items()), 50)
    out = P.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(stay)
    second = P.near_duplicates(spark, P.quality_rules(spark, first, sf), sf)
    third = P.repeated_passages(spark, second, sf)
    assert third.columns == first.columns
    for r in third.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == left[r.doc_id][2] and r.n_chars == len(r.text)
