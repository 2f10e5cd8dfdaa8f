"""The registered queries opN_<name>: thin applications of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, jaccard, lexical, multi_index, packing, pii, quality, substring_dedup, suffix_dedup, topk, toxicity, warc
from .common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op5_byte_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the bytes they decode to."""
    from public_tokenizers import PATTERN
    return bpe.round_trip(documents(spark, sf).select("doc_id", "text"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN)


@register("op6_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return packing.pack(documents(spark, sf), tokenizer_file("word_bpe_49k.json"), end_id=1, window=2048)


@register("op7_quality_rules")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@register("op8_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Five best candidates of every 50th vector, over all vectors."""
    return topk.top_k(documents(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT x, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
        (CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest
      FROM (SELECT DISTINCT x FROM d))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS digest_ok
FROM d JOIN b USING (x)""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """WARC archives of all pages, written and read back."""
    return warc.archive_and_read(documents(spark, sf, "pages"))


@register("op1_toxicity")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, by a model of the labelled rows that are not held out."""
    docs = documents(spark, sf)
    model = toxicity.fit(docs, documents(spark, sf, "labels"))
    got = toxicity.score(docs.select("doc_id", "lang", "text"), model)
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "lang_threshold", "flagged")


@register("op4_pii")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document: base spans and those that the trained classifier adds."""
    return pii.detect(documents(spark, sf).select("doc_id", "text"))


@register("op2_substring_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that are left after later copies of 50-word windows are removed."""
    return substring_dedup.dedup(documents(spark, sf), window=50, digests=True)


@register("op10_suffix_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document that no 400-byte copy covers."""
    return suffix_dedup.dedup(documents(spark, sf), length=400, keep="none").drop("kept")


@register("op9_jaccard_join")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under links of 4-word shingle sets at Jaccard 0.85 and more."""
    return jaccard.near_duplicates(documents(spark, sf), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


@register("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank FROM s WHERE same),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE positive_rank <= 5 AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= 5""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every 100th vector, with some labels moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(documents(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, low=80)


@register("op12_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.comp = e.a),
c AS (SELECT vec_id, min(comp) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all vectors under links of cosine 0.95 and more."""
    return multi_index.near_duplicates(documents(spark, sf, "embeddings"), threshold=0.95)


@register("op13_lexical_search", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM k),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
e AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM k) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM e, g GROUP BY term, nd),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score
      FROM q JOIN e USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return lexical.search(documents(spark, sf), documents(spark, sf, "benchmark"), k=10)
