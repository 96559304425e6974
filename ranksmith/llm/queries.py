"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, filter_audit, license_scan, lm, mixing, nra, pq, quality, simhash, spm, token_counts, toxicity, warc
from .common import held, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    """Vocabulary files are a parameter of the site, found by name."""
    import public_tokenizers
    return public_tokenizers.path(name)


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op1_exact_topk", _TOPK_SQL)
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.top_k(table(spark, sf_dir, "embeddings"))


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"),
                                       public_tokenizers.PATTERN)


@register("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
b AS (SELECT html, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, payload_bytes, payload_digest,
       CASE WHEN b.best <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b.best <> p.page_id THEN b.best END AS refers_to
FROM p LEFT JOIN b ON p.html = b.html
"""


@register("op4_warc", _WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
              WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM s GROUP BY source),
r AS (SELECT *, 2.0 * source_size / w AS ratio FROM p),
c AS (
  SELECT *, sum(2.0 * source_size) OVER u AS caps, sum(w) OVER u AS ws,
         1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM r WINDOW u AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT greatest(max(total / w_all), coalesce(max(CASE WHEN w_all > ws THEN (total - caps) / (w_all - ws) END), 0)) AS level FROM c),
t AS (SELECT source, source_size, CAST(least(2.0 * source_size, level * w) AS DOUBLE) AS target FROM r, l),
d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(s.doc_id AS VARCHAR), 'null'))), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM d
"""


@register("op5_mix_sources", _MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


@register("op6_lm_scores")
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@register("op7_embedding_dedup")
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def _scores(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held("doc_id", 0).alias("held_out"), F.col("score"),
                         (F.col("score") >= least).cast("int").alias("predicted"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    return _scores(toxicity.score_documents(docs.select("doc_id", "text"), model), toxicity.SPAN)


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    return _scores(quality.score_documents(docs.select("doc_id", "text"), model), quality.KEEP)


@register("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


@register("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


_AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n, bit_count(fails) AS failed FROM f GROUP BY part, good, toxic, fails),
i AS (SELECT unnest([1, 2, 4, 8, 16]) AS k, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o, [a.k, b.k, c.k, d.k, e.k] AS ks FROM i a, i b, i c, i d, i e
  WHERE a.k + b.k + c.k + d.k + e.k = 31 AND len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, step, ks[step] AS this, CAST(coalesce(list_sum(ks[1:step - 1]), 0) AS INTEGER) AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN fails & (this + before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN fails & this > 0 AND fails & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN fails & this > 0 AND fails & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN fails = this THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN fails & this > 0 AND fails & before = 0 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN fails & this > 0 AND fails & before = 0 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN fails & this > 0 THEN n * 120 // failed ELSE 0 END) AS BIGINT) AS shapley
FROM c, s
GROUP BY part, o, step
"""


@register("op13_filter_audit", _AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
