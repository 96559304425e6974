"""Registered queries of the encoder hook and stores (E1, E7, E8), hydration
(F3), text-keyed judgements (G5, G7), prefixes (C6, C7) and the stream steps S2, S3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import TASK_INSTRUCTIONS, suite_prefix, task_prefix
from ..operators import embed as EM
from ..operators import judge
from ..operators.search import hydrate_hits
from ..session import shared_path, table
from ..streaming.streams import read_table_stream, stream_embed, stream_pack
from . import oracle as O
from . import views as V
from .registry import register

_INS = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASK_INSTRUCTIONS.items()) + " ELSE '' END"
_Q7 = f"""q7 AS (SELECT item_id AS qid, text, CASE WHEN item_id % 9 = 0 THEN 'Other' ELSE ({O.TASK_LIST})[(item_id % 6) + 1] END AS task FROM benchmark)"""


def _q7(spark, sf_dir):
    """V7 with its own tasks, every ninth unknown."""
    q = V.q_txt(spark, sf_dir)
    return q.select(F.col("_id").alias("qid"), "text", F.when(F.col("_id") % 9 == 0, "Other").otherwise(F.col("task")).alias("task"))


@register("query_prefix_tasks", O.with_(_Q7) + f"SELECT qid, task, {_INS} || ': ' || {O.strip_sql('text')} AS query FROM q7")
def q_query_prefix_tasks(spark, sf_dir):
    return _q7(spark, sf_dir).select("qid", "task", task_prefix(F.col("text"), F.col("task")).alias("query"))


@register("suite_prefix", O.with_(_Q7) + f"""SELECT qid, suite, {_INS} || ': ' || {O.strip_sql('text')} AS query
FROM (SELECT qid, text, suite, CASE suite WHEN 'trec' THEN 'QA' WHEN 'climate' THEN 'FactCheck' WHEN 'biosses' THEN 'STS' ELSE task END AS task
      FROM q7 CROSS JOIN (VALUES ('eva'), ('trec'), ('climate'), ('biosses')) s(suite))""")
def q_suite_prefix(spark, sf_dir):
    q = _q7(spark, sf_dir)
    out = F.array(*[F.struct(F.lit(s).alias("suite"), suite_prefix(F.col("text"), s, F.col("task")).alias("query"))
                    for s in ("eva", "trec", "climate", "biosses")])
    return q.select("qid", F.explode(out).alias("x")).select("qid", "x.suite", "x.query")


@register("embed_texts", O.with_(O.CORPUS_TXT, O.hash_feat_cte("dfeat", "corpus_txt", "idx", "passage"))
          + "SELECT id, bucket, value FROM dfeat WHERE value <> 0")
def q_embed_texts(spark, sf_dir):
    """E1 with the Python encoder that stands in for a model; counts are exact in 32-bit floats."""
    from .catalog import corpus_txt
    v = EM.embed_texts(corpus_txt(spark, sf_dir), "passage", EM.numpy_hash_encoder(64), 64, normalize=False, keep=("idx",))
    return (v.select(F.col("idx").alias("id"), F.posexplode("embedding").alias("bucket", "value")).where("value <> 0")
            .select("id", F.col("bucket").cast("long"), F.col("value").cast("double").alias("value")))


@register("embed_missing", """SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 3 = 0 AND md5(s.text) = md5(d.text))""")
def q_embed_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("m").alias("model"), F.lit("s").alias("suite"), F.md5("text").alias("content_md5"))
    return EM.embed_missing(d, d.where(F.col("doc_id") % 3 == 0)).select("doc_id")


def _store_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("m").alias("model"), F.col("source").alias("suite"), "text")


def _store_encode(df):
    return EM.hash_encode(df, "content_md5", "text", normalize=False)


@register("store_embed", O.with_("""texts AS (SELECT DISTINCT source, text, md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL),
once AS (SELECT content_md5, any_value(text) AS text FROM texts GROUP BY content_md5)""", O.hash_feat_cte("f", "once", "content_md5", "text")) + """SELECT t.source AS suite, t.content_md5, CAST(1 AS BIGINT) AS n,
  coalesce(v.total, 0) AS total FROM texts t LEFT JOIN (SELECT id, sum(value * (bucket + 1)) AS total FROM f GROUP BY id) v ON v.id = t.content_md5""")
def q_store_embed(spark, sf_dir):
    """E7 with a store by hash prefix (B2): the first run gets a third of the documents, the second all of them and
    encodes only what is missing; one vector per suite and text."""
    path = shared_path(spark, "vectors-by-prefix")
    texts = _store_texts(spark, sf_dir)
    EM.embed_into_store(texts.where(F.col("doc_id") % 3 == 0), path, _store_encode, digits=1)
    EM.embed_into_store(texts, path, _store_encode, digits=1)
    total = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return (EM.read_store(spark, path).groupBy("suite", "content_md5", total.alias("total")).agg(F.count(F.lit(1)).alias("n")))


@register("store_check", """SELECT source AS suite, CAST(count(DISTINCT md5(text)) AS BIGINT) AS n_texts, CAST(count(DISTINCT CASE WHEN seen THEN md5(text) END) AS BIGINT) AS n_vectors
FROM (SELECT source, text, bool_or(doc_id % 50 <> 7) OVER (PARTITION BY source, text) AS seen FROM documents WHERE text IS NOT NULL)
GROUP BY source HAVING count(DISTINCT md5(text)) <> count(DISTINCT CASE WHEN seen THEN md5(text) END)""")
def q_store_check(spark, sf_dir):
    """E8 against a store that got no texts of every fiftieth document."""
    path = shared_path(spark, "vectors-by-prefix")
    texts = _store_texts(spark, sf_dir)
    EM.embed_into_store(texts.where(F.col("doc_id") % 50 != 7), path, _store_encode, digits=1)
    return EM.check_store(texts, path, digits=1).select("suite", "n_texts", "n_vectors")


@register("check_embedding_count", """SELECT source AS suite, CAST(count(*) AS BIGINT) AS n_texts, CAST(count(*) FILTER (WHERE doc_id % 50 <> 7) AS BIGINT) AS n_vectors
FROM documents GROUP BY source HAVING count(*) <> count(*) FILTER (WHERE doc_id % 50 <> 7)""")
def q_check_embedding_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("m").alias("model"), F.col("source").alias("suite"))
    return EM.check_embedding_count(d, d.where(F.col("doc_id") % 50 != 7)).select("suite", "n_texts", "n_vectors")


def _hits(spark, sf_dir):
    """Text hits with their passages (F3) and the query texts."""
    from .catalog import corpus_txt, q_txt_prefixed, text_topk
    corpus = corpus_txt(spark, sf_dir)
    hits = text_topk(spark, sf_dir, corpus=corpus).select("qid", "rank", F.col("idx").alias("did"), "score")
    h = hydrate_hits(hits, corpus, idx="idx", cols=("did", "passage"))
    q = q_txt_prefixed(spark, sf_dir).select("qid", "query")
    return h.withColumnRenamed("hit_did", "doc_id").withColumnRenamed("hit_passage", "passage").join(q, "qid")


@register("hydrate_hits", O.with_(O.TEXT_TOPK) + """SELECT t.qid, t.rank, c.did AS doc_id, md5(c.passage) AS passage_md5
FROM text_topk t JOIN corpus_txt c ON c.idx = t.idx""")
def q_hydrate_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("qid", "rank", "doc_id", F.md5("passage").alias("passage_md5"))


@register("text_key_join", O.with_(O.TEXT_TOPK, O.QRELS_TXT) + """,
tq AS (SELECT q.query, c.passage, arg_max(r.score, CAST(r.dkey AS BIGINT)) AS score
       FROM qrels_txt r JOIN q_txt q ON CAST(q.qid AS VARCHAR) = r.qkey JOIN corpus_txt c ON c.did = r.dkey GROUP BY q.query, c.passage)
SELECT t.qid, t.rank, tq.score FROM text_topk t JOIN corpus_txt c ON c.idx = t.idx JOIN q_txt q ON q.qid = t.qid
LEFT JOIN tq ON tq.query = q.query AND tq.passage = c.passage""")
def q_text_key_join(spark, sf_dir):
    """G7, with judgements repeated by equal texts settled by G5 (the last one wins)."""
    from .catalog import corpus_txt, q_txt_prefixed, qrels_txt
    run = _hits(spark, sf_dir).withColumn("task", F.lit("QA")).withColumn("event", F.lit("txt"))
    corpus = corpus_txt(spark, sf_dir).select(F.col("did").alias("dkey"), "passage")
    q = q_txt_prefixed(spark, sf_dir).select(F.col("qid").cast("string").alias("qkey"), "query")
    texts = qrels_txt(spark, sf_dir).join(q, "qkey").join(corpus, "dkey").withColumn("_pos", F.col("dkey").cast("long")).drop("qkey", "dkey")
    keyed = judge.text_key(texts)
    once = judge.qrels_dedupe(keyed, ("_pos",)).join(
        keyed.groupBy(*judge.QKEYS, "dkey").agg(F.first("query").alias("query"), F.first("passage").alias("passage")), [*judge.QKEYS, "dkey"])
    out = judge.text_key_join(run, once)
    return out.select("qid", "rank", F.col("grade").alias("score"))


@register("stream_pack", O.with_(O.PACKED) + """SELECT batch_no, block_no, CAST(len(ids) AS INTEGER) AS n_ids,
  md5(array_to_string(ids, ' ')) AS ids_md5 FROM blocks""")
def q_stream_pack(spark, sf_dir):
    """The documents arrive as a stream, are cut into lines and packed per micro-batch (here one)."""
    path = shared_path(spark, "stream-pack")
    docs = read_table_stream(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    stream_pack(lines, "line", O.PACK_L, path, order_cols=("doc_id", "line_no"))
    b = spark.read.parquet(path)
    return b.select("batch_no", "block_no", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", " ")).alias("ids_md5"))


@register("stream_embed", O.with_("""texts AS (SELECT md5(text) AS id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY md5(text))""",
                                  O.hash_feat_cte("f", "texts", "id", "text")) + """SELECT f.id AS content_md5, f.bucket, round(f.value / n.norm, 6) AS value
FROM f JOIN (SELECT id, sqrt(sum(value * value)) AS norm FROM f GROUP BY id) n USING (id) WHERE n.norm > 0 AND f.value <> 0""")
def q_stream_embed(spark, sf_dir):
    """S3: the documents arrive in several files, two a micro-batch; a text is embedded when it first comes."""
    path, src = shared_path(spark, "vector-store"), shared_path(spark, "arriving")
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.lit("m").alias("model"), F.lit("s").alias("suite"), "text")
    d.repartition(6).write.parquet(src)
    stream_embed(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(src), path)
    v = spark.read.parquet(path).select("content_md5", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0")
    return v.select("content_md5", F.col("bucket").cast("long"), F.round("value", 6).alias("value"))
