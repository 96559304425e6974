"""Registered queries of the single-file suites (H9-H11 with C4, C12) and of
the way from files to metrics and training sets (A2-A9, B1, B3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_keys, parse_grade
from ..operators import corpus as C
from ..operators import judge
from ..session import freeze, shared_path
from ..sources import readers, sinks
from . import oracle as O
from . import views as V
from .registry import register

# ---- TREC and climate form: id keys, blank query ids skipped first ----------------------


def _id_suite(spark, sf_dir, event):
    from .catalog import qrels_txt, run_txt
    run = run_txt(spark, sf_dir).withColumn("event", F.lit(event))
    run = run.withColumn("qkey", F.when(F.col("qrow") % 7 == 0, "").otherwise(F.col("qkey")))
    return freeze(run, "run"), qrels_txt(spark, sf_dir).withColumn("event", F.lit(event))


def _id_sql(event):
    return O.with_(O.TEXT_TOPK, O.QRELS_TXT, O.RUN_TXT, f"""
run_id AS (SELECT * REPLACE ('{event}' AS event) FROM run_txt WHERE qrow % 7 <> 0),
qrels_id AS (SELECT * REPLACE ('{event}' AS event) FROM qrels_txt)""", O.metrics_ctes("run_id", "qrels_id"))


# the row of the suite is there even without judged queries
_FILLED = """SELECT model, search_task, event_type, variant, num_queries, "NDCG@10", "RR@10", "REC@10" FROM ev
UNION ALL SELECT m.model, '{task}', '{event}', v.variant, 0, 0, 0, 0 FROM (SELECT DISTINCT model FROM run_id) m, (VALUES ('zero'), ('ignore')) v(variant)
WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.model = m.model AND ev.variant = v.variant)"""


@register("suite_trec", _id_sql("trec_covid") + ", ev AS (" + O.PER_EVENT_SELECT + ") " + _FILLED.format(task="QA", event="trec_covid"))
def q_suite_trec(spark, sf_dir):
    run, qrels = _id_suite(spark, sf_dir, "trec_covid")
    return judge.evaluate_suite(run, qrels, "trec")["per_event"]


@register("suite_climate", _id_sql("climate_fever") + O.STATS_SELECT)
def q_suite_climate(spark, sf_dir):
    run, qrels = _id_suite(spark, sf_dir, "climate_fever")
    return judge.evaluate_suite(run, qrels, "climate")["stats"]


# ---- STS form: text grades, pairs uncut, unjudged removed before the cut ----------------

_STS = f"""pairs_ AS (
  SELECT conv_id || '-' || turn AS id, lead(text) OVER w AS text_2, conv_id || '-' || lead(turn) OVER w AS document_id,
         CASE WHEN (conv_id * 8 + turn) % 17 = 0 THEN 'n/a' ELSE printf('%.3f', 5.0 * {O.u01_sql("'sts'", 'conv_id', 'turn')}) END AS label
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
sts AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM pairs_ WHERE text_2 IS NOT NULL)"""


@register("sts_corpus", O.with_(_STS) + f"""SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS idx, document_id AS did, {O.strip_sql('text_2')} AS passage
FROM sts WHERE length({O.strip_sql('text_2')}) > 0""")
def q_sts_corpus(spark, sf_dir):
    return C.sts_corpus(V.sts_pairs(spark, sf_dir), ["id"])


@register("parse_grade", O.with_(_STS) + "SELECT id, coalesce(TRY_CAST(label AS DOUBLE), 0.0) AS grade FROM sts")
def q_parse_grade(spark, sf_dir):
    p = V.sts_pairs(spark, sf_dir).where(has_keys("id", "document_id"))
    return p.select("id", parse_grade("label").alias("grade"))


def _sts(spark, sf_dir):
    """Run: the documents of the next 12 pairs; judged: the own one and the one at rank 12, but for every fifth pair."""
    ix = C.ordered_index(V.sts_pairs(spark, sf_dir), ["id"])
    n = ix.count()
    docs = ix.select(F.col("idx").alias("at"), F.col("document_id").alias("dkey"))
    hop = lambda o: (F.col("idx") + o) % max(n, 1)
    run = (ix.select("id", "idx", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("o")).withColumn("at", hop(F.col("o"))).join(docs, "at")
           .select(F.lit("seq").alias("model"), F.lit("STS").alias("task"), F.lit("biosses").alias("event"), F.col("idx").alias("qrow"),
                   F.col("id").alias("qkey"), (F.col("o") + 1).cast("long").alias("rank"), "dkey"))
    judged = ix.where((F.col("idx") % 5 != 0) & has_keys("id", "document_id"))
    qrels = (judged.select("id", "label", F.explode(F.array(F.col("idx"), hop(F.lit(11)))).alias("at")).join(docs, "at")
             .select(F.lit("STS").alias("task"), F.lit("biosses").alias("event"), F.col("id").alias("qkey"), "dkey", parse_grade("label").alias("score")))
    return run, qrels.distinct()


_STS_RUN = O.with_(_STS, """run_sts AS (
  SELECT 'seq' AS model, 'STS' AS task, 'biosses' AS event, a.idx AS qrow, a.id AS qkey, CAST(t.o + 1 AS BIGINT) AS rank, b.document_id AS dkey
  FROM sts a, unnest(range(0, 12)) t(o), sts b WHERE b.idx = (a.idx + t.o) % a.n)""", """qrels_sts AS (
  SELECT DISTINCT 'STS' AS task, 'biosses' AS event, a.id AS qkey, b.document_id AS dkey, coalesce(TRY_CAST(a.label AS DOUBLE), 0.0) AS score
  FROM sts a, unnest([0, 11]) t(o), sts b WHERE a.idx % 5 <> 0 AND b.idx = (a.idx + t.o) % a.n)""",
                   O.metrics_ctes("run_sts", "qrels_sts", cut_before_filter=False, stats_uncut=True))


@register("suite_biosses", _STS_RUN + O.PER_EVENT_SELECT)
def q_suite_biosses(spark, sf_dir):
    run, qrels = _sts(spark, sf_dir)
    return judge.evaluate_suite(run, qrels, "biosses")["per_event"]


@register("suite_biosses_stats", _STS_RUN + O.STATS_SELECT)
def q_suite_biosses_stats(spark, sf_dir):
    run, qrels = _sts(spark, sf_dir)
    return judge.evaluate_suite(run, qrels, "biosses")["stats"]


# ---- files: written from the tables, read back ----------------------------------------------

@register("corpus_from_files", O.with_(O.CORPUS_TXT) + "SELECT idx, did, md5(passage) AS passage_md5 FROM corpus_txt")
def q_corpus_from_files(spark, sf_dir):
    """B1, then A8's kind of read."""
    from .catalog import corpus_txt
    path = shared_path(spark, "corpus-files")
    sinks.write_corpus(corpus_txt(spark, sf_dir), path)
    return readers.read_embeddings(spark, path).select("idx", "did", F.md5("passage").alias("passage_md5"))


@register("passages_from_files", f"""SELECT md5({O.strip_sql('text')}) AS passage_md5, CAST(count(*) AS BIGINT) AS n
FROM documents WHERE length({O.strip_sql('text')}) > 0 GROUP BY 1""")
def q_passages_from_files(spark, sf_dir):
    """A2 on files of one JSON string per line."""
    path = shared_path(spark, "passage-files")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    one = F.to_json(F.array("text"))
    d.select(F.substring(one, F.lit(2), F.length(one) - 2).alias("value")).write.text(f"{path}/txt")
    _as_json(spark, f"{path}/txt")
    return readers.read_passages(spark, f"{path}/txt").groupBy(F.md5("passage").alias("passage_md5")).agg(F.count(F.lit(1)).alias("n"))


def _as_json(spark, path):
    """Give the text writer's part files the ending that the readers look for."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("part-"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(p, name.rsplit(".", 1)[0] + ".json"))


@register("metrics_from_files", O.with_(O.VEC_VIEWS, O.metrics_ctes("run_vec", "qrels_vec")) + O.PER_EVENT_SELECT)
def q_metrics_from_files(spark, sf_dir):
    """B3, then A9 and A3, then H7 and H8: the run goes through label-pool files."""
    run = freeze(V.run_vec(spark, sf_dir), "run-vec")
    qrels = V.qrels_vec(spark, sf_dir, run)
    qrels = qrels.withColumn("qkey", F.col("qkey").cast("string")).withColumn("dkey", F.col("dkey").cast("string"))
    path = shared_path(spark, "label-pool")
    sinks.write_label_pool(run.select("model", "task", "event", "qrow", F.concat(F.lit("q"), "qkey").alias("query"), F.col("qkey").cast("string").alias("qid"),
                                      "rank", F.concat(F.lit("d"), "dkey").alias("passage"), F.col("dkey").cast("string").alias("doc_id")), path)
    hits, queries = readers.read_runs(spark, f"{path}/model=*/task=*/event=*", model="base", qrels=qrels, keys="id")
    return judge.per_event(judge.per_query(hits, qrels, 10, queries=queries))


_TRAIN_FILES = O.TRAIN_PAIRS


@register("train_from_files", O.with_(_TRAIN_FILES) + """SELECT CAST(dataset_id AS BIGINT) AS dataset, CAST(count(DISTINCT row_id) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE kind = 'neg') AS BIGINT) AS negs, round(sum(score) FILTER (WHERE kind = 'pos'), 6) AS pos_score
FROM pairs_long GROUP BY dataset_id""")
def q_train_from_files(spark, sf_dir):
    """A6 on V9 written as JSON Lines, a directory per dataset."""
    path = shared_path(spark, "train-files")
    V.train_pairs(spark, sf_dir).drop("row_id").write.partitionBy("dataset_id").json(path)
    t = readers.read_train(spark, [f"{path}/dataset_id=*"], distill=True)
    ds = F.regexp_extract("source_dir", "dataset_id=([0-9]+)$", 1).cast("long")
    return t.groupBy(ds.alias("dataset")).agg(F.countDistinct("row_id").alias("n"), F.sum(F.size("neg")).cast("long").alias("negs"),
                                              F.round(F.sum(F.col("pos_scores")[0]), 6).alias("pos_score"))


@register("qrels_from_files", O.with_(O.QRELS_TXT) + """SELECT task, event, qkey, dkey, score FROM qrels_txt""")
def q_qrels_from_files(spark, sf_dir):
    """A5 (ids) on JSON Lines, with G5 over the file order."""
    from .catalog import qrels_txt
    path = shared_path(spark, "qrels-files")
    q = qrels_txt(spark, sf_dir)
    q.select(F.col("qkey").alias("query-id"), F.col("dkey").alias("corpus-id"), F.col("score").cast("int").cast("string").alias("score")).write.json(path)
    return judge.qrels_dedupe(readers.read_qrels_ids(spark, path, "QA", "txt")).select("task", "event", "qkey", "dkey", "score")
