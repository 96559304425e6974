"""Registered queries of readers and sinks over files (A1, A2, A4, A7, B2, B4), task
selection (C13), union of sources (D3) and the sweep with a result store (K1, G6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge
from ..operators import reports as R
from ..operators.corpus import union_sources
from ..session import freeze, shared_path, table
from ..sources import readers, sinks
from . import oracle as O
from . import views as V
from .registry import ORACLE, register


@register("passages_from_arrays", f"""SELECT md5({O.strip_sql('text')}) AS passage_md5, CAST(count(*) AS BIGINT) AS n
FROM documents WHERE length({O.strip_sql('text')}) > 0 GROUP BY 1""")
def q_passages_from_arrays(spark, sf_dir):
    """A2 on JSON array files, read by byte ranges."""
    path = shared_path(spark, "passage-arrays")
    sinks.write_json_arrays(table(spark, sf_dir, "documents").where("text is not null").select("text"), path)
    return readers.read_passages(spark, path).groupBy(F.md5("passage").alias("passage_md5")).agg(F.count(F.lit(1)).alias("n"))


@register("text_from_csv", "SELECT md5(text) AS text_md5, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE length(text) > 0 GROUP BY 1")
def q_text_from_csv(spark, sf_dir):
    """A7 on CSV files whose quoted texts hold newlines and quotes."""
    path = shared_path(spark, "csv-text")
    t = table(spark, sf_dir, "conversations").where(F.length("text") > 0).select("conv_id", "text")
    sinks.write_csv(t, path)
    return readers.read_text(spark, path, "csv").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@register("qrels_from_dir", O.with_(O.QRELS_TXT) + "SELECT 'QA' AS task, 'txt_dev' AS event, md5('q ' || qkey) AS qkey, md5('d ' || dkey) AS dkey, score FROM qrels_txt")
def q_qrels_from_dir(spark, sf_dir):
    """A4: files named <task>_<event>_qrels.json, the event with an underscore, keyed by texts."""
    from .catalog import qrels_txt
    path = shared_path(spark, "qrels-dir")
    q = qrels_txt(spark, sf_dir).select(F.concat(F.lit("q "), "qkey").alias("user_query"), F.concat(F.lit("d "), "dkey").alias("passage"), "score")
    q.write.json(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, st in enumerate(fs.listStatus(jvm.org.apache.hadoop.fs.Path(path))):  # the writer cannot name files
        if st.getPath().getName().startswith("part-"):
            folder = jvm.org.apache.hadoop.fs.Path(path, f"set-{i}")
            fs.mkdirs(folder)
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(folder, "QA_txt_dev_qrels.json"))
    r = readers.read_qrels(spark, f"{path}/set-*")
    return r.select("task", "event", F.md5("qkey").alias("qkey"), F.md5("dkey").alias("dkey"), "score")


@register("embeddings_store", """SELECT vec_id, 's' || CAST(label % 3 AS VARCHAR) AS suite, CAST(len(embedding) AS INTEGER) AS dim,
  round(list_sum(embedding), 4) AS total FROM embeddings WHERE label % 3 = 1""")
def q_embeddings_store(spark, sf_dir):
    """B2, then A8 with a filter that prunes folders."""
    path = shared_path(spark, "embedding-store")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit("m").alias("model"), F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("suite"))
    sinks.write_embeddings(v, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return (readers.read_embeddings(spark, path).where("suite = 's1'")
            .select("vec_id", "suite", F.size("embedding").alias("dim"), F.round(total, 4).alias("total")))


_METRICS = O.with_(O.VEC_VIEWS, O.metrics_ctes("run_vec", "qrels_vec"))


@register("metrics_written", _METRICS + f""", ev AS ({O.PER_EVENT_SELECT}), tk AS ({O.PER_TASK_SELECT}), st AS ({O.STATS_SELECT}), ov AS ({O.OVERALL_SELECT})
SELECT 'event' AS file, variant || ' ' || search_task || ' ' || event_type AS key, "NDCG@10" AS value FROM ev
UNION ALL SELECT 'task', search_task, "NDCG@10" FROM tk
UNION ALL SELECT 'overall', '', round(overall_ndcg, 4) FROM ov
UNION ALL SELECT 'stats', '', CAST(total_retrieved_pairs AS DOUBLE) FROM st""")
def q_metrics_written(spark, sf_dir):
    """B4, read back from its files."""
    run = freeze(V.run_vec(spark, sf_dir), "run-vec")
    got = judge.evaluate_suite(run, V.qrels_vec(spark, sf_dir, run), "eva")
    path = shared_path(spark, "metric-files")
    sinks.write_metrics(got["per_event"], got["per_task"], got["overall"], got["stats"], path)
    csv = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    ndcg = F.col("`NDCG@10`").cast("double").alias("value")
    out = csv("ndcg_per_task").select(F.lit("task").alias("file"), F.col("search_task").alias("key"), ndcg)
    for v in ("zero", "ignore"):
        out = out.unionByName(csv(f"metrics_{v}_per_event").select(F.lit("event").alias("file"), F.concat_ws(" ", F.lit(v), "search_task", "event_type").alias("key"), ndcg))
    overall = spark.read.text(f"{path}/ndcg_overall").select(F.lit("overall").alias("file"), F.lit("").alias("key"), F.regexp_extract("value", r"([0-9.]+)$", 1).cast("double").alias("value"))
    stats = spark.read.json(f"{path}/retrieval_stats").select(F.lit("stats").alias("file"), F.lit("").alias("key"), F.col("total_retrieved_pairs").cast("double").alias("value"))
    return out.unionByName(overall).unionByName(stats)


@register("selected_tasks", _METRICS + f"SELECT * FROM ({O.PER_TASK_SELECT}) WHERE search_task IN ('QA', 'STS')")
def q_selected_tasks(spark, sf_dir):
    """The run restricted to two tasks before it is judged."""
    run = freeze(V.run_vec(spark, sf_dir), "run-vec")
    qrels = V.qrels_vec(spark, sf_dir, run)
    return judge.per_task(judge.per_query(judge.select_tasks(run, ["QA", "STS"]), qrels, 10))


@register("sources_union", O.with_(O.TRAIN_PAIRS) + """SELECT CAST(dataset_id AS BIGINT) AS dataset_id, CAST(count(*) FILTER (WHERE kind = 'pos') AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE kind = 'pos' AND dataset_id < 2) AS BIGINT) AS typed,
  CAST(count(*) FILTER (WHERE kind = 'neg' AND dataset_id >= 2) AS BIGINT) AS scored
FROM pairs_long GROUP BY dataset_id""")
def q_sources_union(spark, sf_dir):
    """D3: two sources with different columns, one typed and one with scores."""
    t = freeze(V.train_pairs(spark, sf_dir), "train-pairs")
    typed = t.where("dataset_id < 2").drop("neg_scores").withColumn("type", F.lit("normal"))
    both = union_sources(typed, t.where("dataset_id >= 2"))
    return both.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count("type").alias("typed"),
                                          F.coalesce(F.sum(F.size("neg_scores")).cast("long"), F.lit(0)).alias("scored"))


@register("sweep_incremental", ORACLE["sweep_per_event"])
def q_sweep_incremental(spark, sf_dir):
    """K1 with G6: two checkpoints are searched and stored; a second run with all of them searches only the new one."""
    store = shared_path(spark, "sweep-store")
    queries = freeze(V.checkpoint_queries(spark, sf_dir), "checkpoint-queries")
    qrels = freeze(V.qrels_vec(spark, sf_dir), "qrels-vec")  # one search serves both runs

    def evaluate(new):
        return judge.per_event(judge.per_query(V.models_run(spark, sf_dir, queries=new), qrels, 10))

    first = ["checkpoint-10", "checkpoint-20"]
    R.run_sweep(queries.where(F.col("model").isin(first)), evaluate, store)
    return R.run_sweep(queries, evaluate, store)
