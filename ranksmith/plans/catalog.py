"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their
DuckDB oracle SQL. ``__spark_entry__`` exposes both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judge
from ..operators.search import build_index, exact_topk
from ..session import freeze, shared_path, table
from . import oracle as O
from . import views as V
from .registry import ORACLE, QUERIES, register  # noqa: F401

# ---- F1: exact top-k --------------------------------------------------------

@register("topk_vec", O.with_(O.V1, O.V2, O.topk_cte("topk_vec", "q_vec", "c_vec"))
          + "SELECT qid, CAST(rank AS BIGINT) AS rank, did, score FROM topk_vec")
def q_topk_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.q_vec(spark, sf_dir)
    c = V.c_vec(spark, sf_dir)
    return exact_topk(q, c, 10, qid="qid", did="did", vec="embedding")


@register("topk_vec_index", ORACLE["topk_vec"])
def q_topk_vec_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through the pruning index."""
    index = build_index(V.c_vec(spark, sf_dir), did="did", vec="embedding")
    return exact_topk(V.q_vec(spark, sf_dir), index, 10, qid="qid", vec="embedding")


# ---- V3: judgements from label distance -------------------------------------

@register("qrels_vec", O.with_(O.VEC_VIEWS) + "SELECT task, event, qkey, dkey, score FROM qrels_vec")
def q_qrels_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.qrels_vec(spark, sf_dir)


# ---- H8-H14 on the vector run ------------------------------------------------

def _vec_perq(spark, sf_dir):
    run = freeze(V.run_vec(spark, sf_dir), "run-vec")  # one search serves the run and its pool of judgements
    return judge.per_query(run, V.qrels_vec(spark, sf_dir, run), 10)


_VEC_METRICS = O.with_(O.VEC_VIEWS, O.metrics_ctes("run_vec", "qrels_vec"))


@register("metrics_per_event", _VEC_METRICS + O.PER_EVENT_SELECT)
def q_metrics_per_event(spark, sf_dir):
    return judge.per_event(_vec_perq(spark, sf_dir))


@register("metrics_per_task", _VEC_METRICS + O.PER_TASK_SELECT)
def q_metrics_per_task(spark, sf_dir):
    return judge.per_task(_vec_perq(spark, sf_dir))


@register("metrics_overall", _VEC_METRICS + O.OVERALL_SELECT)
def q_metrics_overall(spark, sf_dir):
    return judge.overall(_vec_perq(spark, sf_dir))


@register("retrieval_stats", _VEC_METRICS + O.STATS_SELECT)
def q_retrieval_stats(spark, sf_dir):
    return judge.retrieval_stats(_vec_perq(spark, sf_dir))


# ---- K1/K2: several checkpoints in one job ----------------------------------

_SWEEP = O.with_(O.VEC_VIEWS, O.V5, O.metrics_ctes("models_run", "qrels_vec"))


def _sweep_perq(spark, sf_dir):
    return freeze(judge.per_query(V.models_run(spark, sf_dir), V.qrels_vec(spark, sf_dir), 10), "sweep")


@register("sweep_per_event", _SWEEP + O.PER_EVENT_SELECT)
def q_sweep_per_event(spark, sf_dir):
    return judge.per_event(_sweep_perq(spark, sf_dir))


@register("sweep_per_task", _SWEEP + O.PER_TASK_SELECT)
def q_sweep_per_task(spark, sf_dir):
    return judge.per_task(_sweep_perq(spark, sf_dir))


# ---- text path: corpus, prefixes, hashed vectors, text top-k, judgements -----

from ..functions.text import task_prefix  # noqa: E402
from ..functions.vectors import l2_normalize  # noqa: E402
from ..operators import corpus as C  # noqa: E402
from ..operators import embed as EM  # noqa: E402


def corpus_txt(spark, sf_dir):
    return C.title_text_corpus(V.corpus_txt(spark, sf_dir), ["title", "_id"])


def q_txt_prefixed(spark, sf_dir):
    q = V.q_txt(spark, sf_dir)
    return q.select(F.col("_id").alias("qid"), F.lit("QA").alias("task"),
                    task_prefix(F.col("text"), F.lit("QA")).alias("query"))


@register("corpus_txt", O.with_(O.CORPUS_TXT) + "SELECT idx, did, passage FROM corpus_txt")
def q_corpus_txt(spark, sf_dir):
    return corpus_txt(spark, sf_dir)


@register("duplicate_report", O.with_(O.CORPUS_TXT) + """SELECT md5(passage) AS passage_md5,
  CAST(count(*) AS BIGINT) AS copies, min(idx) AS first_idx, max(idx) AS last_idx
FROM corpus_txt GROUP BY md5(passage) HAVING count(*) > 1""")
def q_duplicate_report(spark, sf_dir):
    return C.duplicate_report(corpus_txt(spark, sf_dir))


@register("query_prefix", O.with_(O.Q_TXT) + "SELECT qid, task, query FROM q_txt")
def q_query_prefix(spark, sf_dir):
    return q_txt_prefixed(spark, sf_dir)


@register("hash_features", O.with_(O.CORPUS_TXT, O.hash_feat_cte("dfeat", "corpus_txt", "idx", "passage"))
          + "SELECT id, bucket, value FROM dfeat")
def q_hash_features(spark, sf_dir):
    return EM.hash_features(corpus_txt(spark, sf_dir), "idx", "passage", 64)


def text_topk(spark, sf_dir, k: int = 10, corpus=None):
    corpus = corpus if corpus is not None else corpus_txt(spark, sf_dir)
    # written first: a task runs the encoder or the search, so that no core feeds two Python workers
    dv = freeze(EM.hash_encode(corpus, "idx", "passage", 64), "text-vectors")
    qv = EM.hash_encode(q_txt_prefixed(spark, sf_dir), "qid", "query", 64)
    hits = exact_topk(qv, dv, k, qid="qid", did="idx", vec="embedding")
    return (hits.join(corpus.select(F.col("idx").alias("did"), F.col("did").alias("doc_id")), "did")
            .select("qid", "rank", F.col("did").alias("idx"), F.col("doc_id").alias("did"), "score"))


@register("text_topk", O.with_(O.TEXT_TOPK) + "SELECT qid, rank, idx, did, score FROM text_topk")
def q_text_topk(spark, sf_dir):
    return text_topk(spark, sf_dir)


def qrels_txt(spark, sf_dir):
    return V.qrels_txt(spark, sf_dir).select(
        "task", "event", F.col("qkey").cast("string").alias("qkey"),
        F.col("dkey").cast("string").alias("dkey"), "score")


@register("qrels_txt", O.with_(O.QRELS_TXT) + "SELECT task, event, qkey, dkey, score FROM qrels_txt")
def q_qrels_txt(spark, sf_dir):
    return qrels_txt(spark, sf_dir)


def run_txt(spark, sf_dir):
    t = text_topk(spark, sf_dir)
    return t.select(F.lit("hash64").alias("model"), F.lit("QA").alias("task"), F.lit("txt").alias("event"),
                    F.col("qid").alias("qrow"), F.col("qid").cast("string").alias("qkey"), "rank",
                    F.col("did").alias("dkey"), "score")


_TXT_METRICS = O.with_(O.TEXT_TOPK, O.QRELS_TXT, O.RUN_TXT, O.metrics_ctes("run_txt", "qrels_txt"))


@register("text_metrics_per_event", _TXT_METRICS + O.PER_EVENT_SELECT)
def q_text_metrics_per_event(spark, sf_dir):
    pq = judge.per_query(run_txt(spark, sf_dir), qrels_txt(spark, sf_dir), 10)
    return judge.per_event(pq)


@register("text_retrieval_stats", _TXT_METRICS + O.STATS_SELECT)
def q_text_retrieval_stats(spark, sf_dir):
    pq = judge.per_query(run_txt(spark, sf_dir), qrels_txt(spark, sf_dir), 10)
    return judge.retrieval_stats(pq)


# ---- E3-E6: normalisation and pooling over token states -----------------------

def token_states(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("text_id"),
                    (F.col("vec_id") % 8).cast("int").alias("pos"),
                    F.when((F.col("vec_id") % 8) > 5, 0).otherwise(1).alias("mask"),
                    F.col("embedding").alias("state"))


_STATES = """states AS (SELECT vec_id // 8 AS text_id, CAST(vec_id % 8 AS INTEGER) AS pos,
  CASE WHEN vec_id % 8 > 5 THEN 0 ELSE 1 END AS mask, embedding AS state FROM embeddings)"""


def _long_form(df, vec="pooled"):
    return df.select("text_id", F.posexplode(vec).alias("dim", "v")).select(
        "text_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value"))


_LONG = """SELECT text_id, CAST(d.dim - 1 AS BIGINT) AS dim, round(CAST(pooled[d.dim] AS DOUBLE), 6) AS value
FROM pooled, (SELECT unnest(range(1, 65)) AS dim) d WHERE d.dim <= len(pooled)"""


@register("pool_cls", O.with_(_STATES, "pooled_src AS (SELECT text_id, arg_min(state, pos) AS pooled FROM states GROUP BY text_id)")
          .replace("pooled_src", "pooled") + _LONG)
def q_pool_cls(spark, sf_dir):
    return _long_form(EM.pool_cls(token_states(spark, sf_dir)))


@register("pool_last", O.with_(_STATES, "pooled AS (SELECT text_id, arg_max(state, pos) AS pooled FROM states WHERE mask = 1 GROUP BY text_id)") + _LONG)
def q_pool_last(spark, sf_dir):
    return _long_form(EM.pool_last(token_states(spark, sf_dir)))


@register("pool_mean", O.with_(_STATES) + """SELECT text_id, CAST(d.dim - 1 AS BIGINT) AS dim,
  round(avg(CAST(state[d.dim] AS DOUBLE)), 6) AS value
FROM states, (SELECT unnest(range(1, 65)) AS dim) d WHERE mask = 1 AND d.dim <= len(state)
GROUP BY text_id, d.dim""")
def q_pool_mean(spark, sf_dir):
    p = EM.pool_mean(token_states(spark, sf_dir))
    return p.select("text_id", F.col("dim").cast("long"), F.round("value", 6).alias("value"))


@register("l2_normalize", O.with_(O.CORPUS_TXT, O.hash_feat_cte("dfeat", "corpus_txt", "idx", "passage"))
          + """SELECT f.id, f.bucket, round(f.value / n.norm, 6) AS value
FROM dfeat f JOIN (SELECT id, sqrt(sum(value * value)) AS norm FROM dfeat GROUP BY id) n USING (id)
WHERE n.norm > 0""")
def q_l2_normalize(spark, sf_dir):
    # sparse vectors: the norm of a row's values is bound once, the empty buckets stay out
    f = EM.hash_arrays(corpus_txt(spark, sf_dir), "idx", "passage", 64)
    unit = f.select("id", "buckets", l2_normalize("vals").alias("vals"))
    return (unit.where(F.exists("vals", lambda x: x != 0)).select("id", F.explode(F.arrays_zip("buckets", "vals")).alias("z"))
            .select("id", F.col("z.buckets").alias("bucket"), F.round(F.col("z.vals"), 6).alias("value")))


# ---- I: training pairs, groups, batch plan ---------------------------------------

from ..operators import train_data as T  # noqa: E402


def train_pairs_long(df):
    def side(kind, texts, scores):
        z = df.select("row_id", "dataset_id", "query", F.lit(kind).alias("kind"),
                      F.posexplode(F.arrays_zip(texts, scores)).alias("j", "z"))
        return z.select("row_id", "dataset_id", "query", "kind", F.col("j").cast("long").alias("j"),
                        F.col(f"z.{texts}").alias("text"), F.col(f"z.{scores}").alias("score"))
    return side("pos", "pos", "pos_scores").unionByName(side("neg", "neg", "neg_scores"))


@register("train_pairs", O.with_(O.TRAIN_PAIRS) + "SELECT row_id, dataset_id, query, kind, j, text, score FROM pairs_long")
def q_train_pairs(spark, sf_dir):
    return train_pairs_long(V.train_pairs(spark, sf_dir))


def train_groups(spark, sf_dir):
    return T.build_groups(V.train_pairs(spark, sf_dir), seed=O.SEED, epoch=O.EPOCH, group=O.GROUP,
                          query_instruction=O.QA_INS, query_format="{}: {}", shuffle_ratio=O.RATIO)


@register("train_groups", O.with_(O.TRAIN_GROUPS) + "SELECT row_id, dataset_id, query, j, text, teacher FROM groups_long")
def q_train_groups(spark, sf_dir):
    g = train_groups(spark, sf_dir)
    return g.select("row_id", "dataset_id", "query",
                    F.posexplode(F.arrays_zip("passages", "teacher")).alias("j", "z")).select(
        "row_id", "dataset_id", "query", F.col("j").cast("long").alias("j"),
        F.col("z.passages").alias("text"), F.col("z.teacher").alias("teacher"))


def batch_plan(spark, sf_dir, world: int = 2, default_bs: int = 16):
    pairs = V.train_pairs(spark, sf_dir)
    sizes = pairs.select("dataset_id").distinct().withColumn("batch_size", F.lit(default_bs))
    return T.plan_batches(pairs, sizes, seed=O.SEED, epoch=O.EPOCH, world=world)


@register("batch_plan", O.with_(O.BATCH_PLAN) + "SELECT epoch, dataset_id, batch_no, rank, slot, row_id FROM plan")
def q_batch_plan(spark, sf_dir):
    p = batch_plan(spark, sf_dir)
    return p.select("epoch", "dataset_id", "batch_no", "rank", "slot", "row_id")


# ---- L: loss audit per training group ---------------------------------------------

from ..operators import losses as LS  # noqa: E402


def group_scores(spark, sf_dir, temperature: float = O.TEMP):
    """Own-group scores of every training row: hashed query and passage
    vectors, dot / T (F2 within a group, L1)."""
    g = train_groups(spark, sf_dir)
    texts = (g.select("row_id", F.posexplode(F.arrays_zip("passages", "teacher")).alias("j", "z"))
             .select("row_id", "j", F.col("z.passages").alias("text"), F.col("z.teacher").alias("teacher")))
    pv = EM.hash_encode(texts.select((F.col("row_id") * 100 + F.col("j") + 1).alias("tid"), "text"), "tid", "text")
    qv = EM.hash_encode(g.select((F.col("row_id") * 100).alias("tid"), F.col("query").alias("text")), "tid", "text")
    t = texts.withColumn("tid", F.col("row_id") * 100 + F.col("j") + 1).join(pv, "tid")
    q = qv.select((F.col("tid") / 100).cast("long").alias("row_id"), F.col("embedding").alias("q_vec"))
    from ..operators.search import similarity
    s = similarity(q, t.withColumnRenamed("embedding", "p_vec"), on=["row_id"], temperature=temperature)
    s = freeze(s.select("row_id", "j", "score", "teacher"), "scores")  # both frames and every loss read it
    scores = s.select(F.col("row_id").alias("batch"), F.lit(0).alias("q_rank"), F.lit(0).alias("q_slot"),
                      F.lit(0).alias("p_rank"), F.lit(0).alias("p_slot"), "j", "score")
    teacher = s.select(F.col("row_id").alias("batch"), F.lit(0).alias("rank"), F.lit(0).alias("slot"),
                       "j", F.col("teacher").alias("t"))
    return scores, teacher


@register("loss_audit", O.with_(O.LOSS_AUDIT) + "SELECT row_id, loss_group, kd_kl FROM audit")
def q_loss_audit(spark, sf_dir):
    scores, teacher = group_scores(spark, sf_dir)
    lg = LS.loss_group(scores).select("batch", F.col("loss").alias("loss_group"))
    kd = LS.kd_kl(scores, teacher).select("batch", F.col("loss").alias("kd_kl"))
    return lg.join(kd, "batch").select(F.col("batch").alias("row_id"), F.round("loss_group", 6).alias("loss_group"),
                                       F.round("kd_kl", 6).alias("kd_kl"))


# ---- J: pre-training text ---------------------------------------------------------

from ..operators import pretrain as PT  # noqa: E402


def indexed_lines(spark, sf_dir):
    return PT.with_index(V.lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("int"), "line"),
                         ["doc_id", "line_no"])


@register("lines_split", O.with_(O.LINES_SPLIT) + "SELECT doc_id, line_no, idx, split FROM split_")
def q_lines_split(spark, sf_dir):
    return PT.percent_split(indexed_lines(spark, sf_dir), 2.0).select("doc_id", "line_no", "idx", "split")


def packed(spark, sf_dir):
    ix = PT.with_token_ids(indexed_lines(spark, sf_dir), "line")
    return PT.pack(ix, O.PACK_L, 1000)


@register("pack_blocks", O.with_(O.PACKED) + """SELECT batch_no, block_no, CAST(len(ids) AS INTEGER) AS n_ids,
  md5(array_to_string(ids, ' ')) AS ids_md5 FROM blocks""")
def q_pack_blocks(spark, sf_dir):
    b = packed(spark, sf_dir)
    return b.select("batch_no", "block_no", F.size("ids").alias("n_ids"),
                    F.md5(F.array_join("ids", " ")).alias("ids_md5"))


@register("line_mode", O.with_(O.LINES) + f"""SELECT idx, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5
FROM (SELECT idx, list_slice(list_transform(list_filter(string_split_regex(line, '{O.WS_RE}'), lambda t: length(t) > 0),
        lambda t: CAST((CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 30000) + 10 AS INTEGER)), 1, 32) AS ids
      FROM lines_ix WHERE length({O.strip_sql('line')}) > 0)""")
def q_line_mode(spark, sf_dir):
    lm = PT.line_mode(indexed_lines(spark, sf_dir), 32)
    return lm.select("idx", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", " ")).alias("ids_md5"))


@register("mask_full", O.with_(O.PACKED) + f"""SELECT batch_no, block_no,
  CAST(count(*) FILTER (WHERE {O.u01_sql('11', 'batch_no', 'block_no', "'m'", 'pos')} < 0.2) AS BIGINT) AS n_masked,
  CAST(coalesce(sum(id) FILTER (WHERE {O.u01_sql('11', 'batch_no', 'block_no', "'m'", 'pos')} < 0.2), 0) AS BIGINT) AS label_sum
FROM (SELECT batch_no, block_no, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM blocks)
GROUP BY batch_no, block_no""")
def q_mask_full(spark, sf_dir):
    m = PT.mask_full(packed(spark, sf_dir), 0.2, 11)
    masked = F.filter("labels", lambda x: x != -100)
    return m.select("batch_no", "block_no", F.size(masked).cast("long").alias("n_masked"),
                    F.aggregate(masked, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


# ---- K2-K5: sweep reports -------------------------------------------------------------

from ..operators import reports as R  # noqa: E402

SELECTION = ["checkpoint-10", "checkpoint-20", "checkpoint-30", "checkpoint-40"]


@register("sweep_report", _SWEEP + """, sel(model) AS (VALUES ('checkpoint-10'), ('checkpoint-20'), ('checkpoint-30'), ('checkpoint-40')),
ov AS (""" + O.OVERALL_SELECT + """)
SELECT sel.model, ov.overall_ndcg, CASE WHEN ov.overall_ndcg IS NULL THEN 'missing' ELSE 'done' END AS status
FROM sel LEFT JOIN ov USING (model)""")
def q_sweep_report(spark, sf_dir):
    sel = spark.createDataFrame([(m,) for m in SELECTION], "model string")
    return R.sweep_report(sel, judge.overall(_sweep_perq(spark, sf_dir)))


_PIVOT_COLS = ", ".join(f"""max(CASE WHEN search_task = '{t}' THEN "NDCG@10" END) AS "{t}\"""" for t in O.TASKS_SQL)


@register("leaderboard", _SWEEP + ", " + O.SWEEP_TASK + f"""
SELECT model, {_PIVOT_COLS}, round(avg("NDCG@10"), 6) AS avg FROM sweep_task GROUP BY model""")
def q_leaderboard(spark, sf_dir):
    return R.leaderboard_pivot(judge.per_task(_sweep_perq(spark, sf_dir)), O.TASKS_SQL)


@register("rank_in_group", _SWEEP + ", " + O.SWEEP_TASK + """
SELECT model, search_task, "NDCG@10", CAST(dense_rank() OVER (PARTITION BY search_task ORDER BY "NDCG@10" DESC) AS INTEGER) AS place,
  CASE dense_rank() OVER (PARTITION BY search_task ORDER BY "NDCG@10" DESC) WHEN 1 THEN 'best' WHEN 2 THEN 'second' END AS mark
FROM sweep_task""")
def q_rank_in_group(spark, sf_dir):
    return R.rank_in_group(judge.per_task(_sweep_perq(spark, sf_dir)))


@register("kendall_tau", _SWEEP + ", " + O.SWEEP_TASK + ", " + O.SWEEP_TASK_LIGHT + """,
j AS (SELECT f.search_task, f.model, l."NDCG@10" AS va, f."NDCG@10" AS vb
      FROM sweep_light l JOIN sweep_task f USING (search_task, model))
SELECT x.search_task, round(sum(sign(x.va - y.va) * sign(x.vb - y.vb)) / count(*), 6) AS tau, CAST(count(*) AS BIGINT) AS pairs
FROM j x JOIN j y ON x.search_task = y.search_task AND x.model < y.model GROUP BY x.search_task""")
def q_kendall_tau(spark, sf_dir):
    pq = _sweep_perq(spark, sf_dir)
    full = judge.per_task(pq)
    light = (pq.where(F.col("judged") & (F.col("event") == "ev0")).groupBy("model", "task")
             .agg(F.round(F.avg("ndcg_z"), 6).alias("NDCG@10")).withColumnRenamed("task", "search_task"))
    return R.kendall_tau(light, full)


@register("wilcoxon", _SWEEP + """,
pr AS (SELECT a.ndcg_z AS a, b.ndcg_z AS b FROM perq a JOIN perq b ON a.qrow = b.qrow
       WHERE a.model = 'checkpoint-10' AND b.model = 'checkpoint-30' AND a.judged AND b.judged),
d AS (SELECT a - b AS d, abs(a - b) AS ad FROM pr WHERE a - b <> 0),
rk AS (SELECT d, ad, row_number() OVER (ORDER BY ad) - 1 AS pos FROM d),
ar AS (SELECT ad, (min(pos) + max(pos)) / 2 + 1 AS r FROM rk GROUP BY ad),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus FROM rk JOIN ar USING (ad)),
zz AS (SELECT n, w_plus, CASE WHEN n > 0 THEN (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) ELSE 0 END AS z FROM s),
t AS (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM zz),
e AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
               * exp(-(abs(z) / sqrt(2)) * (abs(z) / sqrt(2))) AS erfc FROM t)
SELECT CAST(n AS BIGINT) AS n, round(w_plus, 6) AS w_plus, round(z, 6) AS z,
       round(CASE WHEN z >= 0 THEN erfc / 2 ELSE 1 - erfc / 2 END, 6) AS p_value FROM e""")
def q_wilcoxon(spark, sf_dir):
    pq = _sweep_perq(spark, sf_dir).where(F.col("judged"))
    a = pq.where(F.col("model") == "checkpoint-10").select("qrow", F.col("ndcg_z").alias("a"))
    b = pq.where(F.col("model") == "checkpoint-30").select("qrow", F.col("ndcg_z").alias("b"))
    return R.wilcoxon_one_tailed(a.join(b, "qrow"), "a", "b")


@register("kendall_tau_b", """WITH d AS (SELECT doc_id, source, n_chars AS va, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 0)) AS vb
           FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT x.source, sign(x.va - y.va) AS a, sign(x.vb - y.vb) AS b
      FROM d x LEFT JOIN d y ON x.source IS NOT DISTINCT FROM y.source AND x.doc_id < y.doc_id),
n AS (SELECT source, count(*) AS n FROM d GROUP BY source)
SELECT p.source, any_value(n.n) AS n, CAST(count(*) FILTER (WHERE a * b < 0) AS BIGINT) AS discordant, CAST(count(*) FILTER (WHERE a = 0) AS BIGINT) AS ties_a,
       CAST(count(*) FILTER (WHERE b = 0) AS BIGINT) AS ties_b,
       round(sum(a * b) / nullif(sqrt(count(*) FILTER (WHERE a <> 0)) * sqrt(count(*) FILTER (WHERE b <> 0)), 0), 6) AS tau_b
FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source GROUP BY p.source""")
def q_kendall_tau_b(spark, sf_dir):
    """K5 over items in the thousands: agreement, per source, of the orders by characters and by words."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: F.length(w) > 0))
    d = table(spark, sf_dir, "documents").select("source", "n_chars", words.alias("words"))
    return R.kendall_tau_b(d, "source", "n_chars", "words")


@register("wilcoxon_exact", _SWEEP.replace("WITH ", "WITH RECURSIVE ", 1) + """,
pr AS (SELECT g, a.ndcg_z - b.ndcg_z AS d FROM perq a JOIN perq b ON a.qrow = b.qrow, (VALUES (0), (1)) x(k), LATERAL (SELECT CASE k WHEN 0 THEN 'all' ELSE a.task END AS g)
       WHERE a.model = 'checkpoint-10' AND b.model = 'checkpoint-30' AND a.judged AND b.judged),
rk AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY abs(d)) AS pos FROM pr WHERE d <> 0),
r2 AS (SELECT g, d, pos, min(pos) OVER w + max(pos) OVER w AS r2 FROM rk WINDOW w AS (PARTITION BY g, abs(d))),
s AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN r2 ELSE 0 END) / 2 AS w FROM r2 GROUP BY g),
-- number of sign patterns per sum, one rank after the other
dist AS (SELECT g, 0 AS k, 0::BIGINT AS t, 1.0::DOUBLE AS c FROM s WHERE n <= 12
         UNION ALL SELECT d.g, any_value(d.k) + 1, d.t + x.on_ * r.r2, sum(d.c) FROM dist d JOIN r2 r ON r.g = d.g AND r.pos = d.k + 1, (VALUES (0), (1)) x(on_) GROUP BY d.g, d.t + x.on_ * r.r2),
ex AS (SELECT s.g, sum(CASE WHEN dist.t >= 2 * s.w THEN dist.c ELSE 0 END) / sum(dist.c) AS p FROM s JOIN dist ON dist.g = s.g AND dist.k = s.n GROUP BY s.g),
vr AS (SELECT g, n, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - (SELECT coalesce(sum(t * t * t - t), 0) FROM (SELECT count(*) AS t FROM r2 WHERE r2.g = s.g GROUP BY abs(d))) / 48.0) AS z FROM s),
-- Simpson's rule over the density from 0 to z
ap AS (SELECT g, 0.5 - any_value(z) / 6000 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * i / 2000) * (z * i / 2000))) / sqrt(2 * pi()) AS p
       FROM vr, range(0, 2001) q(i) WHERE n > 12 GROUP BY g)
SELECT t.g AS task, CAST(coalesce(s.n, 0) AS BIGINT) AS n, round(coalesce(s.w, 0), 6) AS w_plus, round(coalesce(ex.p, ap.p, 1), 6) AS p_value
FROM (SELECT DISTINCT g FROM pr) t LEFT JOIN s ON s.g = t.g LEFT JOIN ex ON ex.g = t.g LEFT JOIN ap ON ap.g = t.g""")
def q_wilcoxon_exact(spark, sf_dir):
    """K6 per task and over all queries: exact up to 12 differences, else with the variance corrected for ties."""
    pq = _sweep_perq(spark, sf_dir).where(F.col("judged"))
    a = pq.where(F.col("model") == "checkpoint-10").select("qrow", "task", F.col("ndcg_z").alias("a"))
    b = pq.where(F.col("model") == "checkpoint-30").select("qrow", F.col("ndcg_z").alias("b"))
    j = a.join(b, "qrow").select(F.explode(F.array(F.lit("all"), "task")).alias("task"), "a", "b")
    return R.wilcoxon_exact(j, "task", exact_up_to=12)


# ---- S1: streaming clean over the documents table -------------------------------------

@register("stream_clean", O.with_("""lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""") + f"""SELECT doc_id, line_no, CAST(len(ids) AS INTEGER) AS n_ids,
  md5(array_to_string(ids, ' ')) AS ids_md5
FROM (SELECT doc_id, line_no, list_slice(list_transform(list_filter(string_split_regex(line, '{O.WS_RE}'), lambda t: length(t) > 0),
        lambda t: CAST((CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 30000) + 10 AS INTEGER)), 1, 32) AS ids
      FROM lines WHERE length({O.strip_sql('line')}) > 0)""")
def q_stream_clean(spark, sf_dir):
    from ..streaming.streams import clean_lines, read_table_stream, run_available
    out = clean_lines(read_table_stream(spark, sf_dir, "documents"), "text", 32, keys=("doc_id",))
    out = out.select("doc_id", F.col("line_no").cast("int"), F.size("ids").alias("n_ids"),
                     F.md5(F.array_join("ids", " ")).alias("ids_md5"))
    path = shared_path(spark, "stream-clean")
    run_available(out, "stream_clean", path)
    return spark.read.schema(out.schema).parquet(path)


from . import catalog_embed, catalog_files, catalog_suites, catalog_train  # noqa: E402, F401  (they register their queries)
