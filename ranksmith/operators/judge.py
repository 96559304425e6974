"""Relevance joins (G1-G8) and ranking metrics.

One parametrised plan serves every evaluation suite:

``run``   (model, task, event, qrow, qkey, rank, dkey) - one row per hit,
          ``rank`` = 1-based position in the retrieved list, ``qrow`` = row
          number of the query in its run (duplicate queries count twice).
``qrels`` (task, event, qkey, dkey, score DOUBLE) - one row per judgement
          (deduplicated with :func:`qrels_dedupe`).

Variants: zero-fill (unjudged hit = grade 0) and ignore (unjudged hits are
removed and ranks closed up). ``cut_before_filter`` says whether the list is
cut to k before unjudged hits are removed (main suites) or after (the STS
suite, which may then refill from below rank k). ``stats_uncut`` counts
retrieval pairs over the whole list instead of the first k.

Shuffles: one join of the hits with the judgements on
(task, event, qkey, dkey), one window + aggregate per query row (same
partitioning), one join with the per-query ideal DCG, then a tiny
aggregate per (model, task, event). Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze

QKEYS = ["task", "event", "qkey"]
RUN_Q = ["model", "task", "event", "qrow"]
METRIC_COLS = ["NDCG@10", "RR@10", "REC@10"]


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - F.lit(1.0)


def discount(rank: Column) -> Column:
    return F.log2(rank.cast("double") + F.lit(1.0))


def qrels_dedupe(qrels: DataFrame, order_cols=("file", "_pos", "_sub")) -> DataFrame:
    """A repeated (query, doc) judgement - the last row of the files wins."""
    order = F.struct(*[F.col(c) for c in order_cols])
    return (qrels.groupBy(*QKEYS, "dkey")
            .agg(F.max_by("score", order).alias("score")))


def ideal(qrels: DataFrame, k: int = 10) -> DataFrame:
    """H2 + recall denominator, per judged query: ideal DCG over the k best
    grades of all judged docs, and the number of docs with grade > 0.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, so even a query holding a large share of all judgements sends
    only k rows per map task; the count is a partial aggregate.
    """
    w = Window.partitionBy(*QKEYS).orderBy(F.col("score").desc())
    top = (qrels.select(*QKEYS, "score").withColumn("irank", F.row_number().over(w))
           .where(F.col("irank") <= k)
           .groupBy(*QKEYS)
           .agg(F.sum(gain(F.col("score")) / discount(F.col("irank"))).alias("idcg")))
    cnt = qrels.groupBy(*QKEYS).agg(F.count_if(F.col("score") > 0).alias("rel_total"))
    return top.join(cnt, on=QKEYS, how="inner")


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, *,
              cut_before_filter: bool = True, stats_uncut: bool = False,
              queries: DataFrame | None = None) -> DataFrame:
    """Metrics of every judged query row, both variants, plus pair counts.

    Output: model, task, event, qrow, qkey, judged (bool), file_judged (its
    (task, event) has judgements), n_pairs,
    n_unjudged, ndcg_z, rr_z, rec_z, ndcg_i, rr_i, rec_i.
    Queries without any judgement keep a row with ``judged = false`` (their
    pairs count in the retrieval stats, H14) and null metrics. ``queries``
    (model, task, event, qrow, qkey) lists the queries of the run; those
    without a hit have no row in ``run`` and are added with zero metrics.
    """
    # read by the join, both parts of the ideal and the list of files: made once
    qrels = freeze(qrels.select(*QKEYS, "dkey", "score"), "qrels")
    hits = run.select(*RUN_Q, "qkey", F.col("rank").cast("long").alias("rank"), "dkey")
    if cut_before_filter or not stats_uncut:
        # rows below k are never needed
        if cut_before_filter and not stats_uncut:
            hits = hits.where(F.col("rank") <= k)
    graded = hits.join(qrels.select(*QKEYS, "dkey", "score"), on=[*QKEYS, "dkey"], how="left")

    in_k = F.col("rank") <= k
    g = F.coalesce(F.col("score"), F.lit(0.0))
    judged_hit = F.col("score").isNotNull()
    elig_i = judged_hit & (in_k if cut_before_filter else F.lit(True))
    # Ranks closed up among the judged hits (window per query row)
    w = Window.partitionBy(*RUN_Q).orderBy(F.col("rank"))
    graded = graded.withColumn(
        "irank", F.when(elig_i, F.sum(F.when(elig_i, 1).otherwise(0)).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    in_i = elig_i & (F.col("irank") <= k)

    pair_ok = F.lit(True) if stats_uncut else in_k
    q = (graded.groupBy(*RUN_Q, "qkey")
         .agg(F.count_if(pair_ok).alias("n_pairs"),
              F.count_if(pair_ok & ~judged_hit).alias("n_unjudged"),
              F.sum(F.when(in_k, gain(g) / discount(F.col("rank"))).otherwise(0.0)).alias("dcg_z"),
              F.min(F.when(in_k & (g > 0), F.col("rank"))).alias("first_z"),
              F.count_if(in_k & (g > 0)).alias("hit_z"),
              F.sum(F.when(in_i, gain(g) / discount(F.col("irank"))).otherwise(0.0)).alias("dcg_i"),
              F.min(F.when(in_i & (g > 0), F.col("irank"))).alias("first_i"),
              F.count_if(in_i & (g > 0)).alias("hit_i")))

    if queries is not None:
        sums = [c for c in q.columns if c not in (*RUN_Q, "qkey")]
        q = (queries.select(*RUN_Q, "qkey").join(q, [*RUN_Q, "qkey"], "left")
             .fillna(0, subset=[c for c in sums if not c.startswith("first_")]))
    q = q.join(ideal(qrels, k), on=QKEYS, how="left")
    # one row per judged file
    q = q.join(qrels.select("task", "event").distinct().withColumn("_file", F.lit(True)), ["task", "event"], "left")
    judged = F.col("idcg").isNotNull()
    rr = lambda first: F.coalesce(F.lit(1.0) / first.cast("double"), F.lit(0.0))
    ndcg = lambda dcg: F.when(F.col("idcg") > 0, dcg / F.col("idcg")).otherwise(F.lit(0.0))
    rec = lambda hit: F.when(F.col("rel_total") > 0, hit / F.col("rel_total")).otherwise(F.lit(0.0))
    return q.select(
        *RUN_Q, "qkey", judged.alias("judged"), F.coalesce("_file", F.lit(False)).alias("file_judged"), "n_pairs", "n_unjudged",
        F.when(judged, ndcg(F.col("dcg_z"))).alias("ndcg_z"),
        F.when(judged, rr(F.col("first_z"))).alias("rr_z"),
        F.when(judged, rec(F.col("hit_z"))).alias("rec_z"),
        F.when(judged, ndcg(F.col("dcg_i"))).alias("ndcg_i"),
        F.when(judged, rr(F.col("first_i"))).alias("rr_i"),
        F.when(judged, rec(F.col("hit_i"))).alias("rec_i"))


def _r(c: Column) -> Column:
    return F.round(c, 6)


def per_event(pq: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row per (model, task, event, variant) with judged queries.

    ``expected`` (model, task, event) adds all-zero rows for groups that must
    be reported even without judged queries (single-file suites).
    """
    # both variants from one aggregate, then two rows of it
    means = (pq.where(F.col("judged")).groupBy("model", "task", "event")
             .agg(F.count(F.lit(1)).alias("num_queries"),
                  *[F.avg(f"{m}_{v}").alias(f"{m}_{v}") for v in ("z", "i") for m in ("ndcg", "rr", "rec")]))
    two = F.array(*[F.struct(F.lit(name).alias("variant"), F.col(f"ndcg_{v}").alias("n"), F.col(f"rr_{v}").alias("r"),
                             F.col(f"rec_{v}").alias("c")) for name, v in (("zero", "z"), ("ignore", "i"))])
    out = (means.select("model", "task", "event", "num_queries", F.explode(two).alias("x"))
           .select("model", "task", "event", "x.variant", "num_queries", "x.n", "x.r", "x.c"))
    if expected is not None:
        filler = (expected.crossJoin(F.broadcast(
            out.sparkSession.createDataFrame([("zero",), ("ignore",)], "variant string")))
            .join(out.select("model", "task", "event", "variant"),
                  on=["model", "task", "event", "variant"], how="left_anti")
            .select("model", "task", "event", "variant",
                    F.lit(0).cast("long").alias("num_queries"),
                    F.lit(0.0).alias("n"), F.lit(0.0).alias("r"), F.lit(0.0).alias("c")))
        out = out.unionByName(filler)
    return out.select(
        "model", F.col("task").alias("search_task"), F.col("event").alias("event_type"),
        "variant", F.col("num_queries").cast("long").alias("num_queries"),
        _r(F.col("n")).alias("NDCG@10"), _r(F.col("r")).alias("RR@10"),
        _r(F.col("c")).alias("REC@10"))


def _unrounded_zero(pq: DataFrame) -> DataFrame:
    return (pq.where(F.col("judged")).groupBy("model", "task", "event")
            .agg(F.avg("ndcg_z").alias("ndcg")))


def per_task(pq: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Plain mean over events of the zero-fill NDCG@10 (means of means)."""
    ev = _unrounded_zero(pq)
    t = ev.groupBy("model", "task").agg(F.avg("ndcg").alias("ndcg"))
    if expected is not None:
        t = t.unionByName(expected.join(t.select("model", "task"), ["model", "task"], "left_anti")
                          .select("model", "task", F.lit(0.0).alias("ndcg")))
    return t.select("model", F.col("task").alias("search_task"), _r(F.col("ndcg")).alias("NDCG@10"))


def overall(pq: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Plain mean over tasks of H12; 0 when a model has none."""
    ev = _unrounded_zero(pq)
    t = ev.groupBy("model", "task").agg(F.avg("ndcg").alias("ndcg"))
    o = t.groupBy("model").agg(F.avg("ndcg").alias("overall"))
    if models is not None:
        o = models.select("model").join(o, "model", "left").fillna(0.0, subset=["overall"])
    return o.select("model", _r(F.col("overall")).alias("overall_ndcg"),
                    F.format_string("Overall mean NDCG@10: %.4f", F.col("overall")).alias("overall_text"))


def retrieval_stats(pq: DataFrame) -> DataFrame:
    """Pairs of all queries of the (task, event) files that have judgements
    (a file without any is skipped before it is counted); unjudged pairs of
    judged queries only."""
    s = pq.where(F.col("file_judged")).groupBy("model").agg(
        F.sum("n_pairs").alias("total_retrieved_pairs"),
        F.sum(F.when(F.col("judged"), F.col("n_unjudged")).otherwise(0)).alias("unannotated_pairs"))
    return s.select(
        "model", F.col("total_retrieved_pairs").cast("long"),
        F.col("unannotated_pairs").cast("long"),
        _r(F.when(F.col("total_retrieved_pairs") > 0,
                  F.col("unannotated_pairs") / F.col("total_retrieved_pairs")).otherwise(0.0))
        .alias("unannotated_ratio"))


# ---- join helpers named in the inventory (G6, G7) ------------------------------

def text_key(df: DataFrame, query: str = "query", passage: str = "passage") -> DataFrame:
    """Keys of a text-keyed run or judgement: ``qkey``, ``dkey`` are the
    texts' md5, a short join key; the texts stay for the equality check."""
    return df.withColumn("qkey", F.md5(F.col(query))).withColumn("dkey", F.md5(F.col(passage)))


def text_key_join(run: DataFrame, qrels: DataFrame, query: str = "query", passage: str = "passage") -> DataFrame:
    """Hits with the ``grade`` of the judgement on the same texts (null if none):
    joined by md5 of both texts, then compared as texts."""
    r = text_key(run, query, passage)
    q = text_key(qrels, query, passage).select(*QKEYS, "dkey", F.col("score").alias("_grade"), F.col(query).alias("_q"), F.col(passage).alias("_p"))
    j = r.join(q, [*QKEYS, "dkey"], "left")
    same = (F.col("_q") == F.col(query)) & (F.col("_p") == F.col(passage))
    return j.withColumn("grade", F.when(same, F.col("_grade"))).drop("_q", "_p", "_grade")


def skip_done(candidates: DataFrame, done: DataFrame, key: str = "model") -> DataFrame:
    """Drop runs (checkpoints) that already have results."""
    return candidates.join(done.select(key).distinct(), on=key, how="left_anti")


# ---- suite presets (H8-H11) and task selection (C13) ----------------------------

SUITES = {
    # suite: (cut_before_filter, stats_uncut, fixed (task, event) or None)
    "eva": (True, False, None),
    "trec": (True, False, ("QA", "trec_covid")),
    "climate": (True, False, ("QA", "climate_fever")),
    "biosses": (False, True, ("STS", "biosses")),
}


def evaluate_suite(run: DataFrame, qrels: DataFrame, suite: str, k: int = 10) -> dict:
    """Whole evaluation of one suite: per-query, per-event, per-task,
    overall and stats frames. Single-file suites always report their
    (task, event) row (H9, H10) or their task (H11) per model."""
    cut, uncut, fixed = SUITES[suite]
    if suite in ("trec", "climate"):
        # ids are the keys; a blank query id is skipped before it is counted
        run = run.where(F.length(F.coalesce(F.col("qkey").cast("string"), F.lit(""))) > 0)
    pq = per_query(run, qrels, k, cut_before_filter=cut, stats_uncut=uncut)
    models = run.select("model").distinct()
    exp_ev = exp_task = None
    if fixed is not None:
        fx = models.select("model", F.lit(fixed[0]).alias("task"), F.lit(fixed[1]).alias("event"))
        exp_ev = fx if suite in ("trec", "climate") else None
        exp_task = fx.select("model", "task")
    return {"per_query": pq, "per_event": per_event(pq, exp_ev), "per_task": per_task(pq, exp_task),
            "overall": overall(pq, models), "stats": retrieval_stats(pq)}


def select_tasks(df: DataFrame, tasks: list[str] | None, col: str = "task") -> DataFrame:
    """Keep the requested tasks; an unknown task name is an error.
    The check reads only the distinct task names (a tiny aggregate)."""
    if not tasks:
        return df
    known = {r[0] for r in df.select(col).distinct().collect()}
    unknown = sorted(set(tasks) - known)
    if unknown:
        raise ValueError(f"unknown tasks: {unknown}; available: {sorted(known)}")
    return df.where(F.col(col).isin(list(tasks)))
