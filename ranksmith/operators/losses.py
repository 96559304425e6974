"""Contrastive and distillation losses as audit tables.

Input is a long score table of one step: every query of a batch against
every passage of the same batch (``similarity`` joins on the batch key, so
pairs never cross batches):

``scores`` (batch, q_rank, q_slot, p_rank, p_slot, j, score)
    score already divided by the temperature; (p_rank, p_slot, j) is the
    passage (j = 0 the positive of query (p_rank, p_slot)).
``teacher`` (batch, rank, slot, j, t) - optional teacher scores.

A query's scores become three arrays in one aggregate (its own passages in
order of j, the other passages of its rank, those of the other ranks); a batch
bounds their size. All losses are array expressions over that one row, with
every log-sum-exp shifted by its largest element, so nothing is joined back
and nothing is collected.

``batch_arrays`` makes the same one row per query straight from the vectors:
the queries and passages of a batch meet in one cogrouped Arrow task, are
multiplied in blocks, and the passages that are not a query's own enter as
their log-sum-exp, so no row per pair exists. Every loss takes such a frame
in place of ``scores``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import bind, log_sum_exp

Q = ["batch", "q_rank", "q_slot"]
SCOPES = ("group", "in_batch", "cross_device")


def own(scores: DataFrame) -> DataFrame:
    """L1: each query's scores against its own g passages."""
    return scores.where((F.col("p_rank") == F.col("q_rank")) & (F.col("p_slot") == F.col("q_slot")))


def _matrix(t: pa.Table, col: str) -> np.ndarray:
    """The vectors of a column as a matrix; vectors of different lengths raise."""
    a = t.column(col).combine_chunks()
    size = set(np.unique(a.value_lengths().to_numpy(zero_copy_only=False)).tolist())
    if len(size) > 1:
        raise ValueError(f"vectors of different lengths in a batch: {sorted(size)}")
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, max(size, default=0))


def _add_lse(top: np.ndarray, total: np.ndarray, s: np.ndarray, mask: np.ndarray) -> None:
    """Add the masked scores of a block to running log-sum-exps (largest score, sum of exp(score - largest)), in place."""
    s = np.where(mask, s, -np.inf)
    new = np.maximum(top, s.max(axis=1, initial=-np.inf))
    shift = np.where(np.isfinite(new), new, 0.0)
    total *= np.exp(np.where(np.isfinite(top), top - shift, 0.0))
    total += np.exp(s - shift[:, None]).sum(axis=1)
    top[:] = new


def batch_arrays(queries: DataFrame, passages: DataFrame, temperature: float = 1.0, block: int = 1024) -> DataFrame:
    """One row per query from the vectors of whole batches (F2 inside L1-L8).

    ``queries`` (batch, q_rank, q_slot, q_vec), ``passages`` (batch, p_rank, p_slot, j, p_vec). A task holds the
    vectors of one batch, which the trainer's step bounds (ranks x slots x passages), and ``block`` x ``block`` scores.
    Output: own ARRAY<DOUBLE> by j, and rank_rest, step_rest with the log-sum-exp of the others as only element (empty:
    there are none). Rows with a null vector take no part; a query without own passages has no row."""
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = (f"batch {kinds['batch']}, q_rank {kinds['q_rank']}, q_slot {kinds['q_slot']}, "
              "own array<double>, rank_rest array<double>, step_rest array<double>")

    def ints(t, *cols):
        return [t.column(c).to_numpy().astype(np.int64) for c in cols]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, (q_rank, q_slot) = _matrix(left, "q_vec"), ints(left, "q_rank", "q_slot")
        p, (p_rank, p_slot, j) = _matrix(right, "p_vec"), ints(right, "p_rank", "p_slot", "j")
        n = len(q)
        tops, totals, owns = np.full((2, n), -np.inf), np.zeros((2, n)), []
        if n and len(p):
            if q.shape[1] != p.shape[1]:
                raise ValueError(f"vectors of different lengths in a batch: {q.shape[1]}, {p.shape[1]}")
            for a in range(0, n, block):
                for b in range(0, len(p), block):
                    s = q[a:a + block] @ p[b:b + block].T / temperature
                    same = q_rank[a:a + block, None] == p_rank[None, b:b + block]
                    own = same & (q_slot[a:a + block, None] == p_slot[None, b:b + block])
                    for k, mask in enumerate((same & ~own, ~same)):
                        _add_lse(tops[k, a:a + block], totals[k, a:a + block], s, mask)
                    r, c = np.nonzero(own)
                    owns.append((r + a, j[c + b], s[r, c]))
        row, pos, score = (np.concatenate(x) for x in zip(*owns)) if owns else (np.empty(0, np.int64),) * 3
        order = np.lexsort((score, pos, row))
        count = np.bincount(row, minlength=n)
        keep = count > 0

        def lists(values, sizes):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.float64()))

        cols = [left.column(c).filter(pa.array(keep)) for c in Q] + [lists(score[order].astype(float), count[keep])]
        for k in range(2):
            some = np.isfinite(tops[k]) & keep
            cols.append(lists(tops[k][some] + np.log(totals[k][some]), some[keep].astype(int)))
        return pa.table(cols, names=[*Q, "own", "rank_rest", "step_rest"])

    left = queries.where(F.col("q_vec").isNotNull()).select(*Q, "q_vec")
    right = passages.where(F.col("p_vec").isNotNull()).select(
        F.col("batch").alias("p_batch"), "p_rank", "p_slot", "j", "p_vec")  # a name of its own: both sides may come from one frame
    return left.groupBy("batch").cogroup(right.groupBy("p_batch")).applyInArrow(run, schema)


def query_arrays(scores: DataFrame) -> DataFrame:
    """One row per query: own scores by j, other scores of the rank, scores of other ranks.
    A frame that has such rows already (``batch_arrays``) is returned as it is."""
    if "own" in scores.columns:
        return scores
    is_rank = F.col("p_rank") == F.col("q_rank")
    is_own = is_rank & (F.col("p_slot") == F.col("q_slot"))
    a = scores.groupBy(*Q).agg(
        F.array_sort(F.collect_list(F.when(is_own, F.struct("j", "score")))).alias("own"),
        F.collect_list(F.when(is_rank & ~is_own, F.col("score"))).alias("rank_rest"),
        F.collect_list(F.when(~is_rank, F.col("score"))).alias("step_rest"))
    return a.where(F.size("own") > 0).withColumn("own", F.transform("own", lambda x: x["score"]))


def _rest(scope: str) -> Column:
    """The passages of the scope that are not the query's own."""
    if scope == "group":
        return F.array().cast("array<double>")
    return F.col("rank_rest") if scope == "in_batch" else F.concat("rank_rest", "step_rest")


def _ce(scope: str) -> Column:
    """Cross-entropy of the own positive within the scope."""
    return log_sum_exp(F.concat("own", _rest(scope))) - F.col("own")[0]


def loss_group(scores: DataFrame) -> DataFrame:
    """L2: logsumexp over own passages - own positive, per query."""
    return query_arrays(scores).select(*Q, _ce("group").alias("loss"))


def loss_in_batch(scores: DataFrame) -> DataFrame:
    """L3: over all passages of the query's rank in the batch."""
    return query_arrays(scores).select(*Q, _ce("in_batch").alias("loss"))


def loss_cross_device(scores: DataFrame) -> DataFrame:
    """L4: over all passages of the batch (all ranks of the step)."""
    return query_arrays(scores).select(*Q, _ce("cross_device").alias("loss"))


def softmax(a: Column) -> Column:
    """Softmax of an array, shifted by its largest element."""
    return bind(log_sum_exp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def teacher_softmax(teacher: DataFrame) -> DataFrame:
    """Softmax of teacher scores per query, no temperature."""
    w = Window.partitionBy("batch", "rank", "slot")
    m = F.max("t").over(w)
    e = F.exp(F.col("t") - m)
    return teacher.withColumn("tp", e / F.sum(e).over(w))


def _with_teacher(arrays: DataFrame, teacher: DataFrame) -> DataFrame:
    t = (teacher.groupBy(F.col("batch"), F.col("rank").alias("q_rank"), F.col("slot").alias("q_slot"))
         .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "t"))), lambda x: x["t"]).alias("t")))
    return arrays.join(t, Q).withColumn("tp", softmax(F.col("t"))).drop("t")


def _kl() -> Column:
    """-sum_j teacher_j * log_softmax(own)_j."""
    return bind(log_sum_exp(F.col("own")), lambda z: F.aggregate(
        F.zip_with("tp", "own", lambda p, s: p * (z - s)), F.lit(0.0), lambda acc, x: acc + x))


def kd_kl(scores: DataFrame, teacher: DataFrame) -> DataFrame:
    """-sum_j teacher_j * log_softmax(own)_j per query."""
    return _with_teacher(query_arrays(scores), teacher).select(*Q, _kl().alias("loss"))


def _progressive(scope: str) -> Column:
    """For each own position i: teacher_i times the cross-entropy of own_i
    against the scope without own_0 .. own_(i-1); summed.

    The remaining scores are the own suffix and the scope's other passages; the
    latter enter as one number, their log-sum-exp, and each suffix has a
    log-sum-exp of its own, so large removed scores leave no rounding behind.
    """
    def suffix(rest: Column | None, s: Column, i: Column) -> Column:
        tail = F.slice("own", i + 1, F.size("own") - i)
        return log_sum_exp(F.concat(tail, rest)) - s

    def total(rest: Column) -> Column:
        terms = F.transform("own", lambda s, i: F.element_at("tp", i + 1) * suffix(rest, s, i))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    others = _rest(scope)
    one = F.when(F.size(others) > 0, F.array(log_sum_exp(others))).otherwise(F.array().cast("array<double>"))
    return bind(one, total)


def kd_progressive(scores: DataFrame, teacher: DataFrame, scope: str = "in_batch") -> DataFrame:
    """Progressive distillation, summed over the own positions, per query.

    scope: 'group' (own passages), 'in_batch' (same rank), 'cross_device'.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    return _with_teacher(query_arrays(scores), teacher).select(*Q, _progressive(scope).alias("loss"))


def batch_mean(per_query: DataFrame, name: str) -> DataFrame:
    return per_query.groupBy("batch", "q_rank").agg(F.avg("loss").alias(name))


def combined(scores: DataFrame, teacher: DataFrame | None, *, flags: DataFrame | None = None, no_in_batch: bool = False,
             cross_device: bool = False, kd: str | None = None, kd_weight: float = 1.0) -> DataFrame:
    """The loss the trainer would use for a batch, per (batch, q_rank).

    base: no in-batch negatives -> L2; else cross-device -> L4; else L3.
    kd = 'kl': base CE + weight * L6 (group-local teacher); kd = 'm3':
    weight * L7 alone, scoped like the base (own group without in-batch
    negatives). ``flags`` (batch, no_in_batch) switches single batches;
    ``no_in_batch`` all of them. With cross-device negatives the mean is over
    the queries of all ranks of the step, so every rank reports the same loss.
    """
    a = query_arrays(scores)
    a = a.join(flags.select("batch", "no_in_batch"), "batch", "left") if flags is not None else a.withColumn("no_in_batch", F.lit(False))
    off = F.coalesce("no_in_batch", F.lit(False)) | F.lit(no_in_batch)
    wide = "cross_device" if cross_device else "in_batch"
    base = F.when(off, _ce("group")).otherwise(_ce(wide))
    if kd is not None and teacher is not None:
        a = _with_teacher(a, teacher)
        if kd == "kl":
            base = base + kd_weight * _kl()
        else:
            base = kd_weight * F.when(off, _progressive("group")).otherwise(_progressive(wide))
    per = a.select(*Q, off.alias("off"), base.alias("loss"))
    out = per.groupBy("batch", "q_rank", "off").agg(F.avg("loss").alias("own_mean"), F.sum("loss").alias("s"), F.count(F.lit(1)).alias("n"))
    if not cross_device:
        return out.select("batch", "q_rank", F.col("own_mean").alias("loss"))
    w = Window.partitionBy("batch")  # one row per rank of a step
    step = F.sum("s").over(w) / F.sum("n").over(w)
    return out.select("batch", "q_rank", F.when(F.col("off"), F.col("own_mean")).otherwise(step).alias("loss"))
