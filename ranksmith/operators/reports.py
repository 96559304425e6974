"""Checkpoint sweeps and leaderboard reports (K1-K6).

K1: the metric plan groups by ``model``, so a run table holding many checkpoints
is evaluated in one job; ``run_sweep`` keeps the results in a store with a folder per
checkpoint and evaluates only those that have none (G6).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import freeze
from .corpus import ordered_index
from .judge import skip_done


def finished(spark: SparkSession, store: str) -> DataFrame:
    """(model) of the checkpoints with results in the store; from its folders, no data are read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    rows = [(n[len("model="):],) for n in names if n.startswith("model=")]  # one per checkpoint
    return spark.createDataFrame(rows, "folder string").select(F.url_decode("folder").alias("model"))


def run_sweep(queries: DataFrame, evaluate: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """K1: results of all checkpoints of ``queries`` (column model). Those finished are
    skipped before ``evaluate`` (queries of the others -> rows with a column model) searches;
    a checkpoint's folder appears when its rows are complete, so that a lost run is repeated."""
    spark = queries.sparkSession
    todo = skip_done(queries, finished(spark, store))
    if not todo.isEmpty():
        (evaluate(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("model").parquet(store))
    wanted = queries.select("model").distinct()
    return spark.read.option("inferSchema", False).parquet(store).withColumn("model", F.col("model").cast("string")).join(wanted, "model", "left_semi")


def sweep_report(selection: DataFrame, overall: DataFrame) -> DataFrame:
    """K2: overall NDCG per selected checkpoint; missing results flagged."""
    return (selection.select("model").join(overall.select("model", "overall_ndcg"), "model", "left")
            .select("model", "overall_ndcg",
                    F.when(F.col("overall_ndcg").isNull(), "missing").otherwise("done").alias("status")))


def leaderboard_pivot(per_task: DataFrame, tasks: list[str]) -> DataFrame:
    """K3: one row per model, one column per task, plus the plain mean of
    the task columns present. Pivot values are given, so no extra job."""
    p = per_task.groupBy("model").pivot("search_task", tasks).agg(F.first("NDCG@10"))
    present = [F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in tasks]
    total = [F.coalesce(F.col(t), F.lit(0.0)) for t in tasks]
    n = sum(present[1:], present[0])
    s = sum(total[1:], total[0])
    return p.withColumn("avg", F.round(F.when(n > 0, s / n), 6))


def rank_in_group(per_task: DataFrame, group_col: str | None = None) -> DataFrame:
    """K4: dense rank of models per (group, task), best = 1."""
    keys = ([group_col] if group_col else []) + ["search_task"]
    w = Window.partitionBy(*keys).orderBy(F.col("NDCG@10").desc())
    r = per_task.withColumn("place", F.dense_rank().over(w))
    return r.withColumn("mark", F.when(F.col("place") == 1, "best").when(F.col("place") == 2, "second"))


def kendall_tau(a: DataFrame, b: DataFrame, key: str = "search_task", item: str = "model",
                value: str = "NDCG@10") -> DataFrame:
    """K5: Kendall tau-a between two evaluations of the same items, per key:
    (concordant - discordant) / pairs over item pairs (self-join of the
    items of one key; the item count per key is the number of models)."""
    j = a.select(key, item, F.col(value).alias("va")).join(b.select(key, item, F.col(value).alias("vb")), [key, item])
    x = j.alias("x").join(j.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col(f"x.{item}") < F.col(f"y.{item}")))
    sign = F.signum(F.col("x.va") - F.col("y.va")) * F.signum(F.col("x.vb") - F.col("y.vb"))
    return (x.groupBy(F.col(f"x.{key}").alias(key))
            .agg(F.round(F.sum(sign) / F.count(F.lit(1)), 6).alias("tau"), F.count(F.lit(1)).cast("long").alias("pairs")))


def _norm_sf(z):
    """Upper tail of the standard normal, 1 - Phi(z), via erfc with the
    Abramowitz-Stegun 7.1.26 polynomial (|error| < 1.5e-7)."""
    x = F.abs(z) / F.lit(2 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741)
                + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erfc = poly * F.exp(-x * x)
    return F.when(z >= 0, erfc / 2).otherwise(F.lit(1.0) - erfc / 2)


def _norm_sf_series(z: Column) -> Column:
    """1 - Phi(z) by the series erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum_n 2^n x^(2n+1) / (1 * 3 * .. * (2n+1)), whose
    terms are all positive (absolute error near 1e-15); beyond |z| = 9 the tail is 0 or 1."""
    x = F.least(F.abs(z), F.lit(9.0)) / F.lit(2 ** 0.5)
    start = F.struct(x.alias("term"), x.alias("total"))
    grow = lambda acc, n: F.struct((acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
                                   (acc["total"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, grow, lambda acc: acc["total"])
    erf = F.lit(2 / np.pi ** 0.5) * F.exp(-x * x) * total
    return F.when(z >= 0, (F.lit(1.0) - erf) / 2).otherwise((F.lit(1.0) + erf) / 2)


def wilcoxon_one_tailed(paired: DataFrame, a: str = "a", b: str = "b", key: str = "qrow") -> DataFrame:
    """K6: Wilcoxon signed-rank test that ``a`` > ``b`` on paired rows.

    Zero differences are dropped; |d| is ranked with average ranks for ties.
    ``key`` is a unique row key (the tie-break of the sort).
    Ranks come from the ordered index (a range-partitioned sort), not a
    global window. Normal approximation without tie correction.
    """
    d = paired.select(F.col(key).alias("_k"), (F.col(a) - F.col(b)).alias("d")).where(F.col("d") != 0) \
        .withColumn("ad", F.abs("d"))
    ix = ordered_index(d, ["ad", "_k"], idx="pos")
    # Rows with equal |d| share a rank, so counts per |d| are enough: one partial aggregate, also for a third of all rows on one key
    tie = ix.groupBy("ad").agg(((F.min("pos") + F.max("pos")) / 2 + 1).alias("r"), F.count(F.lit(1)).alias("k"),
                               F.count_if(F.col("d") > 0).alias("up"))
    s = tie.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("r") * F.col("up")), F.lit(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    z = F.when(sd > 0, (F.col("w_plus") - mean) / sd).otherwise(F.lit(0.0))
    return s.select("n", F.round("w_plus", 6).alias("w_plus"), F.round(z, 6).alias("z"),
                    F.round(_norm_sf(z), 6).alias("p_value"))


def _local_inversions(a: np.ndarray) -> int:
    """Pairs i < j with a[i] > a[j], by merge sort: what each half holds, and what the sorted halves hold between them."""
    n, width, total = len(a), 1, 0
    a = a.copy()
    while width < n:
        for at in range(0, n - width, 2 * width):
            left, right = a[at:at + width], a[at + width:at + 2 * width]
            total += len(left) * len(right) - int(np.searchsorted(left, right, side="right").sum())
            a[at:at + 2 * width] = np.sort(a[at:at + 2 * width], kind="stable")
        width *= 2
    return total


def inversions(ranked: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """(key, inversions): pairs of rows of a key with pos smaller and rank larger.

    ``ranked`` (key, pos, rank): two dense numberings from 0 of the rows of each key. The square of
    positions and ranks is cut into blocks and bands of ``block`` rows. Pairs inside a block, and pairs of a
    band from different blocks, are counted by merge sort in tasks of at most ``block`` rows; pairs that
    differ in both by running sums over the (block, band) counts. A key may hold any number of rows."""
    def count(of: str, other: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            total = _local_inversions(pdf["rank"].to_numpy())
            if of == "band":  # pairs of one block belong to that block
                total -= sum(_local_inversions(g["rank"].to_numpy()) for _, g in pdf.groupby(other))
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "n": [total]})
        return run

    d = ranked.select(F.col(key).alias("key"), "pos", "rank", F.floor(F.col("pos") / block).alias("block"), F.floor(F.col("rank") / block).alias("band"))
    schema = f"key {ranked.schema[key].dataType.simpleString()}, n long"
    near = (d.groupBy("key", "block").applyInPandas(count("block", "band"), schema)
            .unionByName(d.groupBy("key", "band").applyInPandas(count("band", "block"), schema)))
    cells = d.groupBy("key", "block", "band").agg(F.count(F.lit(1)).alias("c"))
    # every cell of the square, also empty ones, so that the running sums below meet each (block, band)
    grid = (cells.groupBy("key").agg(F.max("block").alias("last"))
            .select("key", "last", F.explode(F.expr("sequence(0L, last)")).alias("block"))
            .select("key", "block", F.explode(F.expr("sequence(0L, last)")).alias("band")))
    grid = (cells.unionByName(grid.withColumn("c", F.lit(0).cast("long")))
            .groupBy("key", "block", "band").agg(F.sum("c").alias("c")))
    before = Window.partitionBy("key", "band").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("key", "block").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("earlier", F.coalesce(F.sum("c").over(before), F.lit(0)))
    far = grid.withColumn("both", F.coalesce(F.sum("earlier").over(above), F.lit(0))).select("key", (F.col("c") * F.col("both")).alias("n"))
    return near.unionByName(far).groupBy("key").agg(F.sum("n").cast("long").alias("inversions")).withColumnRenamed("key", key)


def _numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add a dense 0-based number per key, in the given order, without a window over a key's rows."""
    at, first = "_at", "_first"
    ix = ordered_index(df, [key, *order], idx=at)
    starts = ix.groupBy(F.col(key).alias("_k")).agg(F.min(at).alias(first))
    return ix.join(starts, F.col(key).eqNullSafe(F.col("_k"))).withColumn(name, F.col(at) - F.col(first)).drop("_k", at, first)


def kendall_tau_b(paired: DataFrame, key: str, va: str, vb: str, block: int = 4096) -> DataFrame:
    """K5 with ties: Kendall tau-b of two numbers ``va``, ``vb`` per key, by inversion counting.

    (concordant - discordant) / sqrt((pairs - pairs tied in va) * (pairs - pairs tied in vb)), from one
    range sort by each number and the counts of equal values; no pair of rows is ever made, so a key may hold
    millions of items. Rows with a null or NaN value take no part. Output (key, n, discordant, ties_a, ties_b, tau_b);
    tau_b is null where all values of one side are equal."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # read by the sorts and by every tie count: made once
    d = freeze(paired.where(ok(va) & ok(vb)).select(F.col(key), F.col(va).alias("va"), F.col(vb).alias("vb")), "paired")
    # equal va stand in the order of vb, equal vb in the order of pos: a tie is no inversion
    ranked = _numbered(_numbered(d, key, ["va", "vb"], "pos"), key, ["vb", "pos"], "rank")
    pairs = F.col("c") * (F.col("c") - 1) / 2

    def tied(cols: list[str], name: str) -> DataFrame:
        return d.groupBy(key, *cols).agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(F.col(key).alias("_k")).agg(F.sum(pairs).alias(name))

    out = inversions(ranked.select(key, "pos", "rank"), key, block)
    for cols, name in (([], "pairs"), (["va"], "ties_a"), (["vb"], "ties_b"), (["va", "vb"], "ties_ab")):
        out = out.join(tied(cols, name), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    n = d.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    out = out.join(n, F.col(key).eqNullSafe(F.col("_k")))
    up = F.col("pairs") - F.col("ties_a") - F.col("ties_b") + F.col("ties_ab") - 2 * F.col("inversions")
    below = F.sqrt(F.col("pairs") - F.col("ties_a")) * F.sqrt(F.col("pairs") - F.col("ties_b"))
    return out.select(key, "n", F.col("inversions").alias("discordant"), F.col("ties_a").cast("long"), F.col("ties_b").cast("long"),
                      F.when(below > 0, F.round(up / below, 6)).alias("tau_b"))


def wilcoxon_exact(paired: DataFrame, group: str, a: str = "a", b: str = "b", exact_up_to: int = 50) -> DataFrame:
    """K6 per group, that ``a`` > ``b``: (group, n, w_plus, p_value), by the usual two ways of the signed-rank test.

    Groups of at most ``exact_up_to`` non-zero differences get the exact null distribution: doubled ranks are whole
    numbers also for ties, and one pass over them (dynamic programming) counts the sign patterns of each sum. Larger
    groups get the normal approximation with the variance corrected for ties. Ranks come from counts per |difference|,
    so a group's size is not limited; zero, null and NaN differences take no part, and a group without others has n = 0
    and p = 1."""
    d = paired.select(F.col(group).alias("g"), (F.col(a) - F.col(b)).cast("double").alias("d")).withColumn("ad", F.abs("d"))
    at = _numbered(d.where((F.col("d") != 0) & ~F.isnan("d")), "g", ["ad"], "pos")
    # the rank of a tie is the number below it + (t + 1) / 2
    tie = at.groupBy("g", "ad").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"), F.min("pos").alias("below")) \
        .withColumn("r2", 2 * F.col("below") + F.col("t") + 1)
    s = tie.groupBy("g").agg(
        F.sum("t").alias("n"), (F.sum(F.col("r2") * F.col("up")) / 2).alias("w_plus"), F.sum(F.col("r2") * F.col("r2") * F.col("t")).alias("sq"))
    s = d.select("g").distinct().withColumnRenamed("g", "gg").join(s, F.col("gg").eqNullSafe(F.col("g")), "left").select(
        F.col("gg").alias("g"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("sq", F.lit(0)).alias("sq"))
    few = s.where((F.col("n") <= exact_up_to) & (F.col("n") > 0)).select(F.col("g").alias("fg"))
    # at most exact_up_to ranks a group are gathered
    ranks = (tie.join(few, F.col("g").eqNullSafe(F.col("fg")), "left_semi").select("g", F.explode(F.array_repeat("r2", F.col("t").cast("int"))).alias("r2"))
             .groupBy(F.col("g").alias("rg")).agg(F.collect_list("r2").alias("r2s")))
    out = s.join(ranks, F.col("g").eqNullSafe(F.col("rg")), "left")
    none = F.array_repeat(F.lit(0.0), F.aggregate("r2s", F.lit(0).cast("long"), lambda x, r: x + r).cast("int"))
    # share of the sign patterns with each sum: a rank is added (shifted) or not
    step = lambda acc, r: F.transform(acc, lambda x, i: (x + F.when(i >= r, F.get(acc, (i - r).cast("int"))).otherwise(F.lit(0.0))) / 2)
    dist = F.aggregate("r2s", F.concat(F.array(F.lit(1.0)), none), step)
    at = (2 * F.col("w_plus")).cast("int")
    exact = F.aggregate(F.slice(dist, at + 1, F.size("r2s") * (F.size("r2s") + 1) + 1), F.lit(0.0), lambda x, y: x + y)
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.col("sq") / 16)  # sum of squared ranks / 4 = variance, ties and all
    p = F.when(F.col("n") == 0, F.lit(1.0)).when(F.col("n") <= exact_up_to, exact).otherwise(_norm_sf_series(z))
    return out.select(F.col("g").alias(group), F.col("n").cast("long"), F.round("w_plus", 6).alias("w_plus"), F.round(p, 6).alias("p_value"))
