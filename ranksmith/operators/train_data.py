"""Training-set preparation for contrastive training.

Everything random is an md5 uniform of (seed, epoch, row, item), so a plan is
reproducible and independent of partitioning. Row-local sampling (positive,
negatives, chunk shuffle) is done with array functions inside the row - no
explode, no shuffle. The batch plan needs each row's rank inside its
dataset; it comes from a global range-partitioned sort (``ordered_index``),
not a per-dataset window, so one dataset holding a third of all rows is still
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import u01
from ..functions.text import chunk_shuffle, format_instruction
from .corpus import ordered_index


def cap_dataset(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` random rows per dataset, without replacement.
    ``row_number() <= n`` becomes a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy("dataset_id").orderBy(u01(F.lit(seed), F.lit("cap"), F.col("row_id")), "row_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def merge_small(df: DataFrame, small_threshold: int, drop_threshold: int) -> DataFrame:
    """Small datasets (fewer than ``small_threshold`` rows) of one directory
    (``source_dir``) become one dataset, named by the smallest of their ids and
    dropped below ``drop_threshold`` rows; a small dataset that was given as a
    single file (null ``source_dir``) is dropped. Adds ``merged`` (bool)."""
    sizes = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"), F.min("source_dir").alias("_dir"))
    small = sizes.where((F.col("_n") < small_threshold) & F.col("_dir").isNotNull())
    merged = small.groupBy("_dir").agg(F.min("dataset_id").alias("_into"), F.sum("_n").alias("_total"))
    # one row per dataset: the join is broadcast by its statistics, shuffled if there are very many
    plan = (sizes.join(merged, "_dir", "left")
            .select("dataset_id", (F.col("_n") < small_threshold).alias("merged"), "_dir", "_into", "_total")
            .where(~F.col("merged") | (F.col("_dir").isNotNull() & (F.col("_total") >= drop_threshold))))
    return (df.join(plan.select("dataset_id", "merged", "_into"), "dataset_id")
            .withColumn("dataset_id", F.when(F.col("merged"), F.col("_into")).otherwise(F.col("dataset_id"))).drop("_into"))


def dataset_batch_size(df: DataFrame, default: int) -> DataFrame:
    """(dataset_id, batch_size): the first row's ``batch_size``; else half
    the default when the first row's type contains 'symmetric'; else the
    default. A merged set takes the minimum over its source files."""
    first = df.groupBy("dataset_id", "source_file").agg(
        F.min_by(F.struct("batch_size", "type"), "row_id").alias("f"))
    bs = F.coalesce(F.col("f.batch_size"),
                    F.when(F.coalesce(F.col("f.type"), F.lit("")).contains("symmetric"), F.lit(default // 2)),
                    F.lit(default))
    return first.groupBy("dataset_id").agg(F.min(bs).alias("batch_size"))


def group_size(first_type: Column, first_neg_count: Column, first_tgs: Column, default: int) -> Column:
    """I4: group size of a batch from its first row."""
    return (F.when(first_type == "only_1neg", F.lit(2))
            .when(first_type == "symmetric_class", F.least(first_neg_count + 1, F.lit(default)))
            .when(first_type.isNotNull(), F.lit(default))
            .when(first_tgs.isNotNull() & (first_tgs > 0), first_tgs)
            .otherwise(F.lit(default)))


def batch_group_size(plan: DataFrame, df: DataFrame, default: int) -> DataFrame:
    """I4 per batch: every row of ``df`` with the group size of its rank's slice
    of the batch, which the slice's first row (slot 0) decides."""
    cols = set(df.columns)
    typ = F.col("type") if "type" in cols else F.lit(None).cast("string")
    tgs = F.col("train_group_size") if "train_group_size" in cols else F.lit(None).cast("int")
    slices = ["epoch", "dataset_id", "batch_no", "rank"]
    first = (plan.where(F.col("slot") == 0).select(*slices, "row_id").join(df.drop("dataset_id"), "row_id")
             .select(*slices, group_size(typ, F.size("neg"), tgs, default).alias("g")))
    rows = plan.select(*slices, "row_id").join(first, slices).select("row_id", "g")
    return df.join(rows, "row_id")


def pick_positive(pos: Column, seed, epoch, row_id: Column) -> Column:
    """0-based index of one random positive."""
    return F.floor(u01(seed, epoch, row_id, F.lit("pos")) * F.size(pos)).cast("int")


def sample_negatives(neg: Column, g: Column, seed, epoch, row_id: Column) -> Column:
    """G - 1 negative indices (0-based) without replacement; when fewer
    negatives exist the index list is repeated ceil((g-1)/n) times first, so
    one negative appears at most that often. Order = sample order."""
    n = F.size(neg)
    need = g - 1
    rep = F.ceil(need / n).cast("int")
    total = F.greatest(rep, F.lit(1)) * n
    cand = F.transform(F.sequence(F.lit(0), total - 1),
                       lambda j: F.struct(u01(seed, epoch, row_id, F.lit("neg"), j).alias("u"), (j % n).alias("i")))
    picked = F.slice(F.array_sort(cand), 1, need)
    return F.when((n > 0) & (need > 0), F.transform(picked, lambda s: s["i"])).otherwise(F.array().cast("array<int>"))


def build_groups(df: DataFrame, *, seed: int, epoch: int, group: int = 8,
                 query_instruction: str | None = None, query_format: str = "{}{}",
                 passage_instruction: str | None = None, passage_format: str = "{}{}",
                 shuffle_ratio: float = 0.0, distill: bool = True) -> DataFrame:
    """One training group per row.

    The group size is the column ``g`` (see ``batch_group_size``) or ``group``.
    Output: row_id, dataset_id, query (formatted), g, passages ARRAY<STRING>
    (positive first), teacher ARRAY<DOUBLE> (same order, null without
    distillation). Types ``symmetric_sts`` / ``symmetric_clustering`` format
    their passages with the query format and instruction.
    """
    cols = set(df.columns)
    typ = F.col("type") if "type" in cols else F.lit(None).cast("string")
    prompt = F.col("prompt") if "prompt" in cols else F.lit(None).cast("string")
    g = F.col("g") if "g" in cols else F.lit(group)
    rid = F.col("row_id")
    t = (df.withColumn("g", g)
         .withColumn("_pi", pick_positive(F.col("pos"), F.lit(seed), F.lit(epoch), rid))
         .withColumn("_ni", sample_negatives(F.col("neg"), F.col("g"), F.lit(seed), F.lit(epoch), rid)))
    pos_text = F.element_at("pos", F.col("_pi") + 1)
    pos_text = chunk_shuffle(pos_text, shuffle_ratio, F.lit(seed), F.lit(epoch), rid) if shuffle_ratio > 0 else pos_text
    negs = F.transform("_ni", lambda i: F.element_at("neg", i + 1))
    passages = F.concat(F.array(pos_text), negs)
    q_ins = F.coalesce(prompt, F.lit(query_instruction)) if query_instruction is not None else prompt
    query = format_instruction(query_format, q_ins, F.col("query"))
    sym = typ.isin("symmetric_sts", "symmetric_clustering")
    p_q = F.transform(passages, lambda p: format_instruction(query_format, q_ins, p))
    p_p = (F.transform(passages, lambda p: format_instruction(passage_format, F.lit(passage_instruction), p))
           if passage_instruction is not None else passages)
    passages = F.when(sym.isNotNull() & sym, p_q).otherwise(p_p)
    teacher = (F.concat(F.array(F.element_at("pos_scores", F.col("_pi") + 1)),
                        F.transform("_ni", lambda i: F.element_at("neg_scores", i + 1)))
               if distill and "pos_scores" in cols else F.lit(None).cast("array<double>"))
    return t.select("row_id", "dataset_id", query.alias("query"), "g", passages.alias("passages"),
                    teacher.alias("teacher"))


def plan_batches(df: DataFrame, batch_sizes: DataFrame, *, seed: int, epoch: int, world: int = 1) -> DataFrame:
    """I9 + I10: per dataset, shuffle rows, cut into full batches of
    ``batch_size * world`` rows (the short last batch is dropped), then shuffle
    all batches; each rank gets an equal contiguous slice of a batch.

    Output: epoch, batch_key (dataset_id, batch_no), batch_order (global
    position of the batch in the epoch), rank, slot (position inside the
    rank's slice), row_id.
    """
    u = u01(F.lit(seed), F.lit(epoch), F.lit("row"), F.col("row_id"))
    keyed = df.select("dataset_id", "row_id", u.alias("_u"))
    idx = ordered_index(keyed, ["dataset_id", "_u", "row_id"], idx="_idx")
    firsts = idx.groupBy("dataset_id").agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    j = idx.join(firsts.join(batch_sizes, "dataset_id"), "dataset_id")
    per = F.col("batch_size") * F.lit(world)
    rnk = F.col("_idx") - F.col("_first")
    j = (j.withColumn("batch_no", F.floor(rnk / per).cast("long"))
         .withColumn("pos_in_batch", (rnk % per).cast("int"))
         .where(F.col("batch_no") < F.floor(F.col("_n") / per)))
    border = u01(F.lit(seed), F.lit(epoch), F.lit("batch"), F.col("dataset_id"), F.col("batch_no"))
    return j.select(
        F.lit(epoch).alias("epoch"), "dataset_id", "batch_no", border.alias("batch_u"),
        F.floor(F.col("pos_in_batch") / F.col("batch_size")).cast("int").alias("rank"),
        (F.col("pos_in_batch") % F.col("batch_size")).cast("int").alias("slot"),
        "batch_size", "row_id")


def batch_order(plan: DataFrame) -> DataFrame:
    """Global order of the batches of an epoch (dense, by the batch uniform).
    One row per batch, numbered with the ordered index (no single-task window)."""
    b = plan.select("epoch", "dataset_id", "batch_no", "batch_u").distinct()
    return ordered_index(b, ["epoch", "batch_u", "dataset_id", "batch_no"], idx="batch_order")


def no_in_batch_flag(path: Column, global_flag: bool = False) -> Column:
    """Datasets whose file stem (or directory name) ends in
    ``no_in_batch_neg``; the global switch turns it on for all."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.jsonl?)?/?$", 1)
    return F.lit(global_flag) | stem.endswith("no_in_batch_neg")


def flatten_batch(plan: DataFrame, groups: DataFrame) -> DataFrame:
    """B queries and B*g passages of each batch, scores in the same
    order: (epoch, dataset_id, batch_no, rank, slot, j, position, text, teacher);
    ``j = -1`` is the query."""
    x = plan.join(groups, ["row_id", "dataset_id"], "inner")
    q = x.select("epoch", "dataset_id", "batch_no", "rank", "slot", F.lit(-1).alias("j"),
                 F.col("slot").alias("position"), F.col("query").alias("text"),
                 F.lit(None).cast("double").alias("teacher"), "row_id")
    p = (x.select("epoch", "dataset_id", "batch_no", "rank", "slot", "g", "teacher", "row_id",
                  F.posexplode("passages").alias("j", "text"))
         .select("epoch", "dataset_id", "batch_no", "rank", "slot", "j",
                 (F.col("slot") * F.col("g") + F.col("j")).alias("position"), "text",
                 F.element_at("teacher", F.col("j") + 1).alias("teacher"), "row_id"))
    return q.unionByName(p)


def pad_plan(tokens: DataFrame, max_len: int, multiple: int = 8, keys=("epoch", "dataset_id", "batch_no", "rank"),
             sub_batch: int | None = None, position: str = "position") -> DataFrame:
    """Padded length per batch, or per ``sub_batch`` consecutive positions
    of it: longest truncated sequence rounded up to ``multiple``; each row's ids
    truncated and padded to it."""
    t = tokens.withColumn("_len", F.least(F.size("ids"), F.lit(max_len)))
    part = [F.col(k) for k in keys] + ([F.floor(F.col(position) / sub_batch)] if sub_batch else [])
    w = Window.partitionBy(*part)  # rows of a batch: bounded
    t = t.withColumn("pad_to", (F.ceil(F.max("_len").over(w) / multiple) * multiple).cast("int"))
    return t.withColumn("padded", F.concat(F.slice("ids", 1, max_len),
                                           F.array_repeat(F.lit(0), F.col("pad_to") - F.col("_len")))) \
        .withColumn("attention", F.concat(F.array_repeat(F.lit(1), F.col("_len")),
                                          F.array_repeat(F.lit(0), F.col("pad_to") - F.col("_len")))).drop("_len")


def validate_training(df: DataFrame, distill: bool = False) -> DataFrame:
    """Rejected rows with all their reasons (empty frame = all good)."""
    reasons = [
        F.when(F.col("pos").isNull() | (F.size("pos") == 0), F.lit("pos missing or empty")),
        F.when(F.col("neg").isNull() | (F.size("neg") == 0), F.lit("neg missing or empty")),
    ]
    if distill:
        for side in ("pos", "neg"):
            scores = F.col(f"{side}_scores")
            reasons.append(F.when(scores.isNull() | (F.size(scores) != F.size(side)), F.lit(f"{side}_scores do not match {side}")))
            bad = F.exists(scores, lambda x: x.isNull() | F.isnan(x))
            reasons.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{side}_scores not numeric")))
    r = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return df.withColumn("reasons", r).where(F.size("reasons") > 0)


def mixed_type_batches(plan: DataFrame, df: DataFrame) -> DataFrame:
    """I14 (batch rule): batches whose rows do not share one ``type``."""
    x = plan.join(df.select("row_id", "type"), "row_id")
    return (x.groupBy("epoch", "dataset_id", "batch_no")
            .agg(F.countDistinct(F.coalesce("type", F.lit("<none>"))).alias("types"))
            .where(F.col("types") > 1))
