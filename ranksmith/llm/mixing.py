"""Mixing sources to target weights (native DataFrame work only).

Steps: size of each document in words; sizes summed per source (partial
aggregation before the shuffle, so a source with a third of all rows is one
row per task); targets by water filling over the source table; repetition
rate = target / source size; each document is taken floor(rate) times plus one
Bernoulli copy whose probability is the fraction, drawn from the md5 of
(seed, doc_id).

Defined cases
* null or blank text: size 0, taken 0 words (its copies hold nothing);
* null source: a source of its own, ordered last; the empty string is an
  ordinary source;
* a source of size 0 has target 0;
* a null doc_id draws as the text ``null``; repeated ids draw alike, so repeated rows are
  taken alike; every row stays in the result, none is merged;
* an empty table gives an empty result; other columns are ignored by
  ``mix_plan`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import u01
from ..operators.corpus import free_names
from .common import BROADCAST_ROWS, freeze

#: Fixed values of the mix: weights by source order, share of all words, most repeats.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0)."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.trim(F.translate(F.coalesce(c, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size) one row per source -> with ``target`` and ``rate``.

    Water filling: with cap_i = most * size_i and weight w_i, the target is
    least(cap_i, level * w_i) where the level spends ``share`` of all sizes.
    Resharing an excess by weight ends at that same level. Sorted by cap_i /
    w_i, the capped sources are a prefix, so running sums give the level. The
    windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = (sizes.select("source", "source_size").withColumn("w", w)
         .withColumn("cap", most * F.col("source_size").cast("double"))
         .withColumn("ratio", F.col("cap") / F.col("w")))
    up = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", share * F.sum(F.col("source_size").cast("double")).over(all_))
         .withColumn("caps", F.sum("cap").over(up)).withColumn("ws", F.sum("w").over(up))
         .withColumn("w_all", F.sum("w").over(all_)))
    # Level when the sources up to this ratio are capped. Capping a source raises the level
    # exactly while its ratio is below it, so the largest of these levels is the right one.
    s = s.withColumn("next", F.when(F.col("w_all") > F.col("ws"),
                                    (F.col("total") - F.col("caps")) / (F.col("w_all") - F.col("ws"))))
    level = F.greatest(F.max("next").over(all_), F.col("total") / F.col("w_all"))
    target = F.least(F.col("cap"), level * F.col("w"))
    return (s.withColumn("target", target)
            .withColumn("rate", F.when(F.col("source_size") > 0,
                                       F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
                        .otherwise(F.lit(0.0)))
            .select("source", "source_size", "target", "rate"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate) plus one hash-seeded Bernoulli copy for the fraction."""
    u = u01(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _join_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their source's row: broadcast when the source table is
    small (counted), else a shuffled join that adaptive execution can split."""
    small = targets.count() <= BROADCAST_ROWS
    t = targets.withColumnRenamed("source", "__mix_source")
    return docs.join(F.broadcast(t) if small else t, docs["source"].eqNullSafe(t["__mix_source"])).drop("__mix_source")


def _targets(slim: DataFrame, **kw) -> DataFrame:
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    return freeze(source_targets(freeze(per, "mix-sources"), **kw), "mix-targets")


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             seed: str = SEED, **kw) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    The words are counted once: (id, source, size) is frozen, then summed and
    joined. Output ``taken`` = copies * size.
    """
    slim = freeze(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                              word_count(text).alias("size")), "mix-sizes")
    j = _join_sources(slim, _targets(slim, **kw))
    j = j.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return j.select("doc_id", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  seed: str = SEED, **kw) -> DataFrame:
    """The mix itself: every row repeated as often as it is taken (0, 1, 2 times).

    All columns of ``docs`` are kept. The wide rows are not shuffled: the
    source table is joined to them and the copies are exploded in place.
    """
    slim = docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
    name, rate, copy = free_names(docs, "__mix_source", "__mix_rate", "__mix_copy")
    t = _targets(slim, **kw).select(F.col("source").alias(name), F.col("rate").alias(rate))
    small = t.count() <= BROADCAST_ROWS
    j = docs.join(F.broadcast(t) if small else t, docs[source].eqNullSafe(t[name]))
    n = copies(F.col(rate), docs[doc_id], seed)
    j = j.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n)))
    return j.select(*[docs[c] for c in docs.columns])
