"""Corpus assembly (D1-D4) and the substring-containment join used to judge
text queries.

Ordered index (D1): position is meaning in the reference's corpora, so rows
get a dense 0-based ``idx`` in the order of given keys. A window
without ``PARTITION BY`` would pull every row into one task; instead the rows
are range-partitioned and sorted once and written, with their partition and
position in it, to the shared folder, so neither can change afterwards, also
when a lost task is recomputed. One count per partition gives the offsets.
Keys may be null (first) or repeated: nothing is joined back on their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import combine_title_text, drop_blank, id_text, strip
from ..session import freeze


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def ordered_index(df: DataFrame, order_cols: list[str], idx: str = "idx") -> DataFrame:
    """Add a dense 0-based ``idx`` following ``order_cols``; rows with equal
    keys get neighbouring numbers. The sort runs when this is called. All columns keep
    their values but one that is called ``idx`` already, which is replaced."""
    bits = 33  # monotonically_increasing_id: partition << 33 | position
    mid, part, off = free_names(df, "_mid", "_part", "_off")
    rows = freeze(df.orderBy(*order_cols).withColumn(mid, F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn(part, F.shiftright(mid, bits))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count
    offs = counts.select(part, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(off))
    at = F.col(off) + F.col(mid).bitwiseAND(F.lit((1 << bits) - 1))
    rows = rows.join(F.broadcast(offs), part)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != idx], at.cast("long").alias(idx))


def ordered_corpus(passages: DataFrame, order_cols: list[str], text: str = "passage",
                   did: str | None = None, stripped: bool = False) -> DataFrame:
    """Strip, drop blank, number rows from 0 in ``order_cols`` order.
    Output (idx, did, passage); ``did`` is '' when the source has no ids."""
    p = passages.withColumn("passage", F.col(text) if stripped else strip(F.col(text)))
    p = p.where(F.length(F.coalesce(F.col("passage"), F.lit(""))) > 0)
    p = p.withColumn("did", id_text(F.col(did)) if did else F.lit(""))
    return ordered_index(p, order_cols).select("idx", "did", "passage")


def title_text_corpus(docs: DataFrame, order_cols: list[str], id_col: str = "_id",
                      title: str = "title", text: str = "text", sep: str = "\n") -> DataFrame:
    """D2 (TREC / climate form): title + sep + text, blank rows dropped, ids aligned."""
    p = docs.withColumn("combined", combine_title_text(F.col(title), F.col(text), sep))
    return ordered_corpus(p, order_cols, text="combined", did=id_col, stripped=True)


def sts_corpus(pairs: DataFrame, order_cols: list[str]) -> DataFrame:
    """C4 / D2 (STS form): the second sentence is the passage, ``document_id`` the key."""
    return ordered_corpus(pairs, order_cols, text="text_2", did="document_id")


def union_sources(*frames: DataFrame) -> DataFrame:
    """D3: concatenate training sources with differing columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def duplicate_report(corpus: DataFrame, text: str = "passage") -> DataFrame:
    """Passages held more than once (the corpus keeps them all)."""
    return (corpus.groupBy(F.md5(F.col(text)).alias("passage_md5"))
            .agg(F.count(F.lit(1)).alias("copies"), F.min("idx").alias("first_idx"),
                 F.max("idx").alias("last_idx"))
            .where(F.col("copies") > 1))


def contains_join(docs: DataFrame, pats: DataFrame, *, doc_id: str, doc_text: str,
                  pat_id: str, pat_text: str, longest: int = 32, parts: int = 8) -> DataFrame:
    """All (doc, pattern) pairs where the document text contains the pattern.

    Exact, no cross product. Patterns are put into classes by length: a class
    of gram length K (a power of two up to ``longest``) holds the patterns of 2K - 1 to
    4K - 2 characters (the longest class all longer ones; length 1 and 2: K = 1).
    Any occurrence of a pattern of at least 2K - 1 characters covers one
    gram of the document at a multiple of K, and a pattern emits the gram at
    each of its first K offsets only, so an equi-join on (K, gram) finds every
    occurrence once. Documents emit grams only for the classes that exist, and
    first only as a set per document, so a frequent gram costs one row per
    document. The gram side of the documents is spread over ``parts`` salts
    and the few patterns are copied to each, so a gram that is in a third of all
    documents is split. Candidates are verified on the full text; empty
    patterns are ignored.
    """
    p = pats.select(F.col(pat_id).alias("_pid"), F.col(pat_text).alias("_pat")).where(F.length("_pat") > 0)
    sizes = [2 ** i for i in range(longest.bit_length()) if 2 ** i <= longest]
    k = F.lit(1)
    for size in sizes[1:]:
        k = F.when(F.length("_pat") >= 2 * size - 1, size).otherwise(k)
    p = p.withColumn("_k", k)
    present = sorted(r._k for r in p.select("_k").distinct().collect())  # at most len(sizes) rows
    if not present:
        return docs.select(F.col(doc_id)).limit(0).join(pats.select(F.col(pat_id)).limit(0), F.lit(False))
    d = docs.select(F.col(doc_id).alias("_did"), F.col(doc_text).alias("_txt"))

    def aligned(size: int) -> DataFrame:
        last = F.floor((F.length("_txt") - size) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_txt"), i * size + 1, F.lit(size)))
        return (d.where(F.length("_txt") >= size)
                .select("_did", F.lit(size).alias("_k"), F.explode(F.array_distinct(cut)).alias("_g")))

    dg = aligned(present[0])
    for size in present[1:]:
        dg = dg.unionByName(aligned(size))
    pg = p.select("_pid", "_k", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.least(F.col("_k"), F.length("_pat") - F.col("_k") + 1)),
        lambda o: F.substring(F.col("_pat"), o, F.col("_k"))))).alias("_g"))
    dg = dg.withColumn("_s", F.pmod(F.xxhash64("_did"), F.lit(parts)))
    pg = pg.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cand = dg.join(pg, ["_k", "_g", "_s"]).select("_did", "_pid").distinct()
    ver = (cand.join(p.select("_pid", "_pat"), "_pid").join(d, "_did").where(F.contains("_txt", "_pat")))
    return ver.select(F.col("_did").alias(doc_id), F.col("_pid").alias(pat_id)).distinct()
