"""Helpers shared by the training-data operators.

* ``freeze``: cut lineage by writing a Parquet table below the session's
  checkpoint directory (the folder that all executors and the driver share)
  and reading it back. A lost executor then costs a re-read, not a recompute.
* ``held``: the fold of a document, from the crc32 of its id as text.
* Arrow text helpers: lower-cased ASCII-white-space words of a batch as
  dictionary codes, in slices of bounded bytes.
* ``connected_components``: large-star / small-star rounds over edges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table  # noqa: F401  (re-exported)

#: Text handled at once inside a task; a single longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Rows that may be broadcast as a small lookup side (beyond it: a shuffled join).
BROADCAST_ROWS = 100_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def held(doc_id: str | Column, remainder: int, folds: int = 5) -> Column:
    """True where crc32(id as text) mod ``folds`` is ``remainder``; a null id is
    in no fold (False)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == remainder, F.lit(False))


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) row ranges of at most ``limit`` bytes (one row at least)."""
    ends = np.cumsum(lengths.astype(np.int64))
    start, n = 0, len(lengths)
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, min(end, n)
        start = end


def text_slices(batch: pa.RecordBatch, col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part holds at most ``limit`` bytes of column ``col``."""
    lens = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(lens, limit):
        yield batch.slice(a, b - a)


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-white-space words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased.

    Returns (codes, offsets, distinct): ``codes[offsets[i]:offsets[i + 1]]`` are
    the words of text i as positions in ``distinct``. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offs = np.asarray(lists.offsets, dtype=np.int64)
    offs = offs - offs[0]
    enc = lists.flatten().dictionary_encode()
    codes, distinct = np.asarray(enc.indices, dtype=np.int64), enc.dictionary
    blank = pc.index(distinct, "").as_py()
    if blank >= 0:
        keep = codes != blank
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offs = codes[keep], before[offs]
        codes -= codes > blank
        distinct = pa.concat_arrays([distinct[:blank], distinct[blank + 1:]])
    return codes, offs, distinct


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``word_codes`` with the distinct words as bytes."""
    codes, offs, distinct = word_codes(texts, lower)
    return codes, offs, [x.encode() for x in distinct.to_pylist()]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) links -> (node, component): smallest id reachable.

    Large-star and small-star rounds (Kiveris et al., 2014). Each round groups
    by node with a partial minimum and joins that minimum back to the links;
    the minimum is written before the join, so a hub with a large share of all
    links is one big side that adaptive execution splits. Every round is
    frozen in the shared folder. Nulls and self links are ignored; only nodes
    with a link to another node are returned.
    """
    cur = freeze(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct(), "cc-links")
    for _ in range(max_rounds):
        if _are_stars(cur):
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = freeze(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-low")
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")))
        cur = freeze(large.distinct(), "cc-large")
        low = freeze(cur.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = (cur.join(low, "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        cur = freeze(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
    else:
        raise RuntimeError("connected components did not settle")
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def _are_stars(links: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    twice = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if not twice.isEmpty():
        return False
    parents = links.select(F.col("b").alias("a")).distinct()
    return parents.join(links.select("a").distinct(), "a", "left_semi").isEmpty()
