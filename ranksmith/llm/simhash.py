"""SimHash near-duplicates found with BK-trees.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``width`` words joined by a space (fewer words: the whole sequence; none:
fingerprint zero), XXH64 (UTF-8, seed 42) of every shingle, repeats included;
a bit is 1 if it is set in over half of the hashes.

Linking: equal fingerprints are one class (grouped, never expanded into
pairs). Two distinct fingerprints at distance <= 2 agree on at least two of
four 16-bit blocks, so every class goes to the six shards named by (pair of
blocks, their bits). A shard of more than ``SHARD_ROWS`` classes is cut again
by the same rule on its 32 free bits; such a shard has 16 free bits, so it
holds at most 65,536 distinct fingerprints. In its task a shard becomes a
BK-tree: a child hangs at its integer Hamming distance to the parent, and a
probe follows only the edges d - r .. d + r. The trees are not sent by a
driver broadcast, since all shards together are the fingerprints of all
documents, which must not pass through the driver: each shard's probes are
shuffled to its tree instead, which is the same tree and the same walk. Every
link inside a shard is found; a union-find writes one edge per class, and
``connected_components`` joins the shards.

Defined cases
* null or blank text: fingerprint zero, linked like any other;
* very long texts are hashed whole; ties at exactly half of the hashes give 0;
* repeated rows and repeated ids: one result row each; rows of one id are one node;
* null doc_id: gets its fingerprint, links with nothing, component null;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import free_names
from .common import connected_components, freeze, text_slices

WIDTH = 3
RADIUS = 2
#: Classes in one shard before it is cut again.
SHARD_ROWS = 4096


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a text."""
    import xxhash
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    grams = map(b" ".join, zip(*[w[i:] for i in range(width)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(w) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: bits set in over half of the hashes (none: 0)."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        part = hashes[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little").view("<u8")
    return int(bits[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, rk, fp): hash of the row, and the fingerprint as a signed long with the same bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                fp = np.array([majority(shingle_hashes(t, width)) for t in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "rk", "fp"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rk"), "text").mapInArrow(run, "doc_id long, rk long, fp long")


class BKTree:
    """Nodes by insertion; a child hangs at its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, fp: int) -> int:
        """Add ``fp`` and return its node."""
        node, new = 0, len(self.fps)
        self.fps.append(fp)
        self.children.append({})
        while new:
            d = (fp ^ self.fps[node]).bit_count()
            nxt = self.children[node].get(d)
            if nxt is None:
                self.children[node][d] = new
                break
            node = nxt
        return new

    def near(self, fp: int, radius: int) -> list[int]:
        """Nodes within ``radius`` of ``fp``: only edges d - radius .. d + radius are followed."""
        found, todo = [], [0] if self.fps else []
        while todo:
            node = todo.pop()
            d = (fp ^ self.fps[node]).bit_count()
            if d <= radius:
                found.append(node)
            todo += [c for e, c in self.children[node].items() if d - radius <= e <= d + radius]
        return found


def shard_links(fps: list[int], ids: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (id, smallest id of its group) for all links inside one shard."""
    tree, root = BKTree(), list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, fp in enumerate(fps):
        for j in tree.near(fp, radius):
            a, b = find(i), find(j)
            if a != b:
                a, b = (a, b) if ids[a] <= ids[b] else (b, a)
                root[b] = a
        tree.insert(fp)
    return [(ids[i], ids[find(i)]) for i in range(len(fps)) if find(i) != i]


def _key(fp: Column, blocks: list[tuple[int, int]], pair: tuple[int, int], tag: int) -> Column:
    """(tag, bits of the two blocks) as one long; blocks are (shift, bits)."""
    out = F.lit(tag).cast("long")
    for b in pair:
        shift, bits = blocks[b]
        out = F.shiftleft(out, bits).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def shards(classes: DataFrame, limit: int = SHARD_ROWS) -> DataFrame:
    """(fp, rep) -> (shard, sub, fp, rep): six rows per class, more only in hot shards."""
    wide = [(16 * i, 16) for i in range(4)]
    pairs = list(combinations(range(4), 2))
    out = classes.select("fp", "rep", F.explode(F.array(*[_key(F.col("fp"), wide, p, n) for n, p in enumerate(pairs)]))
                         .alias("shard"))
    hot = freeze(out.groupBy("shard").count().where(F.col("count") > limit).select("shard", F.lit(1).alias("hot")), "simhash-hot")
    out = out.join(hot, "shard", "left")
    # the 32 bits that the pair leaves free, cut into four parts of 8 bits by the same rule
    bits = [[wide[b] for b in range(4) if b not in p] for p in pairs]
    tag = F.shiftrightunsigned("shard", 32).cast("int")
    free = F.element_at(F.array(*[_key(F.col("fp"), x, (1, 0), 0) for x in bits]), tag + 1)
    parts = [(8 * i, 8) for i in range(4)]
    subs = F.array(*[_key(F.col("free"), parts, q, m + 1) for m, q in enumerate(pairs)])
    out = out.withColumn("free", F.when(F.col("hot").isNotNull(), free))
    cold = F.array(F.lit(0).cast("long"))
    return out.select("shard", F.explode(F.when(F.col("hot").isNull(), cold).otherwise(subs)).alias("sub"), "fp", "rep")


def links(classes: DataFrame, radius: int = RADIUS, limit: int = SHARD_ROWS) -> DataFrame:
    """(fp, rep) of distinct fingerprints -> edges (a, b) that span every group of links."""
    if radius > 2:
        raise ValueError("shards by two of four blocks are complete up to radius 2")
    s = shards(classes, limit)
    # A shard with one class has no link; the window needs the same shuffle as the walk.
    w = Window.partitionBy("shard", "sub")
    s = (s.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") > 1)
         .sortWithinPartitions("shard", "sub", "fp", "rep").select("shard", "sub", "fp", "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, ids = None, [], []

        def done() -> pa.RecordBatch:
            e = shard_links(fps, ids, radius)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()),
                                               pa.array([x[1] for x in e], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for sh, sub, fp, rep in zip(cols[0].tolist(), cols[1].tolist(), cols[2].view(np.uint64).tolist(), cols[3].tolist()):
                if (sh, sub) != key:
                    if len(fps) > 1:
                        yield done()
                    key, fps, ids = (sh, sub), [], []
                fps.append(fp)
                ids.append(rep)
        if len(fps) > 1:
            yield done()

    return s.mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, doc_id: str, text: str, width: int, radius: int, limit: int) -> DataFrame:
    """(doc_id, rk, fp, component_id) per row; rk = hash of id and text."""
    fp = freeze(fingerprints(docs, doc_id=doc_id, text=text, width=width), "simhash-fp")
    classes = freeze(fp.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    comp = connected_components(links(classes, radius, limit))
    named = freeze(classes.join(comp, classes["rep"] == comp["node"], "left")
                   .select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-named")
    return fp.join(named, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    radius: int = RADIUS, limit: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return _components(docs, doc_id, text, width, radius, limit).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS,
             limit: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (of several rows
    of that id, one). Rows without an id stay."""
    key, rk, copy = free_names(docs, "__id", "__rk", "__copy")
    c = _components(docs, doc_id, text, width, radius, limit).where(F.col("component_id").isNotNull())
    best = freeze(c.groupBy("component_id").agg(F.min(F.struct("doc_id", "rk")).alias("b"))
                  .select(F.col("b.doc_id").alias(key), F.col("b.rk").alias(rk)), "simhash-kept")
    d = docs.withColumn(key, F.col(doc_id).cast("long")).withColumn(rk, row_key(F.col(key), F.col(text)))
    # the join's partitioning and order also serve the window: one shuffle of the texts
    w = Window.partitionBy(key, rk).orderBy(rk)
    kept = d.join(best, [key, rk]).withColumn(copy, F.row_number().over(w)).where(F.col(copy) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))


def row_key(doc_id: Column, text: Column) -> Column:
    """Hash of a row's id and text."""
    return F.xxhash64(doc_id, text)
