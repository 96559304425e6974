"""Near-duplicate vectors by product quantisation with inverted lists.

On unit vectors cos >= t means distance <= r with r^2 = 2 - 2 t.

Index. A bounded sample of distinct vectors (``SAMPLE``, by hash of the id) gives coarse
centroids (k-means) and, per subspace, a codebook of residuals. Every distinct
vector is put into the list of its nearest centroid, as residual codes plus
the length of what the codes leave out.

Sufficient probes. If x lies in list i and y in list j and they are within r,
the segment between them crosses the bisector of the two centroids, so one of
them is within r / 2 of it. A vector probes every list j with
    d(x, c_j)^2 - d(x, c_i)^2 <= r * d(c_i, c_j),
and its own; every pair within r then meets in a list, whatever the data. A
pair that meets twice counts in the list with the smaller number.

Distances. In a list the probing vectors build tables of squared distances
between their residual and the codebooks (asymmetric); a member stays if its
table distance is at most r plus the length its codes leave out, which no
pair within r exceeds. Those left are reranked by the exact cosine in double
precision. Recall is 1 up to rounding of the bounds (a slack of ``SLACK`` is added).

Spark's part: equal vectors are one class with a count, so copies are never
paired. Lists are cut into blocks of ``BLOCK_ROWS`` members by hash and a
probing vector goes to every block of its lists; members come first, probes
stream past them. Only counts per class and one spanning edge per linked class
leave a task; ``connected_components`` joins them.

Defined cases
* vectors that are null, zero, empty or hold null or non-finite components: no
  links, their own component;
* vectors of another length than the most frequent one are compared after
  filling with 0, as the cosine does not change by that;
* repeated rows: each row is a vector, linked to its copies; rows that repeat
  an id pool their links under it; null ids take no part: 0 links, null component;
* pairs exactly at the threshold are links; fewer rows than centroids: fewer lists;
* empty table: empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, freeze
from .nra import _dense

COSINE = 0.95
SAMPLE = 16_384
LIST_ROWS = 1024
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 64
BLOCK_ROWS = 2048
#: Probing vectors compared at once inside a task.
PROBE_ROWS = 256
#: Entries of the counts and links that a task holds, besides those of one step.
HELD = 1 << 17
SLACK = 1e-6
SEED = 11


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty centre stays where it was."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centre of each row (ties: the first)."""
    out = np.empty(len(x), np.int64)
    half = 0.5 * (c ** 2).sum(1)
    for a in range(0, len(x), 4096):
        out[a:a + 4096] = np.argmax(x[a:a + 4096] @ c.T - half, axis=1)
    return out


@dataclass
class Index:
    """Coarse centres, residual codebooks, and what the probe rule needs."""

    centres: np.ndarray
    books: np.ndarray  # subspace, code, component
    radius: float

    def __post_init__(self) -> None:
        sq = (self.centres ** 2).sum(1)
        self.sq = sq

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows as (row, subspace, component), the last subspace filled with 0."""
        m, _, w = self.books.shape
        out = np.zeros((len(x), m * w))
        out[:, :x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length left out) of each row in its list."""
        res = self.split(x - self.centres[at])
        codes = np.stack([nearest(res[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)
        rest = np.sqrt(sum(((res[:, m] - self.books[m][codes[:, m]]) ** 2).sum(1) for m in range(len(self.books))))
        return codes, rest

    def probes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(row, list) bool: lists to probe besides the own one."""
        d2 = self.sq[None, :] - 2 * x @ self.centres.T
        own = d2[np.arange(len(x)), at]
        gaps = np.sqrt(np.maximum(self.sq[at][:, None] + self.sq[None, :] - 2 * self.centres[at] @ self.centres.T, 0.0))
        out = d2 - own[:, None] <= self.radius * gaps + SLACK
        out[np.arange(len(x)), at] = False
        return out


def train(x: np.ndarray, lists: int, subspaces: int, codes: int, radius: float, seed: int = SEED) -> Index:
    """Centres and codebooks from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    w = -(-dim // subspaces)
    centres = kmeans(x, lists, 8, rng)
    index = Index(centres, np.zeros((-(-dim // w), 1, w)), radius)
    res = index.split(x - centres[nearest(x, centres)])
    books = [kmeans(res[:, m], codes, 6, rng) for m in range(res.shape[1])]
    n = max(len(b) for b in books)
    index.books = np.stack([np.concatenate([b, np.repeat(b[:1], n - len(b), axis=0)]) for b in books])
    return index


def usable(vec: Column) -> Column:
    """True for vectors with only finite components, not all zero."""
    x = F.transform(vec, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def unit(col: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision (scaled first, so that squares stay finite)."""
    x = _dense(col, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(1, keepdims=True))


def match(index: Index, j: int, mem: tuple, probe: tuple, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(probe position, member position) of the links between a block of list j
    and probing vectors: table distances, then exact cosines.

    mem: ids, unit rows, codes, rest; probe: ids, unit rows, own lists.
    """
    mids, mx, codes, rest = mem
    pids, px, own = probe
    res = index.split(px - index.centres[j])
    # squared distances of each probe's residual to all codes, summed over subspaces by the members' codes
    d2 = np.zeros((len(px), len(mx)))
    for m, book in enumerate(index.books):
        r = res[:, m]
        tab = (r ** 2).sum(1)[:, None] - 2 * r @ book.T + (book ** 2).sum(1)[None, :]
        d2 += tab[:, codes[:, m]]
    cand = d2 <= (index.radius + rest[None, :] + SLACK) ** 2
    cand &= pids[:, None] != mids[None, :]
    a, b = np.nonzero(cand)
    keep = np.einsum("ij,ij->i", px[a], mx[b]) >= cosine
    a, b = a[keep], b[keep]
    # across lists: a pair that also meets in the probe's own list counts in the smaller list
    across = own[a] != j
    if across.any():
        x, i = mx[b[across]], own[a[across]]
        diff = (index.sq[i] - 2 * np.einsum("ij,ij->i", x, index.centres[i])) - (index.sq[j] - 2 * x @ index.centres[j])
        gaps = np.sqrt(((index.centres[i] - index.centres[j]) ** 2).sum(1))
        twice = diff <= index.radius * gaps + SLACK
        drop = np.zeros(len(a), bool)
        drop[np.flatnonzero(across)[twice & (i < j)]] = True
        a, b = a[~drop], b[~drop]
    return a, b


def _spanning(a: np.ndarray, b: np.ndarray, root: dict) -> None:
    """Union of the links (ids) into ``root``."""
    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", cosine: float = COSINE,
                    sample: int = SAMPLE, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS,
                    subspaces: int = SUBSPACES, codes: int = CODES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    radius = float(np.sqrt(2 - 2 * cosine))
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("v"))
    every = freeze(every.withColumn("ok", F.col("vec_id").isNotNull() & usable(F.col("v"))), "pq-rows")
    # equal vectors are one class, named by its smallest id
    classes = freeze(every.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "pq-classes")
    info = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dim = info["n"], info["d"]
    own = every.where("ok").join(classes, "v").select("vec_id", "rep", "m")
    if n:
        pairs = freeze(_links(classes, n, dim, radius, cosine, sample, list_rows, most_lists, subspaces, codes, block_rows), "pq-links")
        extra = pairs.where("kind = 0").groupBy("a").agg(F.sum("b").alias("extra"))
        comp = connected_components(pairs.where("kind = 1").select("a", "b"))
        named = (classes.select("rep").distinct().join(extra, F.col("rep") == F.col("a"), "left")
                 .join(comp, F.col("rep") == F.col("node"), "left")
                 .select("rep", F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("component", "rep").alias("component_id")))
        own = own.join(freeze(named, "pq-named"), "rep")
        own = own.select("vec_id", (F.col("m") - 1 + F.col("extra")).alias("n_links"), "component_id")
    else:
        own = own.select("vec_id", F.col("m").alias("n_links"), F.col("rep").alias("component_id"))
    alone = every.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (own.unionByName(alone)
            .select("vec_id", "n_links", "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _links(classes: DataFrame, n: int, dim: int, radius: float, cosine: float, sample: int, list_rows: int,
           most_lists: int, subspaces: int, codes: int, block_rows: int) -> DataFrame:
    """(kind, a, b): kind 0 = class a has b more linked rows, kind 1 = link between classes a and b."""
    spark = classes.sparkSession
    # the bounded training sample
    got = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow()
    x = unit(got["v"].combine_chunks() if isinstance(got["v"], pa.ChunkedArray) else got["v"], dim)
    lists = min(most_lists, max(1, n // list_rows), len(x))
    index = train(x, lists, subspaces, codes, radius)
    bc = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centres and the codebooks

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = bc.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                u = unit(part.column(2), dim)
                at = nearest(u, ix.centres)
                row, lst = np.nonzero(ix.probes(u, at))
                ends = np.searchsorted(row, np.arange(len(u) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(at.astype(np.int32)),
                                                  pa.ListArray.from_arrays(ends, pa.array(lst.astype(np.int32)))],
                                                 names=["rep", "m", "v", "own", "probes"])

    vtype = classes.schema["v"].dataType.simpleString()
    put = freeze(classes.select("rep", "m", "v").mapInArrow(assign, f"rep long, m long, v {vtype}, own int, probes array<int>"), "pq-lists")
    sizes = {r.own: r["count"] for r in put.groupBy("own").count().collect()}  # one row per list: MOST_LISTS at most
    cuts = [max(1, -(-sizes.get(i, 0) // block_rows)) for i in range(lists)]
    many = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("list") + 1) if lists <= 256 else _lookup(spark, cuts)
    member = put.select(F.col("own").alias("list"), "rep", "m", "v", "own").withColumn("cut", many)
    member = member.select("list", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int").alias("block"), F.lit(0).alias("kind"), "rep", "m", "v", "own")
    probe = put.select(F.explode(F.concat(F.array("own"), "probes")).alias("list"), "rep", "m", "v", "own").withColumn("cut", many)
    probe = probe.select("list", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block"), F.lit(1).alias("kind"), "rep", "m", "v", "own")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = member.unionByName(probe).repartition(parts, "list", "block").sortWithinPartitions("list", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, key, mem, got, extra, root = bc.value, None, None, [], {}, {}

        def close(parts_: list) -> tuple:
            ids = np.concatenate([p[0] for p in parts_])
            u = np.concatenate([p[1] for p in parts_])
            m = np.concatenate([p[2] for p in parts_])
            c, rest = ix.encode(u, np.full(len(u), key[0]))
            return ids, u, c, rest, m

        def flush() -> pa.RecordBatch:
            e = [(1, x, y) for x in root if (y := _top(root, x)) != x]
            out = [(0, x, c) for x, c in extra.items()] + e
            extra.clear()
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                              names=["kind", "a", "b"])

        for batch in batches:
            lst, blk, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            turn = (lst[1:] != lst[:-1]) | (blk[1:] != blk[:-1]) | (kind[1:] != kind[:-1])
            edges = np.flatnonzero(np.concatenate([[True], turn, [True]]))
            for a, b in zip(edges[:-1], edges[1:]):
                if (lst[a], blk[a]) != key:
                    if root or extra:
                        yield flush()
                    key, mem, got = (int(lst[a]), int(blk[a])), None, []
                step = PROBE_ROWS if kind[a] else b - a
                for s in range(a, b, step):
                    part = batch.slice(s, min(step, b - s))
                    row = (np.asarray(part.column(3)), unit(part.column(5), dim), np.asarray(part.column(4)), np.asarray(part.column(6)))
                    if not kind[a]:
                        got.append(row)
                        continue
                    if mem is None:
                        if not got:
                            continue  # an empty block
                        mem, got = close(got), []
                    p, q = match(ix, key[0], mem[:4], (row[0], row[1], row[3]), cosine)
                    if not len(p):
                        continue
                    # the probe counts the member; across lists, where only one side may probe, the member counts it too
                    _count(extra, row[0][p], mem[4][q])
                    other = row[3][p] != key[0]
                    _count(extra, mem[0][q[other]], row[2][p[other]])
                    _spanning(row[0][p], mem[0][q], root)
                    # counts are summed and links joined afterwards, so a part of them can go at any time
                    if len(extra) + len(root) > HELD:
                        yield flush()
        if root or extra:
            yield flush()

    return both.mapInArrow(run, "kind int, a long, b long")


def _top(root: dict, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def _count(extra: dict, ids: np.ndarray, m: np.ndarray) -> None:
    """Add the row counts ``m`` to the classes ``ids``."""
    if not len(ids):
        return
    u, at = np.unique(ids, return_inverse=True)
    for i, c in zip(u.tolist(), np.bincount(at, weights=m).tolist()):
        extra[i] = extra.get(i, 0) + int(c)


def _lookup(spark, cuts: list[int]) -> Column:
    """Blocks per list as a column; lists that are one block are left out of the map."""
    many = [(i, c) for i, c in enumerate(cuts) if c > 1]
    if not many:
        return F.lit(1)
    m = F.create_map(*[F.lit(v) for pair in many for v in pair])
    return F.coalesce(F.element_at(m, F.col("list")), F.lit(1))
