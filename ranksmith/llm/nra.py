"""Exact top-k by sequential reading of sorted lists (no random access).

Vectors are quantised (floor(256 x)); the score is the integer inner product.
Per dimension a shard of the corpus has one list sorted by component. A query
with a positive component reads that list from its top, with a negative one
from its bottom, so the summands come in falling order. After a round of
reading every row has
    lower bound = sum of summands read + smallest possible rest,
    upper bound = sum of summands read + what the lists can still give;
a row whose upper bound is below the k-th lower bound (or below the k-th score
of the shards read before) cannot qualify. Reading stops when at most
``SETTLE`` rows per query are left, or at the lists' end; the final scores of
the rows left are then resolved in full. Rows equal to the bound are kept, so
ties are decided by id.

Spark's part: queries are packed into blocks of about ``QUERY_ROWS``, corpus rows
into groups of about ``GROUP_CELLS`` components; a query block is copied once per group and the
corpus is moved once. In its task a group is cut into shards, the shards'
lists are built once, and the query blocks stream past them; only k rows per
query and group leave the task. Nothing passes the driver but counts.

Defined cases
* vectors that are null or hold null or non-finite components take no part;
* vectors of unequal length: missing components count as 0;
* scores are exact whole numbers, however large the components; a component or a
  score that a long cannot hold is an error that names its row;
* null ids take no part; rows of one id never score against each other; a repeated id is one
  query (its smallest vector) and one candidate per row;
* ties go to the smaller id; fewer than k candidates: all of them;
* empty table or no query: empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze

K = 5
EVERY = 50
SCALE = 256
#: Largest quantised component, and sums that doubles hold exactly.
LIMIT, EXACT = 1 << 62, 1 << 53
QUERY_ROWS = 64
#: Components of a shard and of a corpus group: rows times dimensions, whatever the dimension.
SHARD_CELLS = 1 << 18
GROUP_CELLS = 1 << 22
#: Share of each list that is read before the bounds are compared; then doubled.
FIRST_READ = 1 / 16
#: Rows per query that may be left when reading stops.
SETTLE = 64


def quantise(vec: Column, scale: int = SCALE, name: Column | None = None) -> Column:
    """floor(scale * x) per component, x as double, as longs; null if the vector is null
    or holds a null or non-finite component. A component beyond ``LIMIT`` raises, with the row's ``name``."""
    x = F.transform(vec, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    who = F.coalesce((F.lit("") if name is None else name).cast("string"), F.lit("null"))
    over = F.raise_error(F.concat(F.lit("a component is too large for a long: row "), who)).cast("long")
    q = F.transform(x, lambda v: F.when(F.abs(v * scale) > float(LIMIT), over).otherwise(F.floor(v * scale)))
    return F.when(vec.isNotNull() & ~F.coalesce(bad, F.lit(False)), q)


def exact_scores(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Inner products of paired rows as longs."""
    q, vecs = q.astype(np.int64), vecs.astype(np.int64)
    size = np.einsum("ij,ij->i", np.abs(q).astype(float), np.abs(vecs).astype(float))
    out = np.einsum("ij,ij->i", q, vecs)  # wraps around where ``size`` is too large
    for i in np.flatnonzero(size >= LIMIT).tolist():
        s = sum(a * b for a, b in zip(q[i].tolist(), vecs[i].tolist()))
        if not -(1 << 63) < s < 1 << 63:
            raise OverflowError(f"the score of rows {qid[i]} and {ids[i]} is too large for a long")
        out[i] = s
    return out


def _dense(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """List column -> matrix, shorter rows filled with 0."""
    offs = np.asarray(col.offsets).astype(np.int64)
    n = np.diff(offs)
    flat = np.asarray(col.flatten())
    dim = max(int(n.max()) if len(n) else 0, dim or 0)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), flat.dtype)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], n)] = flat
    return out


class Shard:
    """Sorted lists of one shard: per dimension the rows by component, falling."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs = ids, vecs
        self.order = np.argsort(-vecs, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vecs, self.order, axis=0)

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of every row that may be among the k best.

        ``floor``: per query a score that k rows are known to reach.
        """
        n, dim = self.vecs.shape
        # 32-bit floats are exact for integers as long as no sum reaches 2^24
        most = np.abs(q).max(initial=0) * 2.0 * np.abs(self.sorted).max(initial=0) * dim
        kind = np.float32 if most < 1 << 24 else np.float64
        slack = 0.5 if most < EXACT else 0.5 + most * dim * 2.0 ** -50  # of the bounds; scores are whole numbers
        up, down = np.maximum(q, 0).T.astype(kind), np.maximum(-q, 0).T.astype(kind)  # component, query
        lists = self.sorted.astype(kind)
        head, tail = lists[0], lists[-1]
        # the smallest summands: the far end of each list
        worst = tail @ up - head @ down
        got = np.zeros((n, len(qid)), kind)  # summands read, above the smallest possible
        top, low = np.zeros((n, dim), bool), np.zeros((n, dim), bool)  # read from the top, from the bottom
        alive, floor, own = np.arange(len(qid)), np.asarray(floor, np.float64), self.ids[:, None] == qid[None, :]
        depth, step, out = 0, max(1, int(n * FIRST_READ)), []
        while len(alive):
            end = min(n, depth + step)
            for d in range(dim):
                hi, lo = self.order[depth:end, d], self.order[n - end:n - depth, d]
                top[hi, d] = True
                low[lo, d] = True
                # a query reads a list from one end: its factor for the other one is 0
                got[hi] += np.multiply.outer(lists[depth:end, d] - tail[d], up[d])
                got[lo] += np.multiply.outer(head[d] - lists[n - end:n - depth, d], down[d])
            depth, step = end, end
            lower = got + worst
            upper = lower
            if depth < n:  # what an unread summand can still add: the reading front
                upper = (lower + (~top).astype(kind) @ ((lists[depth] - tail)[:, None] * up)
                         + (~low).astype(kind) @ ((head - lists[n - depth - 1])[:, None] * down))
            lower = np.where(own, kind(-np.inf), lower)
            kth = np.partition(lower.T, n - k, axis=1)[:, n - k] if n > k else np.full(len(alive), -np.inf)
            left = (upper >= np.maximum(kth, floor) - slack) & ~own
            done = (left.sum(0) <= SETTLE) | (depth >= n)
            rows, cols = np.nonzero(left[:, done])
            pos = alive[done][cols]
            for a in range(0, len(pos), 1 << 16):  # resolve the final scores
                p, c = pos[a:a + (1 << 16)], rows[a:a + (1 << 16)]
                out.append((p, self.ids[c], exact_scores(qid[p], q[p], self.ids[c], self.vecs[c])))
            if done.any():
                keep = ~done
                alive, floor, worst = alive[keep], floor[keep], worst[keep]
                got, own, up, down = got[:, keep], own[:, keep], up[:, keep], down[:, keep]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def best(pos: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query position, by (score falling, id)."""
    o = np.lexsort((ids, -score, pos))
    pos, ids, score = pos[o], ids[o], score[o]
    if len(pos):
        start = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        rank = np.arange(len(pos)) - np.repeat(start, np.diff(np.append(start, len(pos))))
        pos, ids, score = pos[rank < k], ids[rank < k], score[rank < k]
    return pos, ids, score


def search_group(shards: list[Shard], qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k best rows of a group for one query block; a shard knows the k-th score of those before."""
    pos, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = np.full(len(qid), -np.inf)
    for s in shards:
        p, i, c = s.search(qid, q, floor, k)
        pos, ids, score = best(np.concatenate([pos, p]), np.concatenate([ids, i]), np.concatenate([score, c]), k)
        full = np.bincount(pos, minlength=len(qid)) >= k
        low = np.full(len(qid), np.inf)
        np.minimum.at(low, pos, score.astype(np.float64))
        floor = np.where(full, low, -np.inf)
    return pos, ids, score


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", every: int = EVERY, k: int = K,
          query_rows: int = QUERY_ROWS, group_cells: int = GROUP_CELLS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows of all others
    for each row whose id is divisible by ``every``."""
    v = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantise(F.col(vec), name=F.col(vec_id)).alias("v"))
         .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()))
    v = freeze(v, "nra-vectors")
    c = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("d")).first()
    dim = c["d"] or 0
    shard_rows = max(1, shard_cells // max(dim, 1))
    # groups of bounded size; with few rows, smaller ones so that all cores have work
    cells = c["n"] * dim
    groups = max(1, -(-cells // group_cells), min(-(-cells // shard_cells), 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    blocks = max(1, -(-c["q"] // query_rows))
    # kind 0: rows of a group; kind 1: query blocks, one row per block and group
    rows = v.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).alias("g"), F.lit(0).alias("kind"),
                    F.array("vec_id").alias("ids"), "v")
    q = (v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
         .groupBy(F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(blocks)).alias("b"))
         .agg(F.collect_list(F.struct("vec_id", "v")).alias("m"))
         .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"),
                 F.col("m.vec_id").alias("ids"),
                 # rows of equal length, so that a block is one flat array
                 F.flatten(F.transform("m.v", lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(x))))).alias("v")))
    # by range: a group a task, without hash collisions
    both = rows.unionByName(q).repartitionByRange(groups, "g").sortWithinPartitions("g", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"g": None, "ids": [], "vecs": [], "shards": None}

        def built() -> list[Shard]:
            if state["shards"] is None:
                ids = np.concatenate(state["ids"]) if state["ids"] else np.zeros(0, np.int64)
                vecs = np.concatenate(state["vecs"]) if state["vecs"] else np.zeros((0, dim), np.int64)
                if np.abs(vecs).max(initial=0) < 1 << 31:
                    vecs = vecs.astype(np.int32)
                state["shards"] = [Shard(ids[a:a + shard_rows], vecs[a:a + shard_rows]) for a in range(0, len(ids), shard_rows)]
                state["ids"], state["vecs"] = [], []
            return state["shards"]

        for batch in batches:
            g, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if g[a] != state["g"]:
                    state = {"g": g[a], "ids": [], "vecs": [], "shards": None}
                if kind[a] == 0:
                    state["ids"].append(np.asarray(part.column(2).flatten()))
                    state["vecs"].append(_dense(part.column(3), dim))
                    continue
                for i in range(part.num_rows):
                    qid = np.asarray(part.column(2)[i].values)
                    q = np.asarray(part.column(3)[i].values).reshape(len(qid), dim)
                    pos, ids, score = search_group(built(), qid, q, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[pos]), pa.array(pos.astype(np.int64)), pa.array(ids), pa.array(score)],
                                                     names=["query_id", "row", "vec_id", "score"])

    hits = both.mapInArrow(run, "query_id long, row long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
