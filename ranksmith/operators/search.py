"""Exact top-k search by dot product.

Plan
----
The corpus stays in place: a task scores its rows against the query vectors
(numpy block matmul, DOUBLE) and hands out the k best hits per query. A final
``row_number() <= k`` window per query merges those; Spark plans it as a
``WindowGroupLimit`` in front of the one shuffle on the query key.

Query vectors are broadcast in rounds of at most ``round_bytes``; a larger query
set means more rounds over the same corpus, never a larger broadcast and
never a copy of the corpus.

``build_index`` arranges a corpus that is searched more than once. Rows are
sorted by their nearest pivot (a bounded sample of the corpus) and the distance to it and
cut into blocks, each with the largest norm and the largest distance from the pivot. For a
query q the rows c of a block around pivot p obey
    q.c <= |q| max|c|            (Cauchy-Schwarz)
    q.c <= q.p + |q| max|c - p|  (triangle),
so a block whose bound is below the k-th score that is known for q cannot hold a hit
and q skips it. The first scores come from a pass in which every query meets only the
blocks of its own nearest pivot.

Scores are rounded to 6 decimals before ranking and ties go to the smaller
corpus id, so the answer does not depend on partitioning, blocks, rounds or
floating-point summation order.

Defined cases: rows whose id or vector is null, or whose vector holds a null,
NaN or infinite component, take no part (on either side); a vector of another
length than the queries' is an error; a repeated id is one candidate per row and, as a
query, one query per row; k above the corpus size returns the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze

#: Query vectors that are broadcast at once, and one [queries x rows] score matrix inside a task. A Python worker holds
#: some three of each, and the hits of the round's queries, however many queries there are.
ROUND_BYTES, SCORE_BLOCK_BYTES = 16 << 20, 8 << 20
#: Components of an index block, and pivots at most.
BLOCK_CELLS, PIVOTS = 1 << 15, 1024

#: ``qn``: place of a query in its round, which tells rows of a repeated id apart.
HITS = "qn long, qid long, did long, score double"


def vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, row numbers) of the vectors of a list column that take part."""
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component reads as NaN
    good = np.isfinite(flat)
    ends = np.cumsum(n)
    bad = np.concatenate([[0], np.cumsum(~good)])
    rows = np.flatnonzero((bad[ends] == bad[ends - n]) & np.asarray(col.is_valid()) & (n > 0))
    dims = np.unique(n[rows])
    if len(dims) > 1:
        raise ValueError(f"vectors of unequal length: {dims[:5].tolist()}")
    if not len(rows):
        return np.zeros((0, 0)), rows
    keep = np.zeros(len(n), bool)
    keep[rows] = True
    return flat[np.repeat(keep, n)].reshape(len(rows), dims[0]), rows


def _first_k(rows: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row number, by (score falling, id)."""
    order = np.lexsort((d, -s, rows))
    rows, d, s = rows[order], d[order], s[order]
    if len(rows) == 0:
        return rows, d, s
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    pos = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = pos < k
    return rows[keep], d[keep], s[keep]


class Best:
    """The k best hits so far of each query of a round, inside one task."""

    def __init__(self, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.k = q, k
        self.rows, self.dids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor.copy()

    def offer(self, mat: np.ndarray, dids: np.ndarray, who: np.ndarray | None = None) -> None:
        """Score the rows of ``mat`` for the queries ``who`` (all)."""
        who = np.arange(len(self.q)) if who is None else who
        if not len(mat) or not len(who):
            return
        if mat.shape[1] != self.q.shape[1]:
            raise ValueError(f"a corpus vector has {mat.shape[1]} components, the queries {self.q.shape[1]}")
        step = max(1, SCORE_BLOCK_BYTES // (8 * len(mat)))
        found = [(self.rows, self.dids, self.scores)]
        for a in range(0, len(who), step):
            w = who[a:a + step]
            sc = self.q[w] @ mat.T
            np.round(sc, 6, out=sc)
            cut = self.floor[w]
            if len(mat) > self.k:
                cut = np.maximum(cut, np.partition(sc, len(mat) - self.k, axis=1)[:, len(mat) - self.k])
            r, c = np.nonzero(sc >= cut[:, None])  # ties with the k-th score stay: the id decides
            found.append((w[r], dids[c], sc[r, c]))
        if all(not len(f[0]) for f in found[1:]):
            return
        self.rows, self.dids, self.scores = _first_k(*(np.concatenate([f[i] for f in found]) for i in range(3)), self.k)
        full = np.bincount(self.rows, minlength=len(self.q)) >= self.k
        low = np.full(len(self.q), np.inf)
        np.minimum.at(low, self.rows, self.scores)
        self.floor = np.where(full, np.maximum(self.floor, low), self.floor)

    def hits(self, qids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.rows), pa.array(qids[self.rows]), pa.array(self.dids), pa.array(self.scores)],
                                         names=["qn", "qid", "did", "score"])


@dataclass
class VectorIndex:
    """Blocks in the shared folder: (block, pivot, reach, norm, did, vec) by block, and the pivots."""

    rows: DataFrame
    pivots: np.ndarray
    block_rows: int


def build_index(corpus: DataFrame, *, did: str = "did", vec: str = "embedding", pivots: int = PIVOTS,
                block_cells: int = BLOCK_CELLS) -> VectorIndex:
    """Arrange a corpus for repeated search. About sqrt(rows) pivots, ``pivots`` at most,
    chosen by the hash of the id; every row is in the index."""
    spark = corpus.sparkSession
    c = corpus.select(F.col(did).cast("long").alias("did"), F.col(vec).cast("array<double>").alias("vec")).where("did is not null")
    size = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, dim = size["n"], max(size["d"] or 1, 1)
    most = max(1, min(pivots, int(n ** 0.5)))
    sample = c.orderBy(F.xxhash64("did"), "did").limit(most).select("vec").toArrow()["vec"]  # ``pivots`` rows at most
    points = vectors(sample.combine_chunks())[0] if n else np.zeros((0, 0))
    points = points if len(points) else np.zeros((1, dim))
    block_rows = max(1, block_cells // dim)
    sent = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        half = (p * p).sum(1) / 2
        for batch in batches:
            mat, rows = vectors(batch.column(1))
            if len(rows) and mat.shape[1] != p.shape[1]:
                raise ValueError(f"vectors of unequal length: {mat.shape[1]}, {p.shape[1]}")
            near = np.concatenate([np.argmin(half - mat[a:a + 4096] @ p.T, axis=1) for a in range(0, len(mat), 4096)] or [np.zeros(0, np.int64)])
            away = np.sqrt(((mat - p[near]) ** 2).sum(1)) if len(rows) else np.zeros(0)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(away), kept.column(0), kept.column(1)],
                                             names=["pivot", "away", "did", "vec"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, held = TaskContext.get().partitionId() << 32, None

        def blocks(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            p = t["pivot"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])).tolist()
            ends = [e for a, b in zip(edges, edges[1:]) for e in [*range(a + block_rows, b, block_rows), b]]
            a = 0
            for e in ends:
                if e == len(p) and not last:  # this block may go on
                    break
                part = t.slice(a, e - a).combine_chunks()
                mat = vectors(part["vec"].combine_chunks() if part["vec"].num_chunks != 1 else part["vec"].chunk(0))[0]
                m = e - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), part["pivot"].combine_chunks(), pa.array(np.full(m, part["away"].to_numpy().max())),
                     pa.array(np.full(m, np.sqrt((mat * mat).sum(1)).max())), part["did"].combine_chunks(), part["vec"].combine_chunks()],
                    names=["block", "pivot", "reach", "norm", "did", "vec"])
                block, a = block + 1, e
            held = t.slice(a) if a < len(p) else None

        for batch in batches:
            t = pa.Table.from_batches([batch])
            yield from blocks(t if held is None else pa.concat_tables([held, t]), False)
        if held is not None:
            yield from blocks(held, True)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (64 * block_rows)))
    dealt = (c.mapInArrow(assign, "pivot int, away double, did long, vec array<double>")
             .repartitionByRange(parts, "pivot", "away", "did").sortWithinPartitions("pivot", "away", "did"))
    rows = dealt.mapInArrow(cut, "block long, pivot int, reach double, norm double, did long, vec array<double>")
    return VectorIndex(freeze(rows, "vector-index"), points, block_rows)


def _scan(corpus: DataFrame, sent, k: int) -> DataFrame:
    """Hits of one round against rows (did, vec)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        best = Best(q, k)
        for batch in batches:
            mat, rows = vectors(batch.column(1))
            best.offer(mat, batch.column(0).to_numpy(zero_copy_only=False)[rows])
        yield best.hits(qids)

    return corpus.mapInArrow(run, HITS)


def _scan_index(index: VectorIndex, sent, k: int, floor=None) -> DataFrame:
    """Hits of one round against the index, and one row without qn per task: did = (query, block)
    pairs met, score = pairs skipped. Without ``floor`` a query meets only its nearest pivot's blocks."""
    spark = index.rows.sparkSession
    pivots = spark.sparkContext.broadcast(index.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qids, q), p = sent.value, pivots.value
        best = Best(q, k, floor.value if floor is not None else None)
        norm = np.sqrt((q * q).sum(1))
        home, pairs, skipped = None, 0, 0
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            if q.shape[1] != p.shape[1]:
                raise ValueError(f"the index has {p.shape[1]} components, the queries {q.shape[1]}")
            if floor is None and home is None:
                home = np.argmin((p * p).sum(1) / 2 - q @ p.T, axis=1)
            block = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                near, reach, most = (batch.column(i)[a].as_py() for i in (1, 2, 3))
                if home is not None:
                    who = np.flatnonzero(home == near)
                else:
                    bound = np.minimum(norm * most, q @ p[near] + norm * reach)
                    # scores are compared rounded; the bound is a float sum
                    who = np.flatnonzero(bound + 1e-6 + 1e-9 * norm * (most + reach) >= best.floor)
                pairs, skipped = pairs + len(q), skipped + len(q) - len(who)
                if len(who):
                    mat, rows = vectors(batch.column(5).slice(a, b - a))
                    best.offer(mat, batch.column(4).to_numpy()[a:b][rows], who)
        yield best.hits(qids)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([pairs]), pa.array([float(skipped)])], names=["qn", "qid", "did", "score"])

    return index.rows.mapInArrow(run, HITS)


def _final_cut(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid", "qn").orderBy(F.col("score").desc(), F.col("did").asc())
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", F.col("rank").cast("long").alias("rank"), "did", "score"))


def _rounds(queries: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ``limit`` bytes of query vectors at a time."""
    first = queries.select(F.size("vec").alias("d")).where("d > 0").first()
    cap = max(1, limit // (8 * (first["d"] if first is not None else 1)))
    t = queries.limit(cap + 1).toArrow()
    if t.num_rows > cap:
        kept = freeze(queries.withColumn("u", F.monotonically_increasing_id()), "topk-queries")
        n = -(-kept.count() // max(1, cap // 2))  # dealt by hash: half full on average, so that none runs over
        rounds = (kept.where(F.pmod(F.xxhash64("u"), F.lit(n)) == i).drop("u").toArrow() for i in range(n))
    else:
        rounds = iter([t])
    for t in rounds:
        mat, rows = vectors(t["vec"].combine_chunks())
        yield t["qid"].to_numpy()[rows], mat


def exact_topk(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int = 10, *, qid: str = "qid", did: str = "did",
               vec: str = "embedding", round_bytes: int | None = None) -> DataFrame:
    """k best corpus rows per query by dot product.

    ``queries(qid LONG, vec ARRAY)``, ``corpus(did LONG, vec ARRAY)`` or an index of it ->
    ``(qid, rank LONG 1..k, did, score DOUBLE)``."""
    return _search(queries, corpus, k, qid, did, vec, round_bytes)[0]


def pruning_report(queries: DataFrame, index: VectorIndex, k: int = 10, *, qid: str = "qid", vec: str = "embedding",
                   round_bytes: int | None = None) -> DataFrame:
    """(pairs, skipped): (query, block) pairs of the searches over the index, and those that the bounds spared."""
    return _search(queries, index, k, qid, "did", vec, round_bytes)[1]


def _search(queries, corpus, k, qid, did, vec, round_bytes) -> tuple[DataFrame, DataFrame | None]:
    spark = queries.sparkSession
    limit = round_bytes or int(spark.conf.get("ranksmith.topk.broadcastBytes", str(ROUND_BYTES)))
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col(vec).alias("vec")).where("qid is not null and vec is not null")
    indexed = isinstance(corpus, VectorIndex)
    c = corpus.rows if indexed else corpus.select(F.col(did).cast("long").alias("did"), F.col(vec).alias("vec")).where("did is not null")
    out = spent = None
    for ids, mat in _rounds(q, limit):
        sent = spark.sparkContext.broadcast((ids.astype(np.int64), mat))
        if not indexed:
            hits = _scan(c, sent, k)
        else:
            first = _scan_index(corpus, sent, k).where("qn is not null")
            w = Window.partitionBy("qn").orderBy(F.col("score").desc())
            kth = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("rank") == k)
            t = kth.select("qn", "score").toArrow()  # one number per query of the round
            floor = np.full(len(ids), -np.inf)
            floor[t["qn"].to_numpy()] = t["score"].to_numpy()
            hits = freeze(_scan_index(corpus, sent, k, spark.sparkContext.broadcast(floor)), "topk-hits")
            seen = hits.where("qn is null").select(F.col("did").alias("pairs"), F.col("score").cast("long").alias("skipped"))
            spent = seen if spent is None else spent.unionByName(seen)
            hits = hits.where("qn is not null")
        one = _final_cut(hits, k)
        out = one if out is None else out.unionByName(one)
    if spent is not None:
        spent = spent.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return out, spent


def similarity(left: DataFrame, right: DataFrame, on: list[str], temperature: float = 1.0,
               lvec: str = "q_vec", rvec: str = "p_vec") -> DataFrame:
    """Dot product / temperature of every left row with every right row that
    shares the keys ``on`` (a batch): all pairs of one batch, never of the
    whole table."""
    from ..functions.vectors import dot
    j = left.join(right, on=on, how="inner")
    return j.withColumn("score", dot(F.col(lvec), F.col(rvec)) / F.lit(temperature))


def hydrate_hits(hits: DataFrame, corpus: DataFrame, idx: str = "idx",
                 cols: tuple[str, ...] = ("did", "passage")) -> DataFrame:
    """Attach passage text and doc id to hit positions, after the cut."""
    side = corpus.select(F.col(idx).alias("did"), *[F.col(x).alias(f"hit_{x}") for x in cols])
    return hits.join(side, on="did", how="left")
