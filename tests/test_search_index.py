"""Exact top-k (F1): rounds, the pruning index, and vectors that take no part."""

import numpy as np
import pytest

from ranksmith.operators.search import build_index, exact_topk, pruning_report

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute(queries, corpus, k):
    out = []
    for qid, q in queries:
        if qid is not None and ok(q):
            best = sorted((-round(float(np.dot(q, c)), 6), did) for did, c in corpus if did is not None and ok(c))[:k]
            out += [(qid, rank, did, -s) for rank, (s, did) in enumerate(best, 1)]
    return sorted(out)


def rows(df):
    return sorted((r.qid, r.rank, r.did, round(r.score, 6)) for r in df.collect())


def clustered(rng, n, dim=8, centers=20):
    c = rng.normal(size=(centers, dim)) * 4
    return [(int(i), (c[i % centers] + rng.normal(size=dim) * 0.1).round(2).tolist()) for i in range(n)]


@pytest.mark.parametrize("indexed", [False, True])
@pytest.mark.parametrize("round_bytes", [None, 200])
def test_hostile_vectors_take_no_part(spark, indexed, round_bytes):
    good = clustered(np.random.default_rng(1), 60, dim=3)
    bad = [(100, None), (101, [NAN, 1.0, 2.0]), (102, [1.0, None, 2.0]), (103, [INF, 0.0, 0.0]), (104, [-INF, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (105, [])]
    corpus = good + bad + [(7, good[7][1]), (200, good[7][1]), (201, [0.0, 0.0, 0.0])]  # a repeated id, an equal vector, a zero vector
    queries = good[:9] + bad + [(3, good[3][1])]
    c = frame(spark, corpus, "did").repartition(4)
    got = rows(exact_topk(frame(spark, queries, "qid"), build_index(c, block_cells=12) if indexed else c, 5, round_bytes=round_bytes))
    assert got == brute(queries, corpus, 5)


def test_index_skips_blocks_and_loses_nothing(spark):
    data = clustered(np.random.default_rng(2), 3000)
    queries = data[:40]
    c, q = frame(spark, data, "did").repartition(5), frame(spark, queries, "qid")
    index = build_index(c, block_cells=8 * 32)
    assert sorted(r.did for r in index.rows.select("did").collect()) == [d for d, _ in data]  # every row is in it
    assert rows(exact_topk(q, index, 10)) == brute(queries, data, 10)
    r = pruning_report(q, index, 10).first()
    blocks = index.rows.select("block").distinct().count()
    assert r.pairs >= len(queries) * blocks and r.skipped / r.pairs > 0.8
    for b in index.rows.groupBy("block").count().collect():
        assert b["count"] <= index.block_rows


def test_a_hot_pivot_is_many_blocks(spark):
    """A third of all rows with one vector: its blocks stay bounded, ties go to the smaller id."""
    data = clustered(np.random.default_rng(3), 400) + [(1000 + i, [1.0] * 8) for i in range(200)]
    queries = [(1, [1.0] * 8), (2, [-1.0] * 8), (3, [0.0] * 8)]
    index = build_index(frame(spark, data, "did"), block_cells=8 * 16)
    assert max(r["count"] for r in index.rows.groupBy("block").count().collect()) <= 16
    assert rows(exact_topk(frame(spark, queries, "qid"), index, 7)) == brute(queries, data, 7)


def test_empty_sides_and_small_corpus(spark):
    some, none = clustered(np.random.default_rng(4), 4), []
    for data, queries in ((none, some), (some, none), (some, some)):
        c, q = frame(spark, data, "did"), frame(spark, queries, "qid")
        assert rows(exact_topk(q, c, 10)) == brute(queries, data, 10)
        assert rows(exact_topk(q, build_index(c), 10)) == brute(queries, data, 10)


def test_unequal_lengths_raise(spark):
    c = frame(spark, [(1, [1.0, 2.0]), (2, [1.0])], "did")
    with pytest.raises(Exception, match="unequal length|components"):
        exact_topk(frame(spark, [(1, [1.0, 2.0])], "qid"), c, 1).collect()


def test_the_corpus_is_not_moved(spark):
    c, q = frame(spark, clustered(np.random.default_rng(5), 100), "did"), frame(spark, clustered(np.random.default_rng(6), 9), "qid")
    plan = exact_topk(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan  # only hits are shuffled
