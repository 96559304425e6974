import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import nra, pq
from ranksmith.llm import queries as Q


def brute_topk(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -c) for r, (c, j) in enumerate(s)]
    return sorted(out)


def _frame(spark, rows, extra=True):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_topk_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2, 3, 6) / 4)]) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (None, [1.0] * 6),
             (1200, [0.0] * 6)]
    df = _frame(spark, rows)
    want = brute_topk(rows)
    for cells in (1 << 22, 600):
        got = nra.top_k(df, group_cells=cells, shard_cells=cells // 4, query_rows=3).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert nra.top_k(df.limit(0)).count() == 0
    few = _frame(spark, rows[:3])
    assert nra.top_k(few).count() == 2


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-9, 10, 4) / 4).tolist()) for i in range(120)]
    rows += [(200, [40000.0, 1.0, 0.0, 0.0]), (203, [50000.0, 0.0, 0.0, 0.0]), (204, [45000.0, 2.0, 0.0, 0.0]), (250, [-1e5, 1e5, 3.0, 0.5]), (251, [1e5, -1e5, 0.25, 7.0]),
             (300, [1e9, 0.0, 0.0, 1.0]), (301, [0.0, 1e9, 0.5, 0.0]), (350, [0.0, 0.0, 1e9, 1e5])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    vec = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for i in vec:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(vec[i], vec[j])), j) for j in vec if j != i)[:5]
            want += [(i, r + 1, j, -c) for r, (c, j) in enumerate(s)]
    for cells in (1 << 22, 200):
        got = nra.top_k(df, group_cells=cells, shard_cells=cells // 4, query_rows=3).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    sql = duckdb.connect()
    sql.register("embeddings", df.toPandas())
    assert sorted(sql.execute(Q.ORACLE["op1_exact_topk"]).fetchall()) == sorted((q, r, i, c) for q, r, i, c in want)


def test_topk_scores_beyond_a_long_raise(spark):
    schema = "vec_id long, embedding array<double>"
    for rows, words in (([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "rows 0 and 1"), ([(0, [1.0]), (77, [1e30])], "row 77")):
        with pytest.raises(Exception, match=words):
            nra.top_k(spark.createDataFrame(rows, schema)).collect()


def test_topk_reads_only_part_of_the_lists():
    """The bounds stop the reading before the lists' end on graded data."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.standard_normal((2000, 8)) * np.geomspace(1, 0.01, 8)).astype(np.int32)
    s = nra.Shard(np.arange(2000), v)
    pos, ids, score = s.search(np.array([0, 50]), v[[0, 50]], np.full(2, -np.inf), 5)
    assert len(ids) <= 2 * nra.SETTLE
    for q in (0, 1):
        want = sorted((-int(v[50 * q] @ v[j]), j) for j in range(2000) if j != 50 * q)[:5]
        _, i, c = nra.best(pos[pos == q], ids[pos == q], score[pos == q], 5)
        assert [(-int(a), int(b)) for a, b in zip(c, i)] == want


def brute_near(rows, t=0.95):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    x = [np.array(v, float) if o else None for (_, v), o in zip(rows, ok)]
    n, link = len(rows), [set() for _ in rows]
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= t:
                link[a].add(b)
    comp = list(ids)
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in link[a]:
                if comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return sorted((ids[a], len(link[a]), comp[a], comp[a] == ids[a]) for a in range(n) if ids[a] is not None)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, base = [], rng.standard_normal((40, 16))
    for i in range(500):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2, 0.35, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(900, [0.0] * 16), (901, None), (902, [None] * 16), (903, [float("nan")] * 16), (904, [1e30] * 16), (905, [2e30] * 16), (906, [])]
    df = _frame(spark, rows + [(None, [1.0] * 16)])
    want = brute_near(rows)
    for kw in ({}, {"list_rows": 20, "block_rows": 7, "sample": 200}):
        got = pq.near_duplicates(df, **kw).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == want
        assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert pq.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.near_duplicates(df, list_rows=32).collect())
    assert got == brute_near(rows)


def test_probe_rule_is_sufficient():
    """Every pair within the radius meets in a list."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 12))
    x[300:] = x[:300] + rng.standard_normal((300, 12)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = float(np.sqrt(0.1))
    ix = pq.train(x, 24, 4, 16, r)
    at = pq.nearest(x, ix.centres)
    probes = ix.probes(x, at)
    probes[np.arange(600), at] = True
    a, b = np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= r)
    assert all(probes[i, at[j]] or probes[j, at[i]] for i, j in zip(a, b))
    codes, rest = ix.encode(x, at)
    assert len(codes) == 600 and (rest >= 0).all()


def test_links_of_a_hot_list_leave_the_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pq, "HELD", 50)
    monkeypatch.setattr(pq, "PROBE_ROWS", 20)
    rng = np.random.default_rng(3)
    x = 1 + 0.05 * rng.standard_normal((120, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    classes = df.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v"), F.lit(1).cast("long").alias("m")).select("v", "rep", "m")
    near = x / np.linalg.norm(x, axis=1)[:, None]
    near = near @ near.T >= 0.95
    got = pq._links(classes, 120, 8, float(np.sqrt(2 - 2 * 0.95)), 0.95, 120, 1000, 4, 4, 16, 40).collect()
    extra = {}
    for r in got:
        if r.kind == 0:
            extra[r.a] = extra.get(r.a, 0) + r.b
    assert extra == {i: int(n) - 1 for i, n in enumerate(near.sum(1)) if n > 1}
    # a forest over the classes has fewer links than classes, in each of three blocks; only parts give more
    assert sum(r.kind == 1 for r in got) > 3 * len(extra)
