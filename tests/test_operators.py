import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from ranksmith.operators.corpus import contains_join, ordered_index
from ranksmith.operators.search import exact_topk
from ranksmith.plans import views as V


def test_ordered_index_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v")).repartition(13)
    ix = ordered_index(df, ["k"]).collect()
    pairs = sorted((r["idx"], r["k"]) for r in ix)
    assert [p[0] for p in pairs] == list(range(5000))
    assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)


def brute_topk(q, c, k):
    out = {}
    for qid, qv in q:
        s = sorted(((round(float(np.dot(np.asarray(qv, float), np.asarray(cv, float))), 6), did) for did, cv in c),
                   key=lambda x: (-x[0], x[1]))[:k]
        out[qid] = [d for _, d in s]
    return out


def test_topk_matches_brute_force(spark):
    q = V.q_vec(spark, SF001)
    c = V.c_vec(spark, SF001)
    got = exact_topk(q, c, 10).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        res.setdefault(r["qid"], []).append(r["did"])
    exp = brute_topk([(r["qid"], r["embedding"]) for r in q.collect()],
                     [(r["did"], r["embedding"]) for r in c.collect()], 10)
    assert res == exp


def test_topk_k_above_corpus(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    c = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.5, 0.5])], "did long, embedding array<double>")
    got = [(r["rank"], r["did"]) for r in exact_topk(q, c, 10).orderBy("rank").collect()]
    assert got == [(1, 5), (2, 6)]


def test_contains_join_brute_force(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text")
    got = {(r[0], r[1]) for r in contains_join(d, b, doc_id="doc_id", doc_text="text",
                                                 pat_id="item_id", pat_text="text").collect()}
    docs, pats = d.collect(), b.collect()
    exp = {(x["doc_id"], p["item_id"]) for x in docs for p in pats if p["text"] in x["text"]}
    assert got == exp and len(exp) > 0


def test_train_pairs_invariants(spark):
    p = V.train_pairs(spark, SF001).collect()
    for r in p:
        conv = r["row_id"] // 1000
        assert 1 <= len(r["neg"]) <= 1 + conv % 12
        assert len(r["neg"]) == len(r["neg_scores"])


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"model", "search_task", "NDCG@10"}
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
