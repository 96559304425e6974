"""The vector store by hash prefix, and pooling by vector sums."""
import hashlib

import pytest

from ranksmith.operators import embed as EM
from ranksmith.session import shared_path

ROWS = [("m", "007", f"text {i}") for i in range(40)] + [("m", None, "text 1"), ("m", None, "text 1"), ("n", "007", "text 1"), ("m", "007", None), ("m", "007", "")]
SCHEMA = "model string, suite string, text string"


def encode(df):
    return EM.hash_encode(df, "content_md5", "text", 8)


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def test_each_text_is_encoded_and_kept_once(spark):
    path, seen = shared_path(spark, "store"), []

    def counting(df):
        seen.append(df.count())
        return encode(df)

    texts = spark.createDataFrame(ROWS, SCHEMA)
    EM.embed_into_store(texts.where("text < 'text 2'"), path, counting)
    out = EM.embed_into_store(texts, path, counting)
    want = sorted({(m, s or "", md5(t)) for m, s, t in ROWS if t is not None})
    assert sorted((r.model, r.suite or "", r.content_md5) for r in out.collect()) == want
    assert EM.embed_into_store(texts, path, counting).count() == EM.read_store(spark, path).count() == len(want)
    early = len({t for _, _, t in ROWS if t is not None and t < "text 2"})
    assert seen == [early, 41 - early, 0]
    assert EM.check_store(texts, path).count() == 0


def test_only_touched_folders_are_read(spark):
    path = shared_path(spark, "store")
    texts = spark.createDataFrame(ROWS, SCHEMA)
    assert EM.read_store(spark, path).count() == 0
    EM.embed_into_store(texts, path, encode)
    todo = spark.createDataFrame([("m", "007", md5("text 3")), ("m", "007", md5("nothing"))], "model string, suite string, content_md5 string")
    hit = EM.touched(EM.read_store(spark, path), todo)
    prefixes = {md5("text 3")[:2], md5("nothing")[:2]}
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "DataFilters: []" in plan and all(p in filters for p in (*prefixes, "007"))
    assert {r.prefix for r in hit.collect()} <= prefixes
    missing = EM.missing_in_store(todo, path)
    assert [r.content_md5 for r in missing.collect()] == [md5("nothing")]
    assert EM.missing_in_store(todo, path, rebuild=True).count() == 2


def test_a_vector_that_is_lost_is_reported(spark):
    path = shared_path(spark, "store")
    texts = spark.createDataFrame(ROWS, SCHEMA)
    EM.embed_into_store(texts.where("text <> 'text 1'"), path, encode)
    assert sorted(map(tuple, EM.check_store(texts, path).collect()), key=str) == [("m", "007", 41, 40), ("m", None, 1, 0), ("n", "007", 1, 0)]


def test_pool_mean_by_vector_sums(spark):
    states = spark.createDataFrame([(1, 0, 1, [1.0, None, None]), (1, 1, 1, [2.0, 5.0, None]), (1, 2, 0, [9.0, 9.0, 9.0]), (2, 0, 1, [4.0]), (3, 0, 0, [4.0]), (4, 0, 1, None)],
                                   "text_id int, pos int, mask int, state array<float>")
    assert {r.text_id: r.pooled for r in EM.pool_mean_vector(states).collect()} == {1: [1.5, 5.0, None], 2: [4.0]}
    plan = EM.pool_mean(states)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # printed from the end: the explode comes after the shuffle
    with pytest.raises(Exception):
        EM.pool_mean_vector(spark.createDataFrame([(1, 1, [1.0]), (1, 1, [1.0, 2.0])], "text_id int, mask int, state array<double>").coalesce(1)).collect()
