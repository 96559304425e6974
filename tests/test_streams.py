"""Streams (S1-S3): real streams that stop, start again and repeat an epoch without changing the result."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranksmith.operators import embed as EM
from ranksmith.operators import pretrain as PT
from ranksmith.streaming import streams as S

DOCS = "model string, suite string, text string"


def add_files(spark, folder, rows, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], DOCS).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, per_batch=1):
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", per_batch).parquet(folder)


def failing(encode, at):
    """An encoder that fails on its ``at``-th call."""
    calls = []

    def run(df, *a):
        calls.append(1)
        if len(calls) == at:
            raise RuntimeError("the executor was lost")
        return encode(df, *a)
    return run


@pytest.mark.parametrize("stop_at", [None, 1, 2])
def test_stream_embed_restarts(spark, tmp_path, stop_at):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [("m", "s" if i % 3 else "t", f"text {i % 8} of words {i % 5}") for i in range(60)]
    add_files(spark, src, rows, 3)
    if stop_at:
        with pytest.raises(Exception, match="lost"):
            S.stream_embed(source(spark, src), store, encode=failing(EM.hash_encode, stop_at))
    S.stream_embed(source(spark, src), store)
    got = spark.read.parquet(store)
    keys = [tuple(r) for r in got.select("model", "suite", "content_md5").collect()]
    want = {tuple(r) for r in spark.createDataFrame(rows, DOCS).select("model", "suite", F.md5("text")).collect()}
    assert len(keys) == len(want) and set(keys) == want  # every text once, whatever was repeated
    assert got.select("epoch_id").distinct().count() > 1
    before = sorted(map(repr, got.collect()))
    S.stream_embed(source(spark, src), store)  # nothing new
    assert sorted(map(repr, spark.read.parquet(store).collect())) == before
    add_files(spark, src, [("m", "s", "new text"), ("m", "s", "text 1 of words 1")], 1)
    S.stream_embed(source(spark, src), store)
    assert spark.read.parquet(store).count() == len(want) + 1


def test_a_repeated_epoch_adds_nothing(spark, tmp_path):
    store, packed = str(tmp_path / "store"), str(tmp_path / "packed")
    a = spark.createDataFrame([("m", "s", f"t{i}") for i in range(9)], DOCS)
    b = spark.createDataFrame([("m", "s", f"t{i}") for i in range(5, 14)], DOCS)
    embed = S.embed_step(store)
    pack = S.pack_step("line", 3, packed, 4, ("no",))
    lines = lambda n: spark.createDataFrame([(i, "a b c d") for i in range(n)], "no long, line string")
    for step, first, second in ((embed, a, b), (pack, lines(10), lines(7))):
        step(first, 0)
        step(second, 1)
    state = lambda p: sorted(map(repr, spark.read.parquet(p).collect()))
    once = state(store), state(packed)
    embed(b, 1)
    pack(lines(7), 1)
    assert (state(store), state(packed)) == once and len(once[0]) == 14


def test_stream_pack_equals_packing_each_micro_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(f * 100 + i, f"w{i} x y z") for i in range(n)] for f, n in enumerate((23, 5, 40))]
    for p in parts:
        spark.createDataFrame(p, "no long, line string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("no long, line string").option("maxFilesPerTrigger", 1).parquet(src)
    S.stream_pack(stream, "line", 7, out, batch_rows=10, order_cols=("no",))
    S.stream_pack(stream, "line", 7, out, batch_rows=10, order_cols=("no",))  # goes on: nothing left
    got = spark.read.parquet(out)
    want = Counter()
    for p in parts:
        ix = PT.with_index(spark.createDataFrame(p, "no long, line string"), ["no"]).withColumn("ids", PT.token_ids(PT.tokens("line")))
        want.update(tuple(r.ids) for r in PT.pack(ix, 7, 10).collect())
    assert Counter(tuple(r.ids) for r in got.collect()) == want
    assert got.select("epoch_id").distinct().count() == 3
