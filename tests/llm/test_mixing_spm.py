import hashlib

import pytest
from pyspark.sql import functions as F

from ranksmith.llm import mixing, spm
from ranksmith.llm.queries import tokenizer_path


def fill(sizes, weights, total, most=2.0):
    """Reshare the excess of capped sources by weight until none is above."""
    target, capped = {k: 0.0 for k in sizes}, set()
    while True:
        free = [k for k in sizes if k not in capped]
        left = total - sum(most * sizes[k] for k in capped)
        w = sum(weights[k] for k in free)
        target = {k: most * sizes[k] if k in capped else left * weights[k] / w for k in sizes}
        over = [k for k in free if target[k] > most * sizes[k]]
        if not over:
            return target
        capped |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, "d": 400}, {"x": 5}, {"a": 0, "b": 7, "c": 7},
                                   {"a": 1, "b": 1, "c": 1000, "d": 1, "e": 9, "f": 70, None: 30}])
def test_targets_reshare_until_none_is_above(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    want = fill(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert got == pytest.approx(want)


def test_mix_plan_and_documents(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 4}") for i in range(400)]
    rows += [(1000, None, "s0"), (1001, " \n ", None), (1002, "a b", None), (None, "a\x0bb c", "s1"), (5, "dup", "s1"), (5, "dup", "s1")]
    df = spark.createDataFrame([(*r, "en", 3, 0.5) for r in rows],
                               "doc_id long, text string, source string, lang string, size int, rate double")
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in plan)
    by = {}
    for r in plan:
        t = by.setdefault(r.source_size, [r.target, 0])
        t[1] += r.taken
    assert all(abs(a - b) < 0.25 * a + 5 for a, b in by.values())
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    taken = sum(r.copies for r in plan)
    assert out.count() == taken
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(df.repartition(3)).collect()))
    assert mixing.mix_plan(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_word_count(spark):
    cases = {"": 0, None: 0, " a  b\n": 2, "\t\x0b\x0c\r": 0, "a b c": 2, "x" * 100_000: 1, "　": 1}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, n long")
    assert df.where(mixing.word_count("text") != F.col("n")).count() == 0


def test_encode_matches_the_library(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    sp = spm.load(path)
    texts = [None, "", " ", "   ", "a", " a", "a ", "  a  b ", "▁a▁ ▁", "x" * 3000, "é\x00漢 😀\n\n b", " " * 300,
             "<s> </s>", "w " * 30_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        (F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("n_tokens"), F.lit("x").alias("ids"))
    docs = docs.unionByName(more)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r.doc_id: sp.encode(r.text or "") for r in docs.collect()}
    got = spm.encode(docs, path, with_ids=True).collect()
    assert len(got) == len(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids)))
        assert r.decoded_sha256 == sha(sp.decode(ids) if ids else "") and r.decoded == (sp.decode(ids) if ids else "")
    assert spm.encode(docs.limit(0), path).count() == 0


def test_table_restarts_and_fallback():
    import pyarrow as pa
    sp = spm.load(tokenizer_path("piece_bpe_32k.model"))
    assert spm.chunkable(sp)
    texts = pa.array([f"w{i} q{i}  z" for i in range(200)])
    small = [x[1] for a in range(0, 200, 10) for x in spm.encode_texts(sp, texts[a:a + 10], spm.ChunkTable(sp, 15))]
    assert small == [x[1] for x in spm.encode_texts(sp, texts, None)]
