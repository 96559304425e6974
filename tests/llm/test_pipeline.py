import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from ranksmith.llm import quality, simhash, toxicity
from ranksmith.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "mixing sources to target weights",
                                        "SentencePiece encoding and decoding"]


def test_each_stage_on_its_own_input(spark):
    import hashlib
    import sentencepiece
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    kept = P.quality_stage(spark, docs, sf)
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    assert ids(kept) == sorted(r.doc_id for r in scored.collect() if r.score >= quality.KEEP)

    kept2 = P.toxicity_stage(spark, kept, sf)
    scored = toxicity.score_documents(kept, toxicity.fit(kept, labels))
    assert ids(kept2) == sorted(r.doc_id for r in scored.collect() if r.score < toxicity.SPAN)

    kept3 = P.simhash_stage(spark, kept2, sf)
    comp = {r.component_id for r in simhash.near_duplicates(kept2).collect()}
    assert ids(kept3) == sorted(comp) and kept3.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in kept3.collect())

    mixed = P.mixing_stage(spark, kept3, sf)
    n = collections.Counter(ids(mixed))
    assert max(n.values()) <= 2 and set(n) <= set(ids(kept3)) and mixed.columns == docs.columns

    out = P.sentencepiece_stage(spark, mixed, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert collections.Counter(r.doc_id for r in out) == n
    for r in out[:100]:
        e = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()


def test_keep_one_with_odd_rows(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "a b c d"), (None, None), (9, "q r s t u"), (9, "q r s t u"),
            (8, "v w x y z 1 2 3"), (8, "other text of the same id entirely")]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, fp int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 3), (False, 8), (False, 9), (True, 0), (True, 0)]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = docs.limit(30).unionByName(docs.limit(3)).withColumn("score", F.lit(1)).unionByName(
        spark.createDataFrame([(None, None, None, None, None, 1), (77_777, "", "en", None, 0, 2)], "doc_id long, text string, lang string, source string, n_chars long, score int"))
    for name, d in (("odd", odd), ("empty", docs.limit(0))):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = P.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() > 0) == (name == "odd")


def test_columns_with_working_names_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["__quality", "__toxic", "__id", "__rk", "__copy", "__mix_source", "__mix_rate", "__mix_copy", "component_id", "rate"]
    odd = docs.withColumns({n: F.col("doc_id") * 10 + i for i, n in enumerate(names)})
    for _, stage in P.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.columns == [*docs.columns, *names]
    rows = odd.collect()
    assert rows and all(r[n] == r.doc_id * 10 + i for r in rows for i, n in enumerate(names))
