"""J3 with a user tokenizer: flags of special ids through packing and masking."""
import math

import numpy as np
import pytest

from ranksmith.operators import pretrain as PT

TEXTS = [(0, "ab"), (1, ""), (2, None), (3, "héé\t"), (4, "x" * 3000)]


def brute(text, max_len=None):
    b = list((text or "").encode())
    return [256] + (b if max_len is None else b[:max(max_len - 2, 0)]) + [257]


@pytest.mark.parametrize("max_len", [None, 2, 3, 100])
def test_byte_tokenizer_against_plain_python(spark, max_len):
    df = spark.createDataFrame(TEXTS, "idx long, line string").withColumn("_text", PT.F.lit(7))
    got = PT.tokenize(df, PT.byte_tokenizer(), max_len=max_len, batch_rows=2)
    assert got.columns == ["idx", "line", "_text", "ids", "special"]
    for r in got.collect():
        assert r.ids == brute(r.line, max_len) and r._text == 7
        assert r.special == [x >= 256 for x in r.ids]
    assert PT.tokenize(df.limit(0), PT.byte_tokenizer()).count() == 0


def test_packing_keeps_flags_beside_their_ids(spark):
    df = spark.createDataFrame(TEXTS, "idx long, line string")
    blocks = PT.pack(PT.tokenize(df, PT.byte_tokenizer()), 7, batch_rows=3).collect()
    stream = {b: [x for i, t in TEXTS if i // 3 == b for x in brute(t)] for b in (0, 1)}
    for r in blocks:
        assert r.ids == stream[r.batch_no][r.block_no * 7:][:7] and r.special == [x >= 256 for x in r.ids]
    assert len(blocks) == sum(len(s) // 7 for s in stream.values())


def test_special_ids_are_never_masked(spark):
    blocks = PT.pack(PT.tokenize(spark.createDataFrame(TEXTS, "idx long, line string"), PT.byte_tokenizer()), 7, batch_rows=3)
    for m in (PT.mask_full(blocks, 1.0, 1, mask_id=258), PT.mask_default(blocks, 1.0, 1, mask_id=258, vocab=(0, 256))):
        for r in m.collect():
            assert r.labels == [-100 if x >= 256 else x for x in r.ids]  # byte 9 lies below N_SPECIAL and is masked
            assert all(i == x for i, x in zip(r.inputs, r.ids) if x >= 256)


def test_a_wrong_result_raises(spark):
    bad = lambda: lambda texts, max_len: (np.zeros(3, int), np.zeros(2, bool), np.ones(len(texts), int))
    with pytest.raises(Exception, match="tokenizer returned"):
        PT.tokenize(spark.createDataFrame(TEXTS, "idx long, line string"), bad).collect()


def test_masked_loss(spark):
    logits = [("s", 0, t, x) for t, x in ((1, 800.0), (2, 799.0))] + [("s", 1, 1, 0.0), ("s", 2, 1, 5.0)]
    labels = [("s", 0, 9), ("s", 1, 2), ("s", 2, 3), ("s", 3, -100)]
    got = PT.masked_loss(spark.createDataFrame(logits, "seq string, pos long, token int, score double"),
                         spark.createDataFrame(labels, "seq string, pos long, label int")).collect()
    assert {r.pos: r.loss for r in got} == {0: pytest.approx(1 + math.log(1 + math.exp(-1))), 1: math.inf}
