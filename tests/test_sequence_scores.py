"""Positions of the packed blocks stay in their rows: draws, masks, scores and losses without a row per position."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ranksmith.functions.det import position_uniforms, u01
from ranksmith.operators import pretrain as PT

LOGITS = "seq string, labels array<int>, logits array<struct<tokens: array<int>, scores: array<double>>>"


def test_position_uniforms_are_the_md5_uniforms():
    keys = pa.array(["11:0:5:m", "é" * 10, "", "x" * 60])  # the last one takes more than a block
    row, pos = np.repeat(np.arange(4), 1100), np.tile(np.arange(1100), 4)
    for end in ("", "2"):
        for some in (row >= 0, row < 3):
            text = [f"{keys[int(r)].as_py()}:{p}" + (f":{end}" if end else "") for r, p in zip(row[some], pos[some])]
            assert position_uniforms(keys, row[some], pos[some], end).tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) / 2 ** 32 for t in text]


def test_masks_equal_the_column_uniforms(spark):
    rows = [(1, 0, list(range(5, 305))), (1, 1, []), (2, 0, None), (2, 7, [3, None, 40, 50])]
    b = spark.createDataFrame(rows, "batch_no long, block_no long, ids array<int>")
    hit = lambda x, i: (x >= PT.N_SPECIAL) & (u01(F.lit(11), F.col("batch_no"), F.col("block_no"), F.lit("m"), i) < 0.2)
    want = b.select("batch_no", "block_no", F.transform("ids", lambda x, i: F.when(hit(x, i), x).otherwise(F.lit(-100))).alias("labels"),
                    F.transform("ids", lambda x, i: F.when(hit(x, i), F.lit(1)).otherwise(x)).alias("inputs"))
    got = PT.mask_full(b, 0.2, 11).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_token_ids_by_batches_equal_the_column(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["", "  ", None, "a b  a\x85c\x1c\x0bd", " x", "é é e", "one"])], "idx int, line string")
    want = d.select("idx", PT.token_ids(PT.tokens("line")).alias("ids"))
    assert sorted(PT.with_token_ids(d).select("idx", "ids").collect()) == sorted(want.collect())


def test_scores_of_sequences_are_not_shuffled(spark):
    c = lambda *p: {"tokens": [t for t, _ in p], "scores": [s for _, s in p]}
    rows = [("a", [7, 5, -100, 9], [c((5, 1.0), (6, 0.0)), c((1, 0.0)), c((3, 2.0))]), ("b", [-100], [])]
    d = spark.createDataFrame(rows, LOGITS)
    loss = PT.masked_loss(d)
    assert "Exchange" not in loss._jdf.queryExecution().executedPlan().toString()
    assert {(r.seq, r.pos): r.loss for r in loss.collect()} == {("a", 0): math.log(math.exp(1) + 1) - 1, ("a", 2): math.inf}
    got = PT.masked_accuracy(PT.argmax_token(d)).first()
    assert (got.accuracy, got.n) == (0.5, 2)
    assert PT.perplexity(loss.where("pos = 0"), n="n").first().n == 1


def test_packing_moves_each_row_once(spark):
    d = spark.createDataFrame([(i, [i] * (i % 4)) for i in range(40)], "idx long, ids array<int>")
    b = PT.pack(d, 3, batch_rows=10)
    assert b._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for n in range(4):
        flat = [i for i in range(n * 10, n * 10 + 10) for _ in range(i % 4)]
        got = {r.block_no: r.ids for r in b.where(F.col("batch_no") == n).collect()}
        assert got == {k: flat[3 * k:3 * k + 3] for k in range(len(flat) // 3)}
