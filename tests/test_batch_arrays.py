"""Losses from the block product of a batch, against the table of all its pairs."""
import math

import numpy as np
import pytest

from ranksmith.operators import losses as L
from ranksmith.operators.search import similarity

N_RANK, N_SLOT, N_OWN, DIM = 2, 5, 3, 4
Q_SCHEMA = "batch string, q_rank int, q_slot int, q_vec array<double>"
P_SCHEMA = "batch string, p_rank int, p_slot int, j int, p_vec array<double>"


@pytest.fixture(scope="module")
def batches(spark):
    rng = np.random.default_rng(5)
    vec = lambda: [float(x) for x in rng.normal(size=DIM)]
    q = [(b, r, s, vec()) for b in ("a", "b") for r in range(N_RANK) for s in range(N_SLOT)]
    p = [(b, r, s, j, vec()) for b in ("a", "b") for r in range(N_RANK) for s in range(N_SLOT) for j in range(N_OWN)]
    t = [(b, r, s, j, float(rng.random())) for b, r, s, j, _ in p]
    return (spark.createDataFrame(q, Q_SCHEMA), spark.createDataFrame(p, P_SCHEMA),
            spark.createDataFrame(t, "batch string, rank int, slot int, j int, t double"))


def losses(frame):
    return {(r.batch, r.q_rank, r.q_slot): r.loss for r in frame.collect()}


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_every_loss_equals_the_one_from_pairs(batches, block):
    q, p, t = batches
    pairs = similarity(q, p, ["batch"], 0.01).select("batch", "q_rank", "q_slot", "p_rank", "p_slot", "j", "score")
    arrays = L.batch_arrays(q, p, 0.01, block=block).cache()
    assert arrays.count() == 2 * N_RANK * N_SLOT
    for f in (L.loss_group, L.loss_in_batch, L.loss_cross_device):
        assert losses(f(arrays)) == pytest.approx(losses(f(pairs)), abs=1e-8)
    assert losses(L.kd_kl(arrays, t)) == pytest.approx(losses(L.kd_kl(pairs, t)), abs=1e-8)
    for scope in L.SCOPES:
        assert losses(L.kd_progressive(arrays, t, scope)) == pytest.approx(losses(L.kd_progressive(pairs, t, scope)), abs=1e-8)


def test_no_row_per_pair_in_the_plan(batches):
    plan = L.loss_cross_device(L.batch_arrays(*batches[:2]))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroups" in plan


def test_large_scores_null_vectors_and_missing_sides(spark):
    q = spark.createDataFrame([("a", 0, 0, [1.0]), ("a", 0, 1, [1.0]), ("a", 0, 2, None), ("q", 0, 0, [1.0])], Q_SCHEMA)
    p = spark.createDataFrame([("a", 0, 0, 0, [2000.0]), ("a", 0, 0, 1, [1999.0]), ("a", 0, 1, 0, [-2000.0]), ("a", 0, 1, 1, None), ("p", 0, 0, 0, [1.0])], P_SCHEMA)
    rows = {(r.batch, r.q_slot): r for r in L.batch_arrays(q, p).collect()}
    assert set(rows) == {("a", 0), ("a", 1)}
    assert rows["a", 0].own == [2000.0, 1999.0] and rows["a", 0].rank_rest == [-2000.0] and rows["a", 0].step_rest == []
    assert rows["a", 1].rank_rest == [pytest.approx(2000 + math.log(1 + math.exp(-1)))]
    assert L.batch_arrays(q.limit(0), p.limit(0)).count() == 0


def test_vectors_of_different_lengths_raise(spark):
    q = spark.createDataFrame([("a", 0, 0, [1.0])], Q_SCHEMA)
    p = spark.createDataFrame([("a", 0, 0, 0, [1.0]), ("a", 0, 0, 1, [1.0, 2.0])], P_SCHEMA)
    with pytest.raises(Exception, match="different lengths"):
        L.batch_arrays(q, p).collect()
