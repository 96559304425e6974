"""Golden values of FIXTURES 3.2 (2 queries, group size 2, one rank)."""
import pytest

from ranksmith.operators import losses as L

S = [[2, 1, 0.5, 0], [0, 1, 1.5, 0.5]]
T = [[0.9, 0.1], [0.6, 0.2]]


@pytest.fixture
def frames(spark):
    rows = []
    for q in range(2):
        for c in range(4):
            rows.append((0, 0, q, 0, c // 2, c % 2, float(S[q][c])))
    scores = spark.createDataFrame(rows, "batch int, q_rank int, q_slot int, p_rank int, p_slot int, j int, score double")
    teacher = spark.createDataFrame([(0, 0, q, j, T[q][j]) for q in range(2) for j in range(2)],
                                    "batch int, rank int, slot int, j int, t double")
    return scores, teacher


def mean(df):
    return sum(r["loss"] for r in df.collect()) / df.count()


def test_teacher_softmax(frames):
    _, t = frames
    got = {(r["slot"], r["j"]): r["tp"] for r in L.teacher_softmax(t).collect()}
    assert got[(0, 0)] == pytest.approx(0.689974, abs=1e-6)
    assert got[(1, 1)] == pytest.approx(0.401312, abs=1e-6)


def test_group_and_in_batch(frames):
    s, _ = frames
    assert mean(L.loss_group(s)) == pytest.approx(0.313262, abs=1e-6)
    assert mean(L.loss_in_batch(s)) == pytest.approx(0.666673, abs=1e-6)
    assert mean(L.loss_cross_device(s)) == pytest.approx(0.666673, abs=1e-6)


def test_distillation(frames):
    s, t = frames
    assert mean(L.kd_kl(s, t)) == pytest.approx(0.668931, abs=1e-6)
    assert mean(L.kd_progressive(s, t, "in_batch")) == pytest.approx(0.766329, abs=1e-6)


def test_combined(frames):
    s, t = frames
    r = L.combined(s, t, kd="kl", kd_weight=1.0).collect()[0]["loss"]
    assert r == pytest.approx(0.666673 + 0.668931, abs=1e-6)
    r = L.combined(s, t, kd="m3", kd_weight=0.5).collect()[0]["loss"]
    assert r == pytest.approx(0.5 * 0.766329, abs=1e-6)
