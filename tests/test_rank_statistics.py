"""Tau-b and the exact signed-rank test against brute force."""
import itertools
import math
import random

import pytest

from ranksmith.operators import reports as R


def brute_tau_b(xs, ys):
    c = d = ta = tb = 0
    for (a, b), (e, f) in itertools.combinations(list(zip(xs, ys)), 2):
        s, t = (a > e) - (a < e), (b > f) - (b < f)
        ta, tb = ta + (s == 0), tb + (t == 0)
        c, d = c + (s * t > 0), d + (s * t < 0)
    n0 = len(xs) * (len(xs) - 1) // 2
    below = math.sqrt(n0 - ta) * math.sqrt(n0 - tb)
    return d, ta, tb, round((c - d) / below, 6) if below else None


@pytest.mark.parametrize("block", [3, 4096])
def test_tau_b_with_ties_against_all_pairs(spark, block):
    rng = random.Random(3)
    groups = {"many": [(rng.randrange(9), rng.randrange(7) * 0.5) for _ in range(60)], "distinct": [(i, float((i * 7) % 31)) for i in range(31)],
              "reversed": [(i, -float(i)) for i in range(20)], "flat": [(1, float(i)) for i in range(5)], "one": [(4, 2.0)],
              None: [(rng.randrange(4), float(rng.randrange(30))) for _ in range(25)]}
    rows = [(g, a, b) for g, v in groups.items() for a, b in v] + [("many", None, 1.0), ("many", 3, float("nan")), ("gone", None, None)]
    rng.shuffle(rows)
    got = {r.k: r for r in R.kendall_tau_b(spark.createDataFrame(rows, "k string, a int, b double"), "k", "a", "b", block=block).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        r = got[g]
        assert (r.discordant, r.ties_a, r.ties_b, r.tau_b) == brute_tau_b(*zip(*v)) and r.n == len(v)


def brute_signed_rank(ds):
    ds = [d for d in ds if d]
    size = sorted(map(abs, ds))
    rank = lambda x: (size.index(x) + 1 + len(size) - size[::-1].index(x)) / 2
    ranks = [rank(abs(d)) for d in ds]
    w = sum(r for r, d in zip(ranks, ds) if d > 0)
    sums = [sum(r for r, on in zip(ranks, signs) if on) for signs in itertools.product((0, 1), repeat=len(ds))]
    return len(ds), w, pytest.approx(sum(s >= w for s in sums) / len(sums), abs=1e-6)


def test_exact_signed_rank_against_all_sign_patterns(spark):
    rng = random.Random(8)
    groups = {f"g{i}": [float(rng.randrange(-4, 5)) for _ in range(i)] for i in range(1, 13)} | {"zero": [0.0, 0.0], "up": [1.0, 2.0, 3.0], "down": [-1.0, -2.0, -3.0]}
    rows = [(g, d, 0.0) for g, v in groups.items() for d in v] + [("up", None, 0.0), ("up", float("nan"), 0.0)]
    got = {r.g: (r.n, r.w_plus, r.p_value) for r in R.wilcoxon_exact(spark.createDataFrame(rows, "g string, a double, b double"), "g").collect()}
    assert got == {g: brute_signed_rank(v) for g, v in groups.items()}


def test_large_groups_are_close_to_the_exact_ones(spark):
    rng = random.Random(2)
    rows = [("g", round(rng.gauss(0.2, 1), 1), 0.0) for _ in range(45)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    exact, normal = (R.wilcoxon_exact(df, "g", exact_up_to=n).first().p_value for n in (50, 1))
    assert 0.01 < exact < 0.9 and normal == pytest.approx(exact, abs=0.01)
    z = spark.createDataFrame([(x,) for x in (-12.0, -1.5, 0.0, 0.3, 2.0, 5.0)], "z double")
    for r in z.select("z", R._norm_sf_series(R.F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / 2 ** 0.5) / 2, abs=1e-14)
