import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import simhash
from ranksmith.llm.common import connected_components


def brute(rows, radius=2):
    """Smallest id reachable over links at <= radius bits (quadratic)."""
    import xxhash
    fps = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w, cur = [], ""
        for c in low:
            if c in " \t\n\x0b\x0c\r":
                w, cur = (w + [cur] if cur else w), ""
            else:
                cur += c
        w = w + [cur] if cur else w
        sh = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = {i: i for i, _ in rows}
    changed = True
    a = np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= radius) for x in a]
    while changed:
        changed = False
        for k, (i, _) in enumerate(rows):
            m = min(comp[rows[j][0]] for j in near[k])
            if m < comp[i]:
                comp[i], changed = m, True
    return {i: (f"{f:016x}", comp[i]) for (i, _), f in zip(rows, fps)}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    rows = [(5, None), (3, "  \n"), (9, "one two"), (7, "ONE\ttwo"), (8, "ä Ä b c"), (4, "x " * 50000), (4, "x " * 50000)]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows] + [(None, "one two", "e", 2)],
                               "doc_id long, text string, fingerprint string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].fingerprint == "0" * 16 and by[5].component_id == by[3].component_id == 3
    assert by[9].component_id == by[7].component_id == 7
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    want = brute(rows)
    assert {i: (r.fingerprint, r.component_id) for i, r in by.items()} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hot_shards_are_cut_and_stay_whole(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    while len(fps) < 600:
        x = list(fps)[int(rng.integers(len(fps)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            x ^= 1 << int(b)
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, rep long")
    a = np.array(sorted(fps), np.uint64)
    want = None
    for limit in (20, 10_000):
        e = simhash.links(df, limit=limit)
        got = {r.node: r.component for r in connected_components(e).collect()}
        want = want if want is not None else got
        assert got == want
    ids = {x & (1 << 64) - 1: i for i, x in enumerate(signed)}
    for x in a.tolist():
        for y in a[np.bitwise_count(a ^ np.uint64(x)) <= 2].tolist():
            if x != y:
                assert got[ids[x]] == got[ids[y]]


def test_bk_tree_finds_all():
    rng = np.random.default_rng(0)
    fps = (rng.integers(0, 1 << 16, 500)).tolist()
    t = simhash.BKTree()
    for f in fps:
        t.insert(f)
    for f in fps[:50]:
        assert sorted(t.near(f, 2)) == [i for i, g in enumerate(fps) if (f ^ g).bit_count() <= 2]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, x) for x in range(1000, 1400)] + [(1399, 3)]
    df = spark.createDataFrame([*chain, *hub, (50, 50), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert got[7] == got[1399] == got[1000] == 3 and 50 not in got and 4 not in got
    assert connected_components(df.where(F.lit(False))).count() == 0
