import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import quality, toxicity
from ranksmith.llm.common import held

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def _held_out(scored, labels, label):
    j = scored.join(labels, "doc_id").where(held("doc_id", 0) & F.col(label).isNotNull()).select("score", label).toPandas()
    return j[label].to_numpy(), j["score"].to_numpy()


def test_quality_on_held_out_rows(data):
    docs, labels = data
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    assert scored.columns == [*docs.columns, "score"] and scored.count() == docs.count()
    y, s = _held_out(scored, labels, "quality")
    assert _auc(y, s) > 0.9 and ((s >= quality.KEEP) == (y == 1)).mean() > 0.9
    assert s.min() >= 0 and s.max() <= 1


def test_toxicity_on_held_out_rows(data):
    docs, labels = data
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    y, s = _held_out(scored, labels, "toxic")
    # a few of these labels are noise (no toxic word in the text): high precision, and most of label 1 found
    hit = s >= 0.5
    assert (hit == (y == 1)).mean() > 0.95 and y[hit].mean() > 0.95 and hit[y == 1].mean() > 0.5
    assert s.min() >= 0 and s.max() <= 1


def _odd(spark):
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "w " * 60_000), (5, "x" * 200_000), (None, "plain text here"),
            (6, "é漢 😀\x00 !!!"), (6, "é漢 😀\x00 !!!")]
    return spark.createDataFrame([(i, t, 0.5, "q") for i, t in rows], "doc_id long, text string, score_ double, quality string")


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows_and_missing_labels(spark, data, op):
    docs, labels = data
    odd = _odd(spark)
    model = op.fit(docs, labels)
    got = op.score_documents(odd, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert got[-1].score == got[-2].score
    assert op.score_documents(odd.limit(0), model).count() == 0
    none = labels.where(F.lit(False))
    for lab in (none, labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(None).cast("int"))):
        s = {r.score for r in op.score_documents(odd, op.fit(docs, lab)).collect()}
        assert s == ({1.0} if op is quality else {0.0})
    assert op.fit(docs.limit(0), labels) is not None


def test_statistics_do_not_depend_on_the_batch():
    texts = pa.array(["One two two\nOne two two\n", None, "ABC!! DEF!! | x", "a" * 3_000_000, "tail ### end"])
    whole = quality.statistics(texts)
    for i in range(len(texts)):
        assert np.allclose(whole[i], quality.statistics(texts[i:i + 1])[0])


def test_pool_is_isotonic():
    x = np.arange(6) / 6
    xs, ys = quality.pool(x, np.array([1, 2, 1, 4, 1, 1.0]), np.array([0, 2, 0, 1, 1, 0.0]))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    assert np.isclose(ys[0], 0)


def test_normal_equations_equal_one_solve(data):
    docs, labels = data
    model = quality.fit(docs, labels)
    rows = quality._labelled(docs, labels, "doc_id", "text", "quality").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    z = model.features(x)
    reg = quality.RIDGE * len(y) * np.eye(z.shape[1])
    reg[-1, -1] = 0
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + reg, z.T @ y), atol=1e-6)


def _brute_marginals(score, trans, start):
    """By all labellings of one line."""
    import itertools
    n = len(score)
    total, ones = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        e = sum(s for s, b in zip(score, y) if b) + (start if y[0] else 0)
        e += sum(trans[a][b] for a, b in zip(y, y[1:]))
        total += np.exp(e)
        ones += np.exp(e) * np.array(y)
    return ones / total


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    lens = [3, 0, 1, 6, 4]
    offs = np.concatenate([[0], np.cumsum(lens)])
    score, trans, start = rng.normal(0, 1, offs[-1]), rng.normal(0, 1, (2, 2)), 0.3
    p = toxicity.marginals(np.exp(score), offs, np.exp(trans), np.exp(start))
    for a, b in zip(offs[:-1], offs[1:]):
        if b > a:
            assert np.allclose(p[a:b], _brute_marginals(score[a:b], trans, start))
    f, b = toxicity._messages(np.exp(score), offs, np.exp(trans), np.exp(start))
    assert np.allclose(f * b / (1 + f * b), p)


def test_spans_are_character_offsets(spark, data):
    docs, labels = data
    model = toxicity.fit(docs, labels)
    tagged = toxicity.score_documents(docs, model, spans="spans")
    rows = tagged.where(F.size("spans") > 0).select("text", "score", "spans").limit(40).collect()
    assert rows
    seen = {r.text[s.start:s.end].lower().strip(".,!#$%&*|") for r in rows for s in r.spans}
    assert all(r.score >= 0.5 and not any(c in " \n\t" for s in r.spans for c in r.text[s.start:s.end]) for r in rows)
    assert len(seen) < 200
    row = toxicity._spans(pa.scalar("é x  bad"), np.array([0.1, 0.2, 0.9]))
    assert [(r["start"], r["end"]) for r in row] == [(5, 8)]


def test_training_windows_come_from_the_whole_document(spark):
    text = " ".join(f"bad{i} " + "word " * 40 for i in range(12))
    rows = spark.createDataFrame([(i, text, 1) for i in range(30)], "id long, text string, y int")
    lexicon = [f"bad{i}" for i in range(12)]
    for n in (2, 12):
        got = toxicity._windows(rows, lexicon, n).collect()
        hits = [w for r in got for w, y in zip(r.w, r.y) if y]
        assert len(got) == 30 * (n + 1) and {w for w in hits} == set(lexicon)  # also the fifth and later ones
