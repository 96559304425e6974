"""Inputs that once gave wrong answers without an error."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.functions.det import u01
from ranksmith.functions.vectors import l2_normalize, log_sum_exp
from ranksmith.operators import judge
from ranksmith.operators import losses as L
from ranksmith.operators import pretrain as PT
from ranksmith.operators import train_data as T
from ranksmith.operators.corpus import contains_join, ordered_index
from ranksmith.plans import views as V
from ranksmith.sources import readers as R

SF = "/root/testdata/sf0.001"


# ---- readers -------------------------------------------------------------------

def test_array_file_behind_many_blanks(spark, tmp_path):
    (tmp_path / "a.json").write_text(" " * 5000 + '\n[{"a": 1}, {"a": 2}]')
    assert sorted(r.a for r in R.read_json_any(spark, str(tmp_path), "a long").collect()) == [1, 2]


def test_object_over_several_lines_is_one_row(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": 1, "b": "x"}, indent=2))
    rows = R.read_json_any(spark, str(tmp_path), "a long, b string").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x")]


def test_malformed_line_raises(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="malformed JSON"):
        R.read_json_any(spark, str(tmp_path), "a long").collect()


def test_passages_one_string_per_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('"p1"\n\n" "\n"p2"\n')
    (tmp_path / "b.json").write_text('["p3"]')
    got = R.read_passages(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [r.passage for r in got] == ["p1", "p2", "p3"]


def test_training_files(spark, tmp_path):
    for n, rows in (("x.jsonl", 3), ("y.json", 2)):
        recs = [{"query": f"{n}{i}", "pos": ["p"], "neg": ["n"], "pos_scores": [1.0], "neg_scores": [0.5]} for i in range(rows)]
        (tmp_path / n).write_text("\n".join(map(json.dumps, recs)) if n.endswith("l") else json.dumps(recs))
    t = R.read_train(spark, [str(tmp_path)], distill=True)
    assert t.select("pos").count() == 5
    assert sorted((r.dataset_id, r.row_id, r["query"]) for r in t.collect()) == [
        (0, 0, "x.jsonl0"), (0, 1, "x.jsonl1"), (0, 2, "x.jsonl2"), (1, 3, "y.json0"), (1, 4, "y.json1")]
    alone = R.read_train(spark, [str(tmp_path / "x.jsonl")]).collect()
    assert {r.source_dir for r in alone} == {None}


def test_last_judgement_wins_in_lines_files(spark, tmp_path):
    rows = [{"query-id": "q", "corpus-id": "d", "score": str(s)} for s in (2, 0, 1)]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = judge.qrels_dedupe(R.read_qrels_ids(spark, str(tmp_path))).collect()
    assert [(r.qkey, r.score) for r in got] == [("q", 1.0)]


def test_query_with_an_empty_list_counts_as_zero(spark, tmp_path):
    rows = [{"user_query": "a", "passages": ["p"], "query_id": "1", "doc_ids": ["d"]},
            {"user_query": "b", "passages": [], "query_id": "2", "doc_ids": []}]
    (tmp_path / "QA_x_label_pool.json").write_text(json.dumps(rows))
    qrels = spark.createDataFrame([("QA", "x", "1", "d", 1.0), ("QA", "x", "2", "e", 1.0)], "task string, event string, qkey string, dkey string, score double")
    hits, queries = R.read_runs(spark, str(tmp_path), qrels=qrels, keys="id")
    ev = judge.per_event(judge.per_query(hits, qrels, 10, queries=queries)).collect()
    assert {(r.variant, r.num_queries, r["RR@10"]) for r in ev} == {("zero", 2, 0.5), ("ignore", 2, 0.5)}


def test_stats_skip_files_without_judgements(spark):
    run = spark.createDataFrame([("m", "T", "a", 0, "q", 1, "d"), ("m", "T", "b", 1, "r", 1, "d"), ("m", "T", "b", 1, "r", 2, "e")],
                                "model string, task string, event string, qrow long, qkey string, rank long, dkey string")
    qrels = spark.createDataFrame([("T", "a", "q", "d", 1.0)], "task string, event string, qkey string, dkey string, score double")
    st = judge.retrieval_stats(judge.per_query(run, qrels)).collect()[0]
    assert (st.total_retrieved_pairs, st.unannotated_pairs) == (1, 0)


# ---- ordered index ---------------------------------------------------------------

def test_ordered_index_with_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3)] + [("c", 9)] * 5, "k string, v int").repartition(4)
    got = sorted((r.idx, r.k) for r in ordered_index(df, ["k"]).collect())
    assert got == [(0, None), (1, "a"), (2, "b")] + [(i, "c") for i in range(3, 8)]
    assert ordered_index(df.limit(0), ["k"]).count() == 0


def test_containment_with_short_patterns(spark):
    docs = spark.createDataFrame([(1, "abcabc xyz"), (2, "ab"), (3, ""), (4, None), (5, "q" * 200 + "needle in it " + "q" * 200)], "doc_id long, text string")
    pats = spark.createDataFrame([(1, "ab"), (2, "c"), (3, "needle in it"), (4, ""), (5, "q" * 150), (6, "abc"), (7, "bcabc x")], "item_id long, text string")
    got = {tuple(r) for r in contains_join(docs, pats, doc_id="doc_id", doc_text="text", pat_id="item_id", pat_text="text").collect()}
    want = {(d.doc_id, p.item_id) for d in docs.collect() for p in pats.collect() if p.text and d.text and p.text in d.text}
    assert got == want
    assert contains_join(docs, pats.limit(0), doc_id="doc_id", doc_text="text", pat_id="item_id", pat_text="text").count() == 0


def test_judgements_are_bounded_per_query(spark):
    per = V.qrels_vec(spark, SF).groupBy("qkey").count().agg(F.max("count")).first()[0]
    assert 0 < per <= 30


def test_checkpoints_retrieve_different_documents(spark):
    r = V.models_run(spark, SF).groupBy("model").agg(F.sort_array(F.collect_set(F.struct("qkey", "dkey"))).alias("s")).collect()
    assert len(r) == 3 and len({str(x.s) for x in r}) == 3


# ---- losses ------------------------------------------------------------------------

def _frames(spark, batch, scores, teacher):
    s = spark.createDataFrame([(batch, 0, 0, 0, 0, j, float(x)) for j, x in enumerate(scores)],
                              "batch int, q_rank int, q_slot int, p_rank int, p_slot int, j int, score double")
    t = spark.createDataFrame([(batch, 0, 0, j, float(x)) for j, x in enumerate(teacher)], "batch int, rank int, slot int, j int, t double")
    return s, t


@pytest.mark.parametrize("scores,want", [((80, 30, 25, 10), 0.001679), ((60, 30, 29), 0.104421)])
def test_progressive_loss_with_large_scores(spark, scores, want):
    s, t = _frames(spark, 0, scores, [1.0] * len(scores))
    assert L.kd_progressive(s, t, "group").collect()[0]["loss"] == pytest.approx(want, abs=2e-6)


def _numpy_ce(own, rest, i=0):
    x = np.array([*own[i:], *rest], float)
    m = x.max()
    return m + np.log(np.exp(x - m).sum()) - own[i]


def test_cross_device_mean_and_flags(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    sc = rng.normal(0, 30, (2, 2, 2, 2, 3, 2))  # batch, q_rank, q_slot(<2), p_rank, ...
    for b in range(2):
        losses = {}
        for qr in range(2):
            for qs in range(2):
                for pr in range(2):
                    for ps in range(2):
                        for j in range(2):
                            rows.append((b, qr, qs, pr, ps, j, float(sc[b, qr, qs, pr, ps, j])))
                own = [sc[b, qr, qs, qr, qs, j] for j in range(2)]
                rest = [] if b == 1 else [sc[b, qr, qs, pr, ps, j] for pr in range(2) for ps in range(2) for j in range(2) if (pr, ps) != (qr, qs)]
                losses.setdefault(qr, []).append(_numpy_ce(own, rest))
        for qr in range(2):
            want[b, qr] = np.mean(losses[qr]) if b == 1 else np.mean(losses[0] + losses[1])
    s = spark.createDataFrame(rows, "batch int, q_rank int, q_slot int, p_rank int, p_slot int, j int, score double")
    flags = spark.createDataFrame([(0, False), (1, True)], "batch int, no_in_batch boolean")
    got = {(r["batch"], r["q_rank"]): r["loss"] for r in L.combined(s, None, flags=flags, cross_device=True).collect()}
    assert got == pytest.approx(want)


# ---- training sets ---------------------------------------------------------------------

def test_group_size_is_one_per_slice(spark):
    plan = spark.createDataFrame([(0, 1, 0, 0, 0, 10), (0, 1, 0, 0, 1, 11), (0, 1, 0, 1, 0, 12)],
                                 "epoch int, dataset_id long, batch_no long, rank int, slot int, row_id long")
    rows = spark.createDataFrame([(10, "symmetric_class", ["a"]), (11, "symmetric_class", ["a"] * 5), (12, "symmetric_class", ["a"] * 5)],
                                 "row_id long, type string, neg array<string>")
    got = {r.row_id: r.g for r in T.batch_group_size(plan, rows, 8).collect()}
    assert got == {10: 2, 11: 2, 12: 6}


def test_small_datasets_merge_within_their_directory(spark):
    rows = [(d, i, s) for d, n, s in ((0, 3, "A"), (1, 2, "A"), (2, 2, "B"), (3, 2, None), (4, 9, None)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset_id long, row_id long, source_dir string")
    got = {(r.dataset_id, r.merged): r["count"] for r in T.merge_small(df, 5, 4).groupBy("dataset_id", "merged").count().collect()}
    assert got == {(0, True): 5, (4, False): 9}


# ---- the rest -----------------------------------------------------------------------------

def test_normalize_long_vectors(spark):
    v = np.random.default_rng(0).normal(size=(200, 256))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(999, [0.0] * 4)], "id long, v array<double>")
    got = {r.id: r.u for r in df.select("id", l2_normalize("v").alias("u")).collect()}
    for i in range(200):
        assert got[i] == pytest.approx(v[i] / np.linalg.norm(v[i]))
    assert got[999] == [0.0] * 4
    one = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>").select(log_sum_exp("v").alias("z")).first().z
    assert one == pytest.approx(1000 + np.log(2))


def test_perplexity_near_the_largest_double(spark):
    df = spark.createDataFrame([(709.7827,), (709.7827,)], "loss double")
    p = PT.perplexity(df).first().perplexity
    assert np.isfinite(p) and p > 1e308
    assert PT.perplexity(spark.createDataFrame([(720.0,)], "loss double")).first().perplexity == float("inf")


def test_stream_clean_on_a_directory_table(spark, tmp_path):
    from ranksmith.plans.catalog import QUERIES
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one = sorted(map(str, QUERIES["stream_clean"](spark, SF).collect()))
    many = sorted(map(str, QUERIES["stream_clean"](spark, str(tmp_path)).collect()))
    assert one == many and one


# ---- training negatives ----------------------------------------------------------

@pytest.mark.parametrize("hot,others,unknown", [(150, 60, 0), (60, 120, 20), (40, 3, 2), (5, 0, 3)])
def test_every_query_gets_all_its_negatives(spark, tmp_path, hot, others, unknown):
    """A conversation (11: 12 negatives) with most of all assistant turns."""
    rows = [(11, 2 * i + j, r) for i in range(hot) for j, r in enumerate(("user", "assistant"))]
    rows += [(100 + i, j, r) for i in range(others) for j, r in enumerate(("user", "assistant"))]
    rows += [(None, i, "assistant") for i in range(unknown)]
    df = spark.createDataFrame([(*r, f"{r[0]}-{r[1]}") for r in rows], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    u = df.select("conv_id", "turn", "role", "text", u01(F.lit("cand"), F.col("conv_id"), F.col("turn")).alias("h"),
                  u01(F.lit("start"), F.col("conv_id"), F.col("turn")).alias("s")).collect()
    ring = sorted((r for r in u if r.role == "assistant"), key=lambda r: (r.h is not None, r.h, r.conv_id or -1, r.turn))
    want = {}
    for r in u:
        if r.role == "user":
            at, n = int(r.s * len(ring)), 1 + r.conv_id % 12
            walk = [x.text for x in ring[at:] + ring[:at] if x.conv_id is not None and x.conv_id != r.conv_id]
            want[r.conv_id * 1000 + r.turn] = walk[:n]
    got = {r.row_id: r.neg for r in V.train_pairs(spark, str(tmp_path)).collect()}
    assert got == want


def test_no_in_batch_flag_keeps_null_sources(spark, tmp_path):
    from ranksmith.plans.catalog_train import q_no_in_batch_flag
    rows = [(1, "web"), (2, "web"), (3, None), (4, None)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.path, r.flag) for r in q_no_in_batch_flag(spark, str(tmp_path)).collect())
    assert got == [(1, "web.jsonl", False), (2, "web_no_in_batch_neg.jsonl", True), (3, None, False), (4, None, True)]


def test_working_names_do_not_clash(spark):
    from ranksmith.operators.corpus import ordered_index
    from ranksmith.plans.views import _running
    names = ["_part", "_mid", "_off", "_n", "_flag", "_sum", "n"]
    df = spark.createDataFrame([(i, *[i * 10 + j for j in range(7)]) for i in range(50)], ["k", *names]).repartition(4)
    for out in (ordered_index(df, ["k"]), _running(df, "k", F.col("k") % 2 == 0, "up")):
        assert out.columns[:8] == ["k", *names]
        for r in out.collect():
            assert all(r[n] == r.k * 10 + j for j, n in enumerate(names))
            assert r[8] == (r.k if out.columns[8] == "idx" else r.k // 2 + 1)
