"""CSV with quoted newlines (A7), JSON array sink, sweeps that go on (K1, G6), task selection."""

import json

import pytest
from pyspark.sql import functions as F

from ranksmith.operators import judge
from ranksmith.operators import reports as R
from ranksmith.operators.corpus import union_sources
from ranksmith.sources import readers, sinks


def test_csv_fields_with_newlines_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a,\nb"\n2,"say ""x"""\n3,plain\n')
    assert sorted(r.text for r in readers.read_text(spark, str(tmp_path / "a.csv")).collect()) == ["a,\nb", "plain", 'say "x"']
    texts = [" lead", "trail ", "q\"uo\"te", "two\nlines", "comma, a", "back\\slash", "é\t漢"]
    sinks.write_csv(spark.createDataFrame([(t,) for t in texts], "text string"), str(tmp_path / "out"))
    assert sorted(r.text for r in readers.read_text(spark, str(tmp_path / "out"), "csv").collect()) == sorted(texts)


@pytest.mark.parametrize("n", [1, 23])
def test_json_arrays_round_trip(spark, tmp_path, n):
    rows = [(i, f'text "{i}",\n[{i}]') for i in range(n)]
    sinks.write_json_arrays(spark.createDataFrame(rows, "a long, t string").repartition(3), str(tmp_path / "o"))
    sinks.write_json_arrays(spark.createDataFrame([r[1:] for r in rows], "t string").repartition(3), str(tmp_path / "s"))
    for f in (tmp_path / "o").glob("*.json"):
        assert isinstance(json.loads(f.read_text()), list)
    got = readers.read_json_any(spark, str(tmp_path / "o"), "a long, t string")
    assert sorted((r.a, r.t) for r in got.collect()) == rows
    assert sorted(r.passage for r in readers.read_passages(spark, str(tmp_path / "s")).collect()) == sorted(t for _, t in rows)


def test_a_sweep_searches_only_new_checkpoints(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []
    q = spark.createDataFrame([(m, i) for m in ("a", "b=1/x", "007") for i in range(3)], "model string, qid long")

    def evaluate(new):
        seen.append(sorted(r.model for r in new.select("model").distinct().collect()))
        return new.groupBy("model").agg(F.sum("qid").alias("total"))

    one = R.run_sweep(q.where("model = 'a'"), evaluate, store)
    assert [(r.model, r.total) for r in one.collect()] == [("a", 3)]
    for _ in range(2):
        assert sorted((r.model, r.total) for r in R.run_sweep(q, evaluate, store).collect()) == [("007", 3), ("a", 3), ("b=1/x", 3)]
    assert seen == [["a"], ["007", "b=1/x"]]  # the third run evaluates nothing

    def lost(new):
        raise RuntimeError("lost")
    more = q.unionByName(spark.createDataFrame([("new", 9)], q.schema))
    with pytest.raises(RuntimeError):
        R.run_sweep(more, lost, store)
    assert R.run_sweep(more, evaluate, store).count() == 4 and seen[-1] == ["new"]


def test_select_tasks_and_union(spark):
    df = spark.createDataFrame([("QA", 1), ("STS", 2)], "task string, n long")
    assert [r.n for r in judge.select_tasks(df, ["STS"]).collect()] == [2] and judge.select_tasks(df, None).count() == 2
    with pytest.raises(ValueError, match="unknown tasks: .'XX'"):
        judge.select_tasks(df, ["QA", "XX"])
    u = union_sources(df, spark.createDataFrame([("x", True)], "task string, flag boolean"))
    assert sorted(map(tuple, u.collect()), key=str) == sorted([("QA", 1, None), ("STS", 2, None), ("x", None, True)], key=str)
