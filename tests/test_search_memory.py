"""Judgements are made once for all their readers, and a search worker holds a bounded state."""

from ranksmith.operators import judge, search


def test_judgements_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "task string, event string, qkey long, dkey long, score double"
    qrels = spark.createDataFrame([("t", "e", 1, 1, 1.0), ("t", "e", 1, 2, 0.0)], kinds).mapInArrow(made, kinds)
    run = spark.createDataFrame([("m", "t", "e", 1, 1, 1, 1)], "model string, task string, event string, qrow long, qkey long, rank long, dkey long")
    assert judge.per_query(run, qrels).first().ndcg_z == 1.0
    assert seen.value == 2


def test_search_state_of_a_worker_is_bounded():
    assert 4 * (3 * search.ROUND_BYTES + 4 * search.SCORE_BLOCK_BYTES) < 400 << 20  # of four workers
