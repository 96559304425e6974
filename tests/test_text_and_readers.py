import json
import os
import tempfile

import pytest

from ranksmith.functions.text import strip, chunk_shuffle, format_instruction
from ranksmith.sources.readers import read_json_any, read_passages

HOSTILE = ["\xa0 a\xa0", "\x1c a\x1f", "\x85a", "\t a \n\r", "　a ", "\x0b\x0ca", "​a", " "]


def test_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in HOSTILE], "s string")
    got = [r[0] for r in df.select(strip("s")).collect()]
    assert got == [s.strip() for s in HOSTILE]


def test_format_instruction(spark):
    df = spark.createDataFrame([("ins", "q"), (None, "q")], "i string, t string")
    got = [r[0] for r in df.select(format_instruction("{}\\n{}", df.i, df.t)).collect()]
    assert got == ["ins\nq", "q"]


def test_chunk_shuffle_is_a_permutation(spark):
    t100, t101 = "x" * 100, "".join(chr(97 + i % 26) for i in range(101))
    df = spark.createDataFrame([(1, t100), (2, t101)], "id long, t string")
    got = dict(df.select("id", chunk_shuffle(df.t, 1.0, 3, df.id)).collect())
    assert got[1] == t100                        # exactly 100 characters: never shuffled
    pieces = got[2].split(" ")
    assert sorted(pieces) == sorted([t101[i:i + 34] for i in range(0, 101, 34)])


@pytest.fixture
def json_dir():
    d = tempfile.mkdtemp(prefix="rs-json-", dir="/tmp")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('[{"a":1},\n{"a":2}]')
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('{"a":1}\n\n{"a":2}\n')
    return d


def test_json_modes_per_file(spark, json_dir):
    df = read_json_any(spark, json_dir, "a long")
    rows = sorted((r["file"].rsplit("/", 1)[-1], r["a"]) for r in df.collect())
    assert rows == [("a.json", 1), ("a.json", 2), ("b.json", 1), ("b.json", 2)]
    assert "_corrupt_record" not in df.columns


def test_read_passages_order_and_blank(spark):
    d = tempfile.mkdtemp(prefix="rs-pass-", dir="/tmp")
    json.dump(["p1", " ", {"k": 1}, "p2 "], open(os.path.join(d, "b.json"), "w"))
    json.dump(["p0"], open(os.path.join(d, "a.json"), "w"))
    from ranksmith.operators.corpus import ordered_corpus
    c = ordered_corpus(read_passages(spark, d), ["file", "pos"])
    got = [(r["idx"], r["passage"]) for r in c.orderBy("idx").collect()]
    assert got == [(0, "p0"), (1, "p1"), (2, '{"k":1}'), (3, "p2")]
