"""JSON arrays over many tasks (A1, A2): same elements, same order, however the file is cut."""

import json
import random

import pytest

from ranksmith.sources.json_array import array_elements
from ranksmith.sources.readers import read_json_any, read_passages


def nasty(rng):
    s = "".join(rng.choice('ab,"\\[]{}:é日\n\t ') for _ in range(rng.randrange(0, 30)))
    return rng.choice([s, {"k": s, "l": [s, {"m": [1, s]}], "n": None}, rng.randrange(100), None, True, 1.5, [], [s, [s]], {}, s + "\\", '\\"', ","])


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


def elements(spark, path):
    return [json.loads(r.value) for r in array_elements(spark, [str(path)]).orderBy("file", "_pos", "_sub").collect()]


@pytest.mark.parametrize("size", [16, 37, 64, 1000, 1 << 20])
def test_any_cut_gives_the_same_elements(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    small_ranges(size)
    for i, indent in enumerate((None, 1, None)):
        data = [nasty(rng) for _ in range((40, 40, 3)[i])] + (["x" * 700, "a,b," * 100, "[" * 90] if i < 2 else [])
        p = tmp_path / f"f{i}.json"
        p.write_text(("\ufeff" if i == 1 else "") + json.dumps(data, indent=indent, ensure_ascii=i == 2) + "\n", encoding="utf-8")
        frags = spark.read.option("lineSep", ",").text(str(p))
        if size < 100 and i < 2:
            assert frags.rdd.getNumPartitions() > 5
        assert elements(spark, p) == data


@pytest.mark.parametrize("size", [16, 1 << 20])
@pytest.mark.parametrize("text,want", [("[]", []), (" [ ] ", []), ("[1]", [1]), ("[[]]", [[]]), ('[",", "]["]', [",", "]["]), ("[null,\n null]", [None, None])])
def test_small_arrays(spark, tmp_path, small_ranges, size, text, want):
    small_ranges(size)
    (tmp_path / "a.json").write_text(text)
    assert elements(spark, tmp_path / "a.json") == want


@pytest.mark.parametrize("text", ["[1, 2", "[1,,2]", "[1,]", "[,1]", '["a]', "[1] 2", "[1][2]", "[1]]", '["a" "b", 1', "[1, 2] , 3"])
def test_malformed_arrays_raise(spark, tmp_path, small_ranges, text):
    (tmp_path / "a.json").write_text(text)
    for size in (16, 1 << 20):
        small_ranges(size)
        with pytest.raises(Exception, match="malformed JSON"):
            read_passages(spark, str(tmp_path)).collect()


def test_readers_over_many_ranges(spark, tmp_path, small_ranges):
    small_ranges(200)
    rows = [{"a": i, "t": f"text, {i} \"quoted\" ]", "file": "own"} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text('{"a": 1000,\n "t": "one object"}')
    (tmp_path / "c.jsonl").write_text('{"a": 2000, "t": "line"}\n{"a": 2001, "t": null}\n')
    for schema in (None, "a long, t string"):
        got = [r.a for r in read_json_any(spark, str(tmp_path), schema).orderBy("_file" if schema is None else "file", "_pos", "_sub").collect()]
        assert sorted(got) == list(range(300)) + [1000, 2000, 2001]
        mine = [a for a in got if a < 300]
        assert mine == list(range(300))
    d = tmp_path / "p"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([f"p{i}, x" if i % 7 else " " for i in range(200)] + [{"k": 1}, 5, None]))
    got = [r.passage for r in read_passages(spark, str(d)).orderBy("file", "pos").collect()]
    assert got == [f"p{i}, x" for i in range(200) if i % 7] + ['{"k":1}', "5"]
