import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import lm, token_counts, warc
from ranksmith.llm.common import shared_path, words
from ranksmith.llm.queries import tokenizer_path


def test_words_are_ascii_white_space_words():
    import re
    texts = ["", " a  B\tc\n", "É x y z", None, "\x0b\x0c\r", "q", "a\x00b \x1cc"]
    codes, offs, distinct = words(pa.array(texts))
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        assert [distinct[c].decode() for c in codes[offs[i]:offs[i + 1]]] == want


# ---- WARC ----------------------------------------------------------------------

def _brute_warc(rows):
    best = {}
    for i, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        to = best.get(h, i) if len(raw) >= 1000 else i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return out


def test_archive_round_trip(spark):
    big, other = "é<p>" * 400, "x" * 300_000
    rows = [(i, "http://a/ b\n" if i % 2 else None, h) for i, h in enumerate([big, "small", None, "", other, big, "small", "y" * 999, "y" * 1000, "y" * 1000])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, key int")
    path = shared_path(spark, "warc-test")
    index = warc.archive(df, path, frame_bytes=2000, bundle_bytes=3000)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect())
    assert got == sorted(_brute_warc([(i, h) for i, _, h in rows]))
    assert index.select("bundle").distinct().count() > 1
    ids = index.where("page_id in (0, 4, 9)")
    want = {0: b"", 4: other.encode(), 9: b"y" * 1000}
    names = {r.record_id: r.page_id for r in ids.collect()}
    assert {names[r.record_id]: bytes(r.payload) for r in warc.fetch(spark, path, ids).collect()} == want
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    import zstandard
    for f in files:  # any zstd reader restores the WARC stream
        text = zstandard.ZstdDecompressor().stream_reader(bytes(f.content), read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_archive_of_repeated_and_null_rows(spark):
    z = "z" * 2000
    df = spark.createDataFrame([(7, "u", z), (7, "u", z), (7, "u", z), (None, "u", z), (None, None, None), (3, "u", z)], "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive(df).collect())
    assert got == {(7, "response", None): 1, (7, "revisit", 7): 2, (None, "revisit", 7): 1, (None, "response", None): 1, (3, "revisit", 7): 1}
    assert warc.archive(df.limit(0)).count() == 0


# ---- token counts ---------------------------------------------------------------

def _brute_sections(text, enc):
    """Per character: the token that holds its first byte; then sections by most characters."""
    text = text or ""
    ids = enc.encode_ordinary(text)
    cuts, at = [], 0
    for line in _lines(text):
        cuts.append((at, at + len(line)))
        at += len(line)
    cuts = cuts or [(0, 0)]
    first_byte, pos = {}, 0
    for i, c in enumerate(text):
        first_byte[pos] = i
        pos += len(c.encode())
    counts, byte = [0] * len(cuts), 0
    for t in ids:
        n = len(enc.decode_single_token_bytes(t))
        chars = [first_byte[b] for b in range(byte, byte + n) if b in first_byte]
        if not chars:
            chars = [max(c for b, c in first_byte.items() if b < byte)]
        held = [sum(a <= c < b for c in chars) for a, b in cuts]
        counts[int(np.argmax(held))] += 1
        byte += n
    return counts, len(ids)


def _lines(text):
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def test_section_tokens_against_brute_force(spark):
    import public_tokenizers
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    enc, _ = token_counts.load(path, public_tokenizers.PATTERN)
    texts = [None, "", "\n", "a\n\n\n b", "no newline", "漢字😀é\n\n\n\nx", "<|endoftext|>\n y", " \n \n  \n", "w " * 20_000, "😀" * 50, "same\nx", "same\nx"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000").limit(60)
    docs = docs.unionByName(table.select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(0).alias("section")))
    got = {}
    for r in token_counts.section_tokens(docs, path, public_tokenizers.PATTERN).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    for r in docs.collect():
        counts, n = _brute_sections(r.text, enc)
        sec = got[r.doc_id]
        assert [sec[i].n_tokens for i in range(len(sec))] == counts
        assert sum(counts) == n == sec[0].doc_tokens and sec[len(sec) - 1].char_end == len(r.text or "")
    assert token_counts.section_tokens(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_boundary_rules():
    ends = np.array([3, 4, 10])
    start, end = np.array([0, 2, 2, 4, 3]), np.array([2, 4, 9, 4, 5])
    assert token_counts.allocate(start, end, ends, "start")[0].tolist() == [0, 0, 0, 1, 1]
    at, cross = token_counts.allocate(start, end, ends, "largest")
    assert at.tolist() == [0, 0, 2, 1, 1] and cross.tolist() == [False, True, True, False, True]


# ---- language model ---------------------------------------------------------------

def _tokens(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def _in_test_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _brute_base(rows):
    c = collections.Counter(t for i, x in rows if not _in_test_fold(i) for t in _tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in rows:
        tok = _tokens(x)
        out.append((-1 if i is None else i, _in_test_fold(i), len(tok), sum(c[t] > 0 for t in tok), n,
                    round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tok), 6)))
    return sorted(out)


def _rows(spark, df, **kw):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in lm.score(df, **kw).collect())


def test_base_scores_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a b\tB\n"), (4, "c " * 3000), (5, "a b"), (5, "a b"), (None, "x y"), (6, "é 漢"), (11, "unseen words here a")]
    rows += [(i, f"w{i % 7} w{i % 5} a b") for i in range(20, 80)]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, w int")
    want = _brute_base(rows)
    assert _rows(spark, df) == want
    assert _rows(spark, df, head=4, bucket_pairs=50) == want  # rare words by the shuffled path
    assert lm.score(df.limit(0)).count() == 0
    test_only = [r for r in rows if _in_test_fold(r[0])]
    got = lm.score(spark.createDataFrame([(i, t) for i, t in test_only], "doc_id long, text string")).collect()
    assert len(got) == len(test_only) and all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in got)


def test_rounds_and_shards_agree_and_beat_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    one = {r.doc_id: r for r in lm.score(docs).collect()}
    many = {r.doc_id: r for r in lm.score(docs, shard_pairs=2000, round_bytes=4000, head=500).collect()}
    assert one.keys() == many.keys()
    # other shards have other false positives, of the same small rate
    a, b = (np.array([x[i].score / x[i].n_tokens for i in sorted(x)]) for x in (one, many))
    assert abs(a - b).mean() < 0.05
    test = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_pairs_are_counted_exactly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    counts = lm.count_words(docs)
    want = collections.Counter()
    for r in docs.collect():
        codes, offs, h = lm.tokens(pa.array([r.text]))
        seq = h[codes].tolist()
        want.update(zip([int(lm.START), *seq], seq))
    want = {k: n for k, n in want.items() if n >= lm.PAIR_LEAST}
    for most in (1 << 20, 300):
        hd = lm.read_head(counts, most)
        got = lm.count_pairs(docs, spark.sparkContext.broadcast(hd), 5).collect()
        assert {(r.h & (1 << 64) - 1, r.w & (1 << 64) - 1): r.n for r in got} == want and len(got) == len(want)


def test_pairs_seen_once_are_scored(spark):
    train = [i for i in range(60) if not _in_test_fold(i)]
    test = next(i for i in range(60, 200) if _in_test_fold(i))
    rows = [(i, f"a{i} b{i}") for i in train] + [(test, f"a{train[0]} b{train[0]}")]
    docs, m = spark.createDataFrame(rows, "doc_id long, text string"), len(train)
    want = [(r[0], p, 1) for r in rows[:m] for p in ((None, "a"), ("a", "b"), ("b", None))]
    counts = lm.count_words(docs.where(F.col("doc_id") != test).select("text"))
    head = spark.sparkContext.broadcast(lm.read_head(counts, 1 << 20))
    got = lm.count_pairs(docs.where(F.col("doc_id") != test).select("text"), head, 3).collect()
    assert len(got) == len(want) and all(r.n == 1 for r in got)
    scale = 3 * m + 0.5 * (2 * m + 2)
    p = lambda c, left, cw: 0.3 / c + left / c * (cw + 0.5) / scale
    exact = math.log10(p(m, 0.7 * m, 1)) + math.log10(p(1, 0.7, 1)) + math.log10(p(1, 0.7, m))
    for kw in ({}, {"head": 4, "shard_pairs": 20, "round_bytes": 100}):
        r = next(r for r in lm.score(docs, **kw).collect() if r.doc_id == test)
        # counts of 1 are exact, the two large ones (m) within a factor of BASE
        assert r.score > r.base_score + 1 and abs(r.score - exact) < 3 * math.log10(lm.BASE)


def test_text_passes_take_small_batches(spark, monkeypatch):
    seen, name = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, freeze = spark.conf.get(name, None), lm.freeze
    monkeypatch.setattr(lm, "freeze", lambda df, x: seen.setdefault(x, spark.conf.get(name)) and freeze(df, x))
    df = spark.createDataFrame([(i, f"w{i} w{i % 3} a") for i in range(60)], "doc_id long, text string")
    assert lm.score(df, shard_pairs=20, round_bytes=100).count() == 60
    assert {seen[x] for x in ("lm-words", "lm-pairs", "lm-rows", "lm-round")} == {str(lm.BATCH_ROWS)}
    assert spark.conf.get(name, None) == before
    with lm._text_batches(spark):
        sizes = [r.n for r in df.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long").collect()]
        wide = spark.range(0, 5000, 1, 1).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long")
        assert sum(sizes) == 60 and max(r.n for r in wide.collect()) <= lm.BATCH_ROWS


def test_pairs_travel_as_one_run_per_shard():
    rng = np.random.default_rng(1)
    shard, key = rng.integers(0, 9, 4000).astype(np.int32), rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    n, w, c = rng.integers(1, 50, 4000), key + np.uint64(1), rng.integers(0, 2, 4000)
    rows = lm._runs(0, shard, key, n, w, c).to_pylist()
    assert [r["shard"] for r in rows] == list(range(9))
    for r in rows:
        at = np.flatnonzero(shard == r["shard"])
        assert np.frombuffer(r["a"], np.uint64).tolist() == key[at].tolist() and lm.unpack(r["n"], r["size"]).tolist() == n[at].tolist()
        assert np.frombuffer(r["w"], np.uint64).tolist() == w[at][c[at] > 0].tolist() and set(np.frombuffer(r["c"], np.int64)) == {1}
    assert lm._runs(0, shard[:0], key[:0], n[:0], w[:0], c[:0]).num_rows == 0


def test_probes_in_one_buffer_equal_probes_of_each_shard():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 1 << 63, 30000).astype(np.uint64)
    n, at = np.maximum(1, rng.pareto(1.0, 30000) * 3).astype(np.int64), rng.integers(0, 7, 30000)
    p = lm.probe_count()
    bits = {3 * i: lm.fill([(lm.PAIR, key[at == i], n[at == i])], p) for i in range(7)}
    other = rng.integers(0, 1 << 63, 30000).astype(np.uint64)
    r = lm.Round({i: len(x) for i, x in bits.items()}, ((i, x.tobytes()) for i, x in bits.items()))
    assert (r.find(3 * at) == at).all() and r.find(np.array([1, 4])).tolist() == [-1, -1]
    for k in (key, other):
        want = np.zeros(len(k))
        for i in range(7):
            # one probe after the other, as the filter is defined
            x, level, j = k[at == i], np.zeros((at == i).sum(), int), 0
            live = np.arange(len(x))
            while len(live):
                j += 1
                is_set = np.unpackbits(bits[3 * i], bitorder="little").astype(bool)
                live = live[np.all([is_set[s] for s in lm._slots(x[live], lm.PAIR, j, len(is_set), p)], axis=0)]
                level[live] = j
            want[at == i] = lm.worth(level, lm.PAIR)
        assert r.count(at, k, lm.PAIR, p).tolist() == want.tolist()


def test_filter_reads_back_quantised_counts():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    n = np.maximum(1, rng.pareto(1.0, 5000) * 3).astype(np.int64)
    bits = lm.fill([(lm.WORD, key, n)], lm.probe_count())
    got = lm.worth(lm.read_level(bits, key, lm.WORD, lm.probe_count()), lm.WORD)
    assert (got >= n / lm.BASE).all() and np.mean(got <= n * lm.BASE) > 0.98
    other = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert (lm.read_level(bits, other, lm.WORD, lm.probe_count()) > 0).mean() < 3 * lm.ERROR


def test_split_words_cover_all_their_shards():
    d = lm.Dealt(7, {123: 4})
    h, w = np.full(500, 123, np.uint64), np.arange(500, dtype=np.uint64)
    assert sorted(set(d.of(h, w).tolist())) == d.all_of(123) and len(d.all_of(5)) == 1


@pytest.mark.parametrize("values", [[], [0], [1, 2, 3], [1 << 63, 5]])
def test_packed_runs(values):
    v = np.array(values, np.uint64)
    assert lm.unpack(lm.pack(v), len(v)).tolist() == values
