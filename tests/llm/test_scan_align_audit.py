"""License scans, cross-tokenizer alignment and the filter audit against brute force."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ranksmith.llm import alignment, filter_audit, license_rules, license_scan
from ranksmith.llm import queries as Q

WS = "\x20\x09-\x0D"


# ---- licenses ----------------------------------------------------------------

def brute_words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_base(words):
    out = []
    for label, _, phrase in license_rules.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return out


LICENSE_TEXTS = [
    None, "", "   ", "nothing here", "GNU General\n * Public License, version 2", "Licensed under CC BY-NC 4.0. CC BY, cc by.",
    "ünder the MIT License and the mit_license; permit license", "mit-license apache.license Apache  License 2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "cc écc by x cc byé", "\x00cc\x00by\x7f", "All rights reserved.",
    "İ MIT LICENSE K mit license", "word " * 5000 + "gnu general public license " * 40, "cc by cc by", "ccby cc-byte",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "https://creativecommons.org/licenses/by-sa/4.0/legalcode", "gnu general public", "license"]


def test_license_scan_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(LICENSE_TEXTS)], "doc_id long, text string, detections string, n_words int")
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(df)).collect()}
    scanner = license_scan.Scanner(license_rules.load())
    assert len(got) == len(LICENSE_TEXTS)
    for i, t in enumerate(LICENSE_TEXTS):
        w = brute_words(t)
        base = brute_base(w)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(base)), t
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b[1] for b in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        # without the keyword gate: every rule on the text of words
        text, every = " ".join(w), []
        for rule, pattern in scanner.rules:
            every += [(text[:m.start()].count(" "), text[:m.end()].count(" ") + 1, rule) for m in pattern.finditer(text)]
        keep = {(a, b, x.order) for a, b, x in every if x.base or not any(
            c <= a and b <= d and (y.priority > x.priority or (y.priority == x.priority and ((d - c, -y.order) > (b - a, -x.order))))
            for c, d, y in every if y is not x)}
        low = license_scan.pc.ascii_lower(license_scan.pa.array([t or ""]))[0].as_py()
        assert {(d["word_start"], d["word_end"], d["rule"]) for d in scanner.detect(low)} == keep


def test_license_labels_and_offsets():
    rules = license_rules.load()
    assert len(rules) >= 300 and len({r.pattern for r in rules if not r.base}) > 250
    for r in rules:
        r.compiled()
        long = r.pattern + "".join(v for k, v in license_rules.SHORT.items() if k in r.pattern)
        assert all(w in long.replace("licen[cs]e", "license licence") for w in r.keywords), r
    s = license_scan.Scanner(rules)
    kept = lambda t: [d["label"] for d in s.detect(t.lower())]
    assert kept("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0", "gpl"]
    assert kept("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0", "cc-by"]
    assert kept("see https://www.mozilla.org/MPL/2.0/") == ["mpl-2.0"]
    assert kept("Redistribution under the BSD 3-Clause License") == ["bsd-3-clause"]
    text = "x Released  under\nthe MIT License!"
    d = s.detect(text.lower())[0]
    assert text[d["char_start"]:d["char_end"]] == "Released  under\nthe MIT License"


def test_license_scan_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.summary(license_scan.scan(df)).count() == 0


# ---- alignment ----------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_align_matches_sets_of_ends(a, b):
    total = min(sum(a), sum(b))
    cut = lambda x: np.unique(np.minimum(np.cumsum(x), total))
    ea, eb = cut(a), cut(b)
    al = alignment.align(ea, eb)
    common = sorted(set(ea.tolist()) & set(eb.tolist()))
    assert [ea[i - 1] for i in al.a_end] == common and [eb[j - 1] for j in al.b_end] == common
    sa, sb = np.concatenate([[0], ea[:-1]]), np.concatenate([[0], eb[:-1]])
    want = {(i, j) for i in range(len(ea)) for j in range(len(eb)) if sa[i] < eb[j] and sb[j] < ea[i]}
    got = list(zip(al.link_a.tolist(), al.link_b.tolist()))
    assert len(got) == len(set(got)) and set(got) == want


def test_run_length_equals_a_scan():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.cumsum(rng.integers(1, 4, 200)).astype(np.int32)
        y = x.copy()
        y[rng.integers(0, 200, rng.integers(0, 4))] += 1
        i, n = int(rng.integers(0, 200)), 0
        while i + n < 200 and x[i + n] == y[i + n]:
            n += 1
        assert alignment.run_length(x.tobytes(), y.tobytes(), i, i) == n


ALIGN_TEXTS = [None, "", " ", "  two  spaces ", "Hello wörld, this is a tëst.", "a▁b", "<|endoftext|> <s> </s> <unk>", "日本語 テキスト 🙂 x", "tab\tand\nline\r\n\n  end",
               "\x00nul", "same words same words same words", "same words same words same words", "naïve café résumé " * 300, "x" * 5000, " nbsp　", "'s 'll 123456 #$%&"]


@pytest.mark.parametrize("head", [alignment.HEAD, 20, 0])
def test_alignment_matches_brute_force(spark, head):
    df = spark.createDataFrame([(None if i == 3 else min(i, 12), t, 1.0) for i, t in enumerate(ALIGN_TEXTS)], "doc_id long, text string, n_a double")
    pa_, pb = Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")
    got = sorted(map(repr, alignment.alignment(df.repartition(3), pa_, pb, head=head).collect()))
    a, b = alignment.ByteLevel(pa_), alignment.Pieces(pb)
    found, count = [], Counter()
    for t in ALIGN_TEXTS:
        ids_a, ids_b = (a.tok.encode(" " + t, add_special_tokens=False).ids, b.sp.encode(t)) if t else ([], [])
        raw = b" " + (t or "").encode()
        if not t or b"".join(a.bytes[x] for x in ids_a) != raw or b"".join(b.bytes[x] for x in ids_b) != raw:
            found.append(([], [], [], []))
            continue
        ea = list(itertools.accumulate(len(a.bytes[x]) for x in ids_a))
        eb = list(itertools.accumulate(len(b.bytes[x]) for x in ids_b))
        links = [(x, y) for x, e, s in zip(ids_a, ea, [0] + ea) for y, f, u in zip(ids_b, eb, [0] + eb) if s < f and u < e]
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x, y = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        count.update(links)
        found.append((ids_a, ids_b, links, groups))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    from pyspark.sql import Row
    want = [Row(doc_id=None if i == 3 else min(i, 12), n_a=len(x), n_b=len(y), n_groups=len(g), n_links=len(l), n_best=sum(count[p] == best[p[1]] for p in l),
                count_sum=sum(count[p] for p in l), groups_sha256=hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, (x, y, l, g) in enumerate(found)]
    assert got == sorted(map(repr, want))


SIDES = []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t\r\x0b\x85\xa0\u2003\u3000\u200b\ufeff▁ab,'s1é日<>\x00"))), min_size=1, max_size=8))
def test_chunks_encode_as_whole_texts(texts):
    if not SIDES:
        SIDES.append(alignment.Encoder(alignment.ByteLevel(Q.tokenizer_path("byte_bpe_50k.json")), alignment.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))))
    e = SIDES[0]
    got = e.encode(alignment.pa.array([*texts, None]))
    for (ids, offs), whole in zip(got, (e.a.encode(texts), e.b.encode(texts))):
        for k, (t, w) in enumerate(zip(texts, whole)):
            mine = ids[offs[k]:offs[k + 1]].tolist()
            raw = b" " + t.encode()
            fits = all(b"".join(s.bytes[i] for i in s.encode([t])[0]) == raw for s in (e.a, e.b))
            assert mine == (w if t and fits else [])
        assert offs[-1] == offs[-2]


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(df, Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")).count() == 0


# ---- filter audit ------------------------------------------------------------

AUDIT = [(1, "copy of a text", "s1"), (2, "copy of a text", "s1"), (2, "copy of a text", "s2"), (2, "other", None), (3, None, ""), (4, "", "s1"), (None, "copy of a text", "s1"),
         (None, "copy of a text", "s1"), (5, "AB cd", "s1"), (6, "word " * 300, "s2"), (7, " ".join(f"w{i}" for i in range(250)), "s2"), (7, " ".join(f"w{i}" for i in range(250)), "s2"),
         (8, "pipe | " + " ".join(f"x{i}" for i in range(250)), "s2"), (9, "ÄÖÜ é x\x0by", "s1"), (10, "Ab " * 400, None), (0, "copy of a text", "s3")]
AUDIT_LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, 0, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1), (10, None, 1)]


def brute_audit(rows, labels):
    docs = []
    for i, (doc, text, part) in enumerate(rows):
        t = text or ""
        w = re.findall(f"[^{WS}]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in rows)}
        docs.append((part or "", {k for k, v in fails.items() if v}, any(d == doc and doc is not None and q == 1 for d, q, _ in labels),
                     any(d == doc and doc is not None and x == 1 for d, _, x in labels)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("shard,group", [(filter_audit.SHARD_BYTES, filter_audit.GROUP_BYTES), (200, 500), (1, 1)])
def test_audit_matches_brute_force(spark, shard, group):
    docs = spark.createDataFrame([(*r, "x", 0) for r in AUDIT], "doc_id long, text string, source string, part string, mask int").repartition(2)
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels, shard_bytes=shard, group_bytes=group, bucket_words=10).collect()}
    assert got == brute_audit(AUDIT, AUDIT_LABELS)


def test_term_shards_are_a_global_matrix(spark):
    docs = spark.createDataFrame([(*r[:2], r[2]) for r in AUDIT], "doc_id long, text string, source string").repartition(3)
    rows = filter_audit.term_shards(docs, shard_bytes=100, group_bytes=300, bucket_words=10).collect()
    words, seen = {}, set()
    want = sorted(sorted(Counter(re.findall(f"[^{WS}]+", t or "")).values()) for _, t, _ in AUDIT)
    got = []
    for r in rows:
        for k in range(len(r.indptr) - 1):
            a, b = r.indptr[k], r.indptr[k + 1]
            assert list(r.indices[a:b]) == sorted(set(r.indices[a:b]))
            seen |= set(r.indices[a:b])
            got.append(sorted(r.data[a:b]))
            words.setdefault(r.digest[k], set()).add(tuple(zip(r.indices[a:b], r.data[a:b])))
    assert sorted(got) == want
    kinds = {w for _, t, _ in AUDIT for w in re.findall(f"[^{WS}]+", t or "")}
    assert seen == set(range(len(kinds)))  # dense, one number per word
    assert all(len(v) == 1 for v in words.values())  # equal texts have equal rows in any shard


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0


def test_audit_sql(spark, tmp_path):
    docs = spark.createDataFrame([r for r in AUDIT], "doc_id long, text string, source string")
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    r = con.execute(Q.ORACLE["op13_filter_audit"])
    names = [d[0] for d in r.description]
    at = [names.index(n) for n in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    got = {tuple(x[i] for i in at[:3]): tuple(x[i] for i in at[3:]) for x in r.fetchall()}
    assert got == brute_audit(AUDIT, AUDIT_LABELS)
