"""License detection by ordered signature rules.

Method
1. Keyword prefilter: one scan for the rules' keywords over the lower-cased
   text decides whether a document is looked at; then only the rules whose
   keyword is among its words run.
2. The rules (``license_rules``: hand-written regexes, in order, each with a
   label and a kind) read the text as its words parted by single spaces, so
   punctuation, line ends and comment marks between words do not matter.
3. Overlaps: a detection that lies inside another one is dropped when the other
   has the higher priority, or the same priority and a longer interval, or the
   same interval and comes first. Detections that merely cross are both kept.
   Places of the base phrases are never dropped.
4. Document score: the largest confidence among the kept detections, 0 without one.

Words are maximal runs of 0-9, a-z (A-Z is lower-cased) and characters beyond ASCII.

Defined cases
* null or empty text: no words, no detections, score 0;
* very long texts are scanned whole; every place counts, also repeated ones;
* a phrase may run over line ends and punctuation, not over other words;
* null and repeated ids and repeated rows: one result row each;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import license_rules
from .common import text_slices
from .license_rules import Rule

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IN_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])

#: One detection: rule (its order), label, kind, base phrase or not, words and characters [start, end), confidence.
_HIT = [("rule", T.IntegerType(), pa.int32()), ("label", T.StringType(), pa.string()), ("kind", T.StringType(), pa.string()),
        ("base", T.BooleanType(), pa.bool_()), ("word_start", T.LongType(), pa.int64()), ("word_end", T.LongType(), pa.int64()),
        ("char_start", T.LongType(), pa.int64()), ("char_end", T.LongType(), pa.int64()), ("confidence", T.DoubleType(), pa.float64())]


def count_words(lower: pa.Array) -> np.ndarray:
    """Words of each (lower-cased) text."""
    if not len(lower):
        return np.zeros(0, np.int64)
    at = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset:lower.offset + len(lower) + 1].astype(np.int64)
    raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    inside = _IN_WORD[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    start[first] = inside[first]  # a word does not run on from the text before
    total = np.concatenate([[0], np.cumsum(start)])
    return total[at[1:]] - total[at[:-1]]


class Scanner:
    """The rules with their keyword gate."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, r.compiled()) for r in rules]
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.by_word.setdefault(r.keywords[0], []).append(i)
        # whole words only up to characters beyond ASCII: more texts pass than have the word, never fewer
        self.gate = "(?:^|[^0-9a-z])(?:" + "|".join(sorted(map(re.escape, self.by_word))) + ")(?:[^0-9a-z]|$)"

    def passes(self, lower: pa.Array) -> np.ndarray:
        """Texts that may hold a keyword."""
        return pc.match_substring_regex(lower, self.gate).to_numpy(zero_copy_only=False)

    def detect(self, lower: str) -> list[dict]:
        """Kept detections of one lower-cased text, by place."""
        spans = [m.span() for m in _WORD.finditer(lower)]
        words = [lower[a:b] for a, b in spans]
        there = set(words)
        todo = sorted(i for w in self.by_word.keys() & there for i in self.by_word[w] if there.issuperset(self.rules[i][0].keywords))
        if not todo:
            return []
        text = " ".join(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        found = []
        for i in todo:
            rule, pattern = self.rules[i]
            for m in pattern.finditer(text):
                a, b = np.searchsorted(starts, m.span())
                found.append((int(a), int(b), rule))
        return [{"rule": r.order, "label": r.label, "kind": r.kind, "base": r.base, "word_start": a, "word_end": b,
                 "char_start": spans[a][0], "char_end": spans[b - 1][1], "confidence": r.confidence} for a, b, r in resolve(found)]


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no other one suppresses, by place.

    In the order of (start, longest, highest priority, rule order) whatever can
    hold a detection comes before it, so the furthest end per priority decides."""
    found = sorted(found, key=lambda x: (x[0], -x[1], -x[2].priority, x[2].order))
    reach: dict[int, int] = {}
    out = []
    for a, b, r in found:
        covered = any(end >= b for priority, end in reach.items() if priority >= r.priority)
        if r.base or not covered:
            out.append((a, b, r))
        reach[r.priority] = max(reach.get(r.priority, 0), b)
    return out


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, detections, score per document; ``detections`` are the kept ones, by place."""
    rules = license_rules.load() if rules is None else rules
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("detections", T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in _HIT]))),
                           T.StructField("score", T.DoubleType())])
    kind = pa.list_(pa.struct([(n, t) for n, _, t in _HIT]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in text_slices(batch, 1):
                lower = pc.ascii_lower(pc.fill_null(part.column(1), ""))
                hits: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(scanner.passes(lower)).tolist():
                    hits[i] = scanner.detect(lower[i].as_py())
                score = [max((h["confidence"] for h in hs), default=0.0) for hs in hits]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_words(lower)), pa.array(hits, kind), pa.array(score, pa.float64())],
                                                 names=["doc_id", "n_words", "detections", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["word_start"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda d: d["label"]))), ",")
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                          F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("detections")).alias("labels"), "score")
