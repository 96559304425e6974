"""Toxic spans by a linear-chain conditional random field.

Method
1. Labelled tokens from labelled documents: among training documents (crc32 of
   the id mod 5 is not 0; at most ``SAMPLE`` per class, by the hash of the id) a word is
   labelled toxic where it stands in a toxic document and its distinct
   contexts (word before, word behind) lie in toxic documents far more often
   than chance allows (G-test corrected for the number of words). Contexts
   instead of documents, so that many copies of one text count once.
2. A two-label chain over the words of a line, with hashed features of a word
   (itself, its first and last letters, its shape) and label transitions, is
   trained on the likelihood of windows around labelled words and of windows
   of other documents; a bounded number of tokens, gathered from the sample.
3. Every document is scored whole: forward-backward marginals for all lines of
   a slice at once (odds recursions, one step per word position). Document
   score: one minus the product of (1 - p) over words with p >= 0.5, or the
   largest p if there is none. ``tag`` also gives the offending character
   offsets.

Defined cases
* null, empty or blank text: score 0, no spans;
* very long texts and lines are tagged whole; equal texts get equal scores;
* labels: null is no label; of several labels of an id the largest counts;
* null doc_id: never labelled, in no fold; scored like any other;
* no labelled row of one of the classes, or no word beyond chance: the score
  is 0 (only toxic labels: 1); an empty table gives an empty result;
* other columns are kept and never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeze, held, text_slices, words

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 4096
#: Windows around labelled words that train the chain, of each sampled document at most, chosen by hash.
WINDOWS = 4
BUCKETS = 1 << 18
AROUND = 8
STEPS = 80
SPAN = 0.5
_EDGE = b".,;:!?#$%&*|\"'()[]{}-_"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def core(word: bytes) -> bytes:
    """A word without punctuation at its ends (all of it if nothing is left)."""
    return word.strip(_EDGE) or word


def word_features(distinct: list[bytes]) -> np.ndarray:
    """Hashed feature slots of each word: itself, first and last letters, shape."""
    import xxhash
    h = xxhash.xxh32_intdigest
    out = np.zeros((len(distinct), 4), np.int64)
    for i, w in enumerate(distinct):
        c = core(w)
        shape = bytes([min(len(c), 12) + 65, 65 + (c != w), 65 + any(x > 127 for x in c), 65 + any(48 <= x < 58 for x in c)])
        out[i] = h(b"w" + c) % BUCKETS, h(b"p" + c[:3]) % BUCKETS, h(b"s" + c[-3:]) % BUCKETS, h(b"x" + shape) % BUCKETS
    return out


def marginals(odds: np.ndarray, offs: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """P(label 1) of each word; ``odds`` = exp(emission score) by word, lines by ``offs``.

    ``trans`` = exp of the 2 x 2 transition weights, ``start`` = exp of the
    start weight of label 1. Lines run side by side, longest first, so a step
    touches only the lines that are that long.
    """
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    starts, lens = offs[:-1][order], n[order]
    steps = int(lens[0]) if len(lens) else 0
    live = np.searchsorted(-lens, -np.arange(steps), side="left")  # lines longer than t
    fwd, bwd = np.empty(len(odds)), np.empty(len(odds))
    (t00, t01), (t10, t11) = trans
    prev = None
    for t in range(steps):
        at = starts[:live[t]] + t
        prev = start * odds[at] if t == 0 else odds[at] * (t01 + prev[:live[t]] * t11) / (t00 + prev[:live[t]] * t10)
        prev = np.clip(prev, 1e-30, 1e30)
        fwd[at] = prev
    back = np.empty(len(lens))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = starts[:k] + t
        more = live[t + 1] if t + 1 < steps else 0
        b = np.ones(k)
        if more:
            nxt = odds[at[:more] + 1] * back[:more]
            b[:more] = np.clip((t10 + t11 * nxt) / (t00 + t01 * nxt), 1e-30, 1e30)
        back[:k] = b
        bwd[at] = b
    both = fwd * bwd
    return both / (1.0 + both)


@dataclass
class Model:
    """Emission weights by feature slot, transition and start weights (log)."""

    theta: np.ndarray
    trans: np.ndarray
    start: float
    constant: float | None = None

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words, word offsets by text)."""
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        lo = np.asarray(lines.offsets).astype(np.int64)
        codes, wo, distinct = words(lines.flatten())
        odds = np.exp(np.clip(self.theta[word_features(distinct)].sum(1), -30, 30)) if distinct else np.zeros(0)
        p = marginals(odds[codes], wo, np.exp(self.trans), float(np.exp(self.start)))
        return p, wo[lo - lo[0]]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(document scores, marginals, word offsets by text)."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), None, None
        p, offs = self.tokens(texts)
        out = np.zeros(len(texts))
        doc = np.repeat(np.arange(len(texts)), np.diff(offs))
        np.maximum.at(out, doc, p)
        hit = p >= SPAN
        clean = np.bincount(doc[hit], weights=np.log1p(-np.minimum(p[hit], 1 - 1e-12)), minlength=len(texts))
        return np.where(clean < 0, -np.expm1(clean), out), p, offs


def _train_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """(text, y) of the sampled training documents: at most ``sample`` per class.
    The sampled ids are few by that bound, so they are broadcast and no text is shuffled."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
           .where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held("id", 0))
           .groupBy("id").agg(F.max("y").alias("y")))
    there = docs.select(F.col(doc_id).cast("long").alias("id")).distinct()
    lab = freeze(lab.join(there, "id", "left_semi"), "toxic-labels")
    ids = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return freeze(d.join(F.broadcast(freeze(ids, "toxic-ids")), "id").select("id", "text", "y"), "toxic-sample")


def _contexts(rows: DataFrame) -> DataFrame:
    """Distinct (word, context, y), the context being the hash of both neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for part in text_slices(batch, 0, 2 << 20):
                codes, offs, distinct = words(part.column(0))
                cores = [core(w) for w in distinct]
                h = np.array([xxhash.xxh64_intdigest(c) for c in cores] + [1], np.uint64)
                seq = np.concatenate([codes, [len(cores)]])
                before, behind = np.roll(seq, 1)[:-1], np.roll(seq, -1)[:-1]
                first = np.zeros(len(codes), bool)
                first[offs[:-1][np.diff(offs) > 0]] = True
                before = np.where(first, len(cores), before)
                last = np.roll(first, -1)
                behind = np.where(last, len(cores), behind)
                ctx = h[before] * np.uint64(0x9E3779B97F4A7C15) + h[behind]
                y = np.repeat(np.asarray(part.column(1)), np.diff(offs))
                words_ = pa.array([c.decode(errors="replace") for c in cores], pa.string()).take(pa.array(codes))
                yield pa.RecordBatch.from_arrays([words_, pa.array(ctx.view(np.int64)), pa.array(y, pa.int32())], names=["word", "ctx", "y"])

    return rows.select("text", "y").mapInArrow(run, "word string, ctx long, y int").distinct()


def toxic_words(rows: DataFrame) -> list[str]:
    """Words whose contexts stand in toxic documents beyond chance (of the sample, whose size bounds them)."""
    c = _contexts(rows).groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    c = freeze(c, "toxic-words")
    t = c.agg(F.sum("a").alias("A"), F.sum("b").alias("B"), F.count(F.lit(1)).alias("V")).first()
    if not t["A"] or not t["B"]:
        return []
    share = t["A"] / (t["A"] + t["B"])
    n = F.col("a") + F.col("b")
    xlogx = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    g = 2 * (xlogx(F.col("a"), n * share) + xlogx(F.col("b"), n * (1 - share)))
    odds = ((F.col("a") + 0.5) / t["A"]) / ((F.col("b") + 0.5) / t["B"])
    got = (c.withColumn("g", g).where((F.col("g") > 2 * (np.log(t["V"]) + 7)) & (odds > 8))
           .orderBy(F.desc("g"), "word").select("word").collect())
    return [r.word for r in got]


def _windows(rows: DataFrame, lexicon: list[str], windows: int = WINDOWS) -> DataFrame:
    """Training sequences (words, y of each word): windows around labelled words
    (toxic documents, ``windows`` of each, by the hash of their places), one other window of every document."""
    lex = {w.encode() for w in lexicon}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            seqs, tags = [], []
            for doc, t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w = (t or "").encode().lower().split()
                if not w:
                    continue
                hit = [i for i, x in enumerate(w) if y and core(x) in lex]
                at = xxhash.xxh32_intdigest(str(doc)) % len(w)
                hit = sorted(hit, key=lambda i: (xxhash.xxh32_intdigest(f"{doc}:{i}"), i))[:windows]
                for m in [*hit, at]:
                    a, b = max(0, m - AROUND), min(len(w), m + AROUND + 1)
                    seqs.append([x.decode(errors="replace") for x in w[a:b]])
                    tags.append([int(bool(y) and core(x) in lex) for x in w[a:b]])
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32()))], names=["w", "y"])

    return rows.select("id", "text", "y").mapInArrow(run, "w array<string>, y array<int>")


def train(seqs: list[list[str]], tags: list[list[int]], steps: int = STEPS, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """Gradient ascent (Adagrad) on the mean log-likelihood of the sequences."""
    names = sorted({w for s in seqs for w in s})
    at = {w: i for i, w in enumerate(names)}
    feats = word_features([w.encode() for w in names])
    codes = np.array([at[w] for s in seqs for w in s], np.int64)
    y = np.array([t for s in tags for t in s], float)
    offs = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    first = np.zeros(len(y), bool)
    first[offs[:-1]] = True
    nxt = np.flatnonzero(~first)  # words with one before them in the sequence
    theta, trans, start = np.zeros(BUCKETS), np.zeros((2, 2)), 0.0
    g2, gt2, gs2 = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    yp, yn = y[nxt - 1], y[nxt]
    seen = np.array([[((1 - yp) * (1 - yn)).sum(), ((1 - yp) * yn).sum()], [(yp * (1 - yn)).sum(), (yp * yn).sum()]])
    for _ in range(steps):
        odds = np.exp(np.clip(theta[feats].sum(1), -30, 30))[codes]
        e, s = np.exp(trans), float(np.exp(start))
        p = marginals(odds, offs, e, s)
        # pairwise marginals from the two neighbours' forward and backward odds
        fwd, bwd = _messages(odds, offs, e, s)
        f, o, b = fwd[nxt - 1], odds[nxt], bwd[nxt]
        w00, w01, w10, w11 = e[0, 0] + 0 * f, e[0, 1] * o * b, f * e[1, 0], f * e[1, 1] * o * b
        z = w00 + w01 + w10 + w11
        want = np.array([[(w00 / z).sum(), (w01 / z).sum()], [(w10 / z).sum(), (w11 / z).sum()]])
        d = np.bincount(codes, weights=y - p, minlength=len(names))
        grad = np.zeros(BUCKETS)
        for k in range(feats.shape[1]):
            grad += np.bincount(feats[:, k], weights=d, minlength=BUCKETS)
        grad -= l2 * len(y) * theta
        gt, gs = seen - want, float((y[first] - p[first]).sum())
        g2 += grad ** 2
        gt2 += gt ** 2
        gs2 += gs ** 2
        theta += rate * grad / np.sqrt(g2)
        trans += rate * gt / np.sqrt(gt2)
        start += rate * gs / np.sqrt(gs2)
    return Model(theta, trans - trans[0, 0], start)


def _messages(odds: np.ndarray, offs: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """(forward odds, backward odds); short sequences, for training."""
    p = marginals(odds, offs, trans, start)
    both = p / np.maximum(1 - p, 1e-300)
    fwd = np.empty(len(odds))
    n = np.diff(offs)
    prev = None
    for t in range(int(n.max()) if len(n) else 0):
        live = offs[:-1][n > t] + t
        f = start * odds[live] if t == 0 else odds[live] * (trans[0, 1] + fwd[live - 1] * trans[1, 1]) / (trans[0, 0] + fwd[live - 1] * trans[1, 0])
        fwd[live] = np.clip(f, 1e-30, 1e30)
    return fwd, both / fwd


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """Fit on at most ``sample`` labelled training documents of each class and on at most
    ``windows`` windows around the labelled words of a document."""
    rows = _train_rows(docs, labels, doc_id, text, label, sample)
    seen = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    none = Model(np.zeros(1), np.zeros((2, 2)), 0.0, constant=1.0 if seen.get(1) and not seen.get(0) else 0.0)
    lex = toxic_words(rows.select("text", "y")) if len(seen) == 2 else []
    if not lex:
        return none
    got = _windows(rows, lex, windows).toArrow()  # at most windows + 1 of 17 words per sampled document
    return train(got["w"].to_pylist(), got["y"].to_pylist())


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score", spans: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the score as ``out``; with ``spans`` also the
    offending character ranges [start, end) and their marginals."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    at = docs.columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    if spans:
        schema = schema.add(spans, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at):
                s, p, offs = bc.value.score(part.column(at))
                cols, names = [*part.columns, pa.array(s, pa.float64())], [*part.schema.names, out]
                if spans:
                    found = [[] if p is None else _spans(part.column(at)[i], p[offs[i]:offs[i + 1]]) for i in range(part.num_rows)]
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                    names.append(spans)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def _spans(text: pa.Scalar, p: np.ndarray) -> list[dict]:
    """Character ranges of words with p >= SPAN; neighbours on the text are separate spans."""
    if not (p >= SPAN).any():
        return []
    raw = text.as_py().encode()
    out = []
    for m, q in zip(_WORD.finditer(raw), p):
        if q >= SPAN:
            a = len(raw[:m.start()].decode())
            out.append({"start": a, "end": a + len(m.group().decode()), "p": float(q)})
    return out
