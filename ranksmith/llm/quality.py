"""Quality classifier: random Fourier features over document statistics.

Method
1. ``statistics``: numbers of a text (sizes, shares of character classes,
   word and line repetition, markers behind words), computed on Arrow buffers
   for a slice of texts at once; whole texts, no shuffle.
2. Labelled rows of the training folds (crc32 of the id mod 5 is not 0) give
   means and deviations, then random Fourier features
   z = sqrt(2 / D) cos(W x + b), W ~ N(0, 1 / width^2), which approximate a
   Gaussian kernel. Each task sums its part of the normal equations
   (Z'Z, Z'y); parts are added in groups before the last few reach the driver,
   where the D x D ridge system is solved. All labelled rows take part.
3. Isotonic calibration: the same rows are scored, counted per score bin
   (``BINS`` bins over [0, 1], an aggregate in Spark) and pooled by adjacent
   violators; the calibrated score is the non-decreasing share of label 1.

Defined cases
* null or empty text: all statistics 0, scored like any other;
* very long texts are read whole; equal texts get equal scores;
* labels: null quality is no label; several labels of one id each count;
  repeated documents each count;
* null doc_id: in no fold, never labelled; scored, held_out false;
* no labelled row, or only one class: score is the share of label 1 (no
  labels: 1, nothing is rejected); an empty table gives an empty result;
* other columns are kept by ``score_documents`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeze, held, text_slices, words

FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-3
BINS = 4096
SEED = 7
#: Score from which a document is kept.
KEEP = 0.3

# Character classes of the statistics (UTF-8 bytes).
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r", "newline": b"\n", "stop": b".,;:", "bang": b"!?", "bar": b"|",
    "mark": b"#$%&*@^~+=<>_\\/", "bracket": b"()[]{}\"'`-", "wide": bytes(range(128, 256)),
}
NAMES = ["log_bytes", "log_words", "log_lines", *_CLASSES, "word_bytes", "long_words", "distinct_words", "top_word",
         "repeat_lines", "repeat_next", "odd_ends", "upper_words"]
_TABLE = np.zeros(256, np.int64)
for _n, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars)] = _n + 1


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[offs[1:]] - c[offs[:-1]]


def _per_doc_distinct(codes: np.ndarray, doc: np.ndarray, n_docs: int, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct codes, largest count of one code) per document."""
    if not len(codes):
        return np.zeros(n_docs), np.zeros(n_docs)
    key, cnt = np.unique(doc * n_codes + codes, return_counts=True)
    d = key // n_codes
    top = np.zeros(n_docs)
    np.maximum.at(top, d, cnt)
    return np.bincount(d, minlength=n_docs).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    size = np.diff(offs).astype(float)
    out = {"log_bytes": np.log1p(size)}
    k = len(_CLASSES) + 1
    counts = np.zeros(n * k, np.int64)
    for a in range(0, len(raw), 1 << 20):  # a piece of the bytes at a time
        part = raw[a:a + (1 << 20)]
        lo = np.searchsorted(offs, a, side="right") - 1
        hi = np.searchsorted(offs, a + len(part), side="left")
        cut = np.clip(offs[lo:hi + 1], a, a + len(part))
        doc = np.repeat(np.arange(hi - lo), np.diff(cut))
        counts[lo * k:hi * k] += np.bincount(doc * k + _TABLE[part], minlength=(hi - lo) * k)
    counts = counts.reshape(n, k)
    for i, name in enumerate(_CLASSES):
        out[name] = counts[:, i + 1] / np.maximum(size, 1)
    strings = texts.cast(pa.string())
    codes, wo, distinct = words(strings, lower=False)
    nw = np.diff(wo).astype(float)
    out["log_words"] = np.log1p(nw)
    lens = np.array([len(w) for w in distinct], float)
    ends = np.array([w[-1] in b"#$%&*|!" for w in distinct], float)
    upper = np.array([w.isupper() and len(w) > 1 for w in distinct], float)
    per = np.maximum(nw, 1)
    wl = lens[codes] if len(codes) else np.zeros(0)
    out["word_bytes"] = np.log1p(_sums(wl, wo) / per)
    out["long_words"] = _sums(wl > 15, wo) / per
    out["odd_ends"] = _sums(ends[codes], wo) / per if len(codes) else np.zeros(n)
    out["upper_words"] = _sums(upper[codes], wo) / per if len(codes) else np.zeros(n)
    word_doc = np.repeat(np.arange(n), np.diff(wo))
    kinds, top = _per_doc_distinct(codes, word_doc, n, max(len(distinct), 1))
    # against the distinct words that a text of this length usually has (square-root growth)
    out["distinct_words"] = kinds / per
    out["top_word"] = top / per
    same = np.zeros(len(codes))
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (word_doc[1:] == word_doc[:-1])
    out["repeat_next"] = _sums(same, wo) / per
    lines = pc.split_pattern(strings, "\n")
    lc = lines.flatten().dictionary_encode()
    lo = np.asarray(lines.offsets).astype(np.int64)
    lo = lo - lo[0]
    nl = np.maximum(np.diff(lo).astype(float), 1)
    out["log_lines"] = np.log1p(np.diff(lo).astype(float) * (size > 0))
    lk, _ = _per_doc_distinct(np.asarray(lc.indices).astype(np.int64), np.repeat(np.arange(n), np.diff(lo)), n,
                              max(len(lc.dictionary), 1))
    out["repeat_lines"] = (1 - lk / nl) * (size > 0)
    return np.stack([out[x] for x in NAMES], axis=1)


@dataclass
class Model:
    """Scaling, random features, ridge weights, calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray | None
    xs: np.ndarray
    ys: np.ndarray
    constant: float

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge score, clipped to [0, 1]."""
        return np.clip(self.features(x) @ self.beta, 0.0, 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.constant)
        return np.interp(self.raw(x), self.xs, self.ys)


def pool(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: bins x (sorted) with n rows and s ones -> steps (x, share)."""
    out: list[list[float]] = []  # first x, last x, rows, ones
    for xi, ni, si in zip(x, n, s):
        out.append([xi, xi, ni, si])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1][1:] = [last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    xs = np.array([v for o in out for v in (o[0], o[1])])
    ys = np.array([o[3] / o[2] for o in out for _ in (0, 1)])
    return xs, ys


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """Statistics and label of the training rows. The statistics are made
    before the join, so texts are not shuffled."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
           .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held("doc_id", 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                x = statistics(part.column(1))
                arr = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), arr], names=["doc_id", "x"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & ~held("doc_id", 0))
    x = d.mapInArrow(run, "doc_id long, x array<double>")
    return freeze(x.join(lab, "doc_id").select("x", "y"), "quality-training")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = np.asarray(batch.column(0).flatten())
    return flat.reshape(batch.num_rows, -1), np.asarray(batch.column(1))


def _tree_sum(parts: DataFrame, spark, n_parts: int) -> np.ndarray:
    """Sum of the tasks' packed arrays: groups of parts first, then the few sums."""
    fan = max(1, int(np.sqrt(max(n_parts, 1))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(1):
                a = np.frombuffer(v.as_buffer(), np.float64)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    sums = parts.repartition(fan, "part").mapInArrow(add, "part long, data binary").collect()
    return sum((np.frombuffer(bytes(r.data), np.float64) for r in sums), np.zeros(1))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> Model:
    """Fit on all labelled rows of the training folds."""
    spark, dim = docs.sparkSession, len(NAMES)
    rows = _labelled(docs, labels, doc_id, text, label)
    cols = [F.col("x")[i] for i in range(dim)]
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                     *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    n, share = first["n"], first["y"]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / width, (dim, features)), rng.uniform(0, 2 * np.pi, features)
    if not n or share in (0.0, 1.0):
        return Model(np.zeros(dim), np.ones(dim), w, b, None, np.zeros(1), np.zeros(1), 1.0 if not n else float(share))
    mean = np.array([first[f"m{i}"] for i in range(dim)])
    scale = np.array([first[f"s{i}"] for i in range(dim)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, b, None, np.zeros(1), np.zeros(1), float(share))
    size = features + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, y = _matrix(batch)
            z = model.features(x)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
                                         names=["part", "data"])

    eq = _tree_sum(rows.mapInArrow(normal, "part long, data binary"), spark, rows.rdd.getNumPartitions()).reshape(size, size + 1)
    reg = ridge * n * np.eye(size)
    reg[-1, -1] = 0.0
    model.beta = np.linalg.solve(eq[:, :size] + reg, eq[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnt, ones = np.zeros(bins + 1), np.zeros(bins + 1)
        for batch in batches:
            x, y = _matrix(batch)
            at = np.rint(model.raw(x) * bins).astype(int)
            cnt += np.bincount(at, minlength=bins + 1)
            ones += np.bincount(at, weights=y, minlength=bins + 1)
        at = np.flatnonzero(cnt)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cnt[at]), pa.array(ones[at])], names=["bin", "n", "s"])

    per = (rows.mapInArrow(binned, "bin long, n double, s double").groupBy("bin")
           .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())  # at most bins + 1 rows
    per.sort(key=lambda r: r.bin)
    model.xs, model.ys = pool(np.array([r.bin for r in per]) / bins, np.array([r.n for r in per]), np.array([r.s for r in per]))
    return model


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as ``out``; one pass over the texts."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # D x 20 numbers and at most 2 * (BINS + 1) steps
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at):
                s = bc.value.score(statistics(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)
