"""Embedding jobs.

E1 runs a user encoder over Arrow batches in ``mapInPandas``: the encoder is
built once per Python worker and each Arrow batch (``batch_size`` rows) is
one forward pass, so the per-row cost is a vectorised call, never a Python
loop in the JVM path. E2 is a model-free encoder (token -> hashed bucket and
sign, counts per bucket), so the search path can run without a trained model. Pooling (E4-E6) works on token-state tables.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Lower-cased word tokens (letters and digits)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: F.length(x) > 0)


def _hashed(df: DataFrame, id_col: str, text_col: str, dim: int, dense: bool, normalize: bool) -> DataFrame:
    """Hashed token counts of each row, made inside the row's Arrow batch (no
    shuffle): a batch's distinct tokens are hashed once and scattered."""
    import pyarrow as pa
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ("embedding array<double>" if dense else "buckets array<long>, vals array<double>")

    def run(batches):
        import hashlib
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                toks = part.column(1)
                n = part.num_rows
                enc = toks.flatten().dictionary_encode()
                digest = [hashlib.md5(t.encode()).hexdigest() for t in enc.dictionary.to_pylist()]
                bucket = np.array([int(h[:8], 16) % dim for h in digest], np.int64)
                sign = np.array([1.0 if int(h[8], 16) < 8 else -1.0 for h in digest])
                codes = np.asarray(enc.indices, dtype=np.int64)
                size = np.array(toks.value_lengths().fill_null(0))
                cell = np.repeat(np.arange(n), size) * dim + (bucket[codes] if len(codes) else codes)
                total = np.bincount(cell, weights=sign[codes] if len(codes) else None, minlength=n * dim).astype(float).reshape(n, dim)
                if dense:
                    if normalize:
                        norm = np.sqrt((total ** 2).sum(1, keepdims=True))
                        total = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
                    ends = np.arange(0, n * dim + 1, dim, dtype=np.int32)
                    cols = [pa.ListArray.from_arrays(ends, pa.array(total.ravel()))]
                    names = ["id", "embedding"]
                else:
                    row, b = np.nonzero(np.bincount(cell, minlength=n * dim).reshape(n, dim))
                    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                    cols = [pa.ListArray.from_arrays(ends, pa.array(b.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(total[row, b]))]
                    names = ["id", "buckets", "vals"]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    return df.select(F.col(id_col).alias("id"), tokens(text_col).alias("toks")).mapInArrow(run, schema)


def hash_arrays(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """E2, one row per text: (id, buckets, vals), the buckets that hold a token."""
    return _hashed(df, id_col, text_col, dim, dense=False, normalize=False)


def hash_features(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """E2, sparse form: (id, bucket, value) with value = signed token count.

    bucket = first 8 hex digits of md5(token) mod dim; sign from the 9th hex digit.
    """
    h = hash_arrays(df, id_col, text_col, dim)
    return (h.select("id", F.explode(F.arrays_zip("buckets", "vals")).alias("z"))
            .select("id", F.col("z.buckets").alias("bucket"), F.col("z.vals").alias("value")))


def hash_encode(df: DataFrame, id_col: str, text_col: str, dim: int = 64,
                normalize: bool = True) -> DataFrame:
    """E2 + E3: dense hashed vectors (id, embedding ARRAY<DOUBLE>); rows
    without tokens get the zero vector."""
    return _hashed(df, id_col, text_col, dim, dense=True, normalize=normalize).withColumnRenamed("id", id_col)


def embed_texts(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                dim: int, batch_size: int = 64, normalize: bool = True,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One vector per text with a user encoder.

    ``make_encoder()`` runs once per Python worker and returns
    ``encode(list_of_texts) -> float array [n, dim]``. Rows keep their other
    columns in ``keep``; order inside a partition is preserved.
    """
    cols = [*keep, text_col]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + ["embedding array<float>"])

    def run(batches):
        enc = make_encoder()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                vecs = np.asarray(enc(part[text_col].fillna("").tolist()), dtype=np.float32)
                if vecs.shape != (len(part), dim):
                    raise RuntimeError(f"encoder returned {vecs.shape}, expected {(len(part), dim)}")
                if normalize:
                    n = np.linalg.norm(vecs, axis=1, keepdims=True)
                    vecs = np.where(n > 0, vecs / np.where(n > 0, n, 1), 0)
                out = part[list(keep)].copy()
                out["embedding"] = list(vecs)
                yield out

    return df.select(*cols).mapInPandas(run, schema)


def numpy_hash_encoder(dim: int = 64):
    """A Python-side encoder with the same definition as :func:`hash_encode`
    (for E1 tests and for workers without a model)."""
    import hashlib
    import re

    split = re.compile(r"[^\w]+|_", re.UNICODE)

    def make():
        def enc(texts):
            out = np.zeros((len(texts), dim))
            for r, t in enumerate(texts):
                for tok in split.split(t.lower()):
                    if not tok:
                        continue
                    h = hashlib.md5(tok.encode("utf-8")).hexdigest()
                    out[r, int(h[:8], 16) % dim] += 1.0 if int(h[8], 16) < 8 else -1.0
            return out
        return enc
    return make


# ---- pooling over token states (text_id, pos, mask, state) -------------------

def pool_cls(states: DataFrame) -> DataFrame:
    """State of the first position."""
    return states.groupBy("text_id").agg(F.min_by("state", "pos").alias("pooled"))


def pool_last(states: DataFrame) -> DataFrame:
    """E5: state of the last position whose mask is 1 (same result for left
    and right padding)."""
    return (states.where(F.col("mask") == 1).groupBy("text_id")
            .agg(F.max_by("state", "pos").alias("pooled")))


def pool_mean_vector(states: DataFrame) -> DataFrame:
    """Masked mean, one vector per text (text_id, pooled ARRAY<DOUBLE>).

    States are summed as vectors with a partial sum in every task before the shuffle, so one row per text and task
    moves, not one per token and dimension. A null component is left out of its mean (all null: null); the
    states of one text have one length, else Spark raises."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    value = F.transform("state", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    known = F.transform("state", lambda x: x.isNotNull().cast("double"))
    s = (states.where((F.col("mask") == 1) & F.col("state").isNotNull()).groupBy("text_id")
         .agg(vector_to_array(Summarizer.sum(array_to_vector(F.concat(value, known)))).alias("s")))
    half = (F.size("s") / 2).cast("int")
    return s.select("text_id", F.zip_with(F.slice("s", F.lit(1), half), F.slice("s", half + 1, half),
                                          lambda v, n: F.when(n > 0, v / n)).alias("pooled"))


def pool_mean(states: DataFrame) -> DataFrame:
    """E6 in long form (text_id, dim, value); exploded after the means are made."""
    return pool_mean_vector(states).select("text_id", F.posexplode("pooled").alias("dim", "value"))


def embed_missing(todo: DataFrame, store: DataFrame, keys=("model", "suite", "content_md5"),
                  rebuild: bool = False) -> DataFrame:
    """Rows of ``todo`` not yet in the vector store (anti-join on keys)."""
    if rebuild:
        return todo
    return todo.join(store.select(*keys), on=list(keys), how="left_anti")


def check_embedding_count(texts: DataFrame, vectors: DataFrame, keys=("model", "suite")) -> DataFrame:
    """Per group, number of texts vs number of vectors; rows where they
    differ are the errors (empty frame = all good)."""
    a = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_texts"))
    b = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vectors"))
    return (a.join(b, list(keys), "full_outer").fillna(0, subset=["n_texts", "n_vectors"])
            .where(F.col("n_texts") != F.col("n_vectors")))


# ---- a vector store by hash prefix ---------------------------------------------

STORE_KEYS = ("model", "suite", "content_md5")


def _in_store(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("prefix", F.substring("content_md5", 1, digits))


def write_store(vectors: DataFrame, path: str, digits: int = 2, mode: str = "append") -> None:
    """B2 by hash prefix: (model, suite, content_md5, embedding) in folders model / suite / first ``digits`` hex digits of
    content_md5. Rows are brought together by folder, and a large folder is spread over several tasks again."""
    v = _in_store(vectors.select(*STORE_KEYS, F.col("embedding").cast("array<double>")), digits)
    v.hint("rebalance", "model", "suite", "prefix").write.mode(mode).partitionBy("model", "suite", "prefix").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store; empty where there is none yet. Folder names are read as strings, never as numbers."""
    schema = "content_md5 string, embedding array<double>, model string, suite string, prefix string"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def touched(store: DataFrame, todo: DataFrame, digits: int = 2) -> DataFrame:
    """The store's rows in folders that ``todo`` can hit: a filter on the folder columns, so other folders are not listed
    or read. The folders' names pass the driver, 16 ** ``digits`` prefixes at most; models and suites are those of ``todo``,
    compared by their prefix only when there are over 1,000 pairs of them."""
    prefixes = [r.prefix for r in _in_store(todo, digits).select("prefix").distinct().collect()]
    pairs = todo.select("model", "suite").distinct().limit(1001).collect()
    out = store.where(F.col("prefix").isin([p for p in prefixes if p is not None]))
    if len(pairs) > 1000:
        return out
    for c in ("model", "suite"):
        names = {r[c] for r in pairs}
        some = F.col(c).isin(sorted(n for n in names if n is not None))
        out = out.where(some | F.col(c).isNull() if None in names else some)
    return out


def missing_in_store(todo: DataFrame, path: str, digits: int = 2, rebuild: bool = False) -> DataFrame:
    """E7 against a store: rows of ``todo`` (model, suite, content_md5, ..) whose vector it does not have."""
    if rebuild:
        return todo
    done = touched(read_store(todo.sparkSession, path), todo, digits).select(*[F.col(k).alias(f"__{k}") for k in STORE_KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in STORE_KEYS]
    return todo.join(done, same[0] & same[1] & same[2], "left_anti")


def embed_into_store(texts: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], digits: int = 2) -> DataFrame:
    """Encode the texts (model, suite, text) that the store does not have, add them, and return the
    store's rows for ``texts``, one per (model, suite, text).

    ``encode(df with content_md5, text) -> (content_md5, embedding)`` gets each text once. A null text has no vector.
    The rows are added when all are written, so a run that was lost is repeated and finds only what others added."""
    todo = texts.where(F.col("text").isNotNull()).select("model", "suite", F.md5("text").alias("content_md5"), "text").dropDuplicates(list(STORE_KEYS))
    new = missing_in_store(todo, path, digits)
    vec = encode(new.select("content_md5", "text").dropDuplicates(["content_md5"])).select(F.col("content_md5").alias("_md5"), "embedding")
    # the store changes under the plan that reads it: end the plan before it is written
    rows = freeze(new.select(*STORE_KEYS).join(vec, F.col("content_md5") == F.col("_md5")).drop("_md5"), "vectors")
    if not rows.isEmpty():
        write_store(rows, path, digits)
    wanted = todo.select(*[F.col(k).alias(f"__{k}") for k in STORE_KEYS])
    store = touched(read_store(texts.sparkSession, path), todo, digits)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in STORE_KEYS]
    return store.join(wanted, same[0] & same[1] & same[2], "left_semi").select(*STORE_KEYS, "embedding")


def check_store(texts: DataFrame, path: str, digits: int = 2) -> DataFrame:
    """E8 against a store: per (model, suite) of ``texts`` the number of different texts and of their vectors, where these differ."""
    want = texts.where(F.col("text").isNotNull()).select("model", "suite", F.md5("text").alias("content_md5")).distinct()
    lost = missing_in_store(want, path, digits).groupBy("model", "suite").agg(F.count(F.lit(1)).alias("n_lost"))
    n = want.groupBy(F.col("model").alias("__model"), F.col("suite").alias("__suite")).agg(F.count(F.lit(1)).alias("n_texts"))
    j = lost.join(n, F.col("model").eqNullSafe(F.col("__model")) & F.col("suite").eqNullSafe(F.col("__suite")))
    return j.select("model", "suite", "n_texts", (F.col("n_texts") - F.col("n_lost")).alias("n_vectors"))
