"""Structured Streaming forms of the pre-training and embedding steps.

S1 is a stateless projection into a file sink; S2 and S3 act per micro-batch
(``foreachBatch``) and write one folder per epoch, which a repeated epoch
replaces. Each stream runs with
``trigger(availableNow=True)`` so a backlog is processed in bounded
micro-batches and the query stops. Progress is kept beside the output (or in
a given folder), on the store that all executors share, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed as EM
from ..operators import pretrain as PT


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over ``<sf_dir>/<name>.parquet``, a single file or a directory of part files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def clean_lines(stream: DataFrame, text_col: str, max_len: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """S1 body: split texts into lines, drop blank lines, tokenise, truncate
    (C11 + J2) - a stateless projection, valid on a stream."""
    lines = stream.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return PT.line_mode(lines, max_len)


def run_available(stream_out: DataFrame, name: str, path: str, checkpoint: str | None = None):
    """Run a stream over everything available now into Parquet below ``path`` and stop.

    Progress is kept in ``checkpoint``, by default a folder that belongs to the
    output path, so a repeated call with the same path goes on where the last one
    stopped."""
    q = (stream_out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or f"{path.rstrip('/')}-progress-{name}")
         .option("path", path).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_batches(stream: DataFrame, per_batch, checkpoint: str):
    """Feed everything available now to ``per_batch(df, epoch_id)`` in micro-batches and stop.

    An epoch that was interrupted is given again, with the same rows, when the
    stream is started with the same ``checkpoint``; the steps below replace
    what such an epoch wrote."""
    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def epoch_path(path: str, epoch_id: int) -> str:
    return f"{path.rstrip('/')}/epoch_id={epoch_id}"


def pack_step(text_col: str, block: int, path: str, batch_rows: int = 1000, order_cols: tuple[str, ...] = ("file", "line_no")):
    """S2 of one micro-batch: pack it (J4) into the folder of its epoch. The remainder of
    every ``batch_rows`` rows and of the micro-batch is dropped."""
    def per_batch(df: DataFrame, epoch_id: int) -> None:
        ix = PT.with_index(df, list(order_cols)).withColumn("ids", PT.token_ids(PT.tokens(text_col)))
        PT.pack(ix, block, batch_rows).write.mode("overwrite").parquet(epoch_path(path, epoch_id))
    return per_batch


def stream_pack(stream: DataFrame, text_col: str, block: int, path: str, *, batch_rows: int = 1000,
                order_cols: tuple[str, ...] = ("file", "line_no"), checkpoint: str | None = None):
    """Pack each arriving micro-batch below ``path`` (column epoch_id)."""
    step = pack_step(text_col, block, path, batch_rows, order_cols)
    return run_batches(stream, step, checkpoint or f"{path.rstrip('/')}-progress")


def embed_step(path: str, dim: int = 64, keys: tuple[str, ...] = ("model", "suite", "content_md5"), encode=None):
    """S3 of one micro-batch: embed the texts that no earlier epoch has (E7) into the folder of its epoch.

    ``encode(df, id, text, dim)`` -> (id, embedding); by default the hashed encoder."""
    encode = encode or EM.hash_encode

    def per_batch(df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        todo = df.withColumn("content_md5", F.md5("text"))
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        # what an earlier try of this epoch wrote is not done: it is replaced
        done = [e for e in range(epoch_id) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(epoch_path(path, e)))]
        if done:
            todo = EM.embed_missing(todo, spark.read.option("basePath", path).parquet(*[epoch_path(path, e) for e in done]), keys)
        todo = todo.dropDuplicates(list(keys))
        vec = encode(todo.select("content_md5", "text").dropDuplicates(["content_md5"]), "content_md5", "text", dim)
        todo.select(*keys).join(vec, "content_md5").write.mode("overwrite").parquet(epoch_path(path, epoch_id))
    return per_batch


def stream_embed(stream: DataFrame, path: str, *, dim: int = 64, keys: tuple[str, ...] = ("model", "suite", "content_md5"),
                 encode=None, checkpoint: str | None = None):
    """S3: embed only texts not yet in the store at ``path`` as files arrive."""
    return run_batches(stream, embed_step(path, dim, keys, encode), checkpoint or f"{path.rstrip('/')}-progress")
