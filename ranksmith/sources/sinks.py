"""Sinks (B1-B4). Writers only; nothing goes through the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B1: ordered corpus (idx, did, passage) as parquet, sorted by idx
    within range partitions so readers can stream it in order."""
    corpus.repartitionByRange("idx").sortWithinPartitions("idx").write.mode(mode).parquet(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The rows as JSON array files, one array per partition: objects, or the bare
    values of a frame with one string column."""
    one = len(df.columns) == 1 and df.schema[0].dataType.simpleString() == "string"
    # a string as JSON: the only element of an array, without the brackets
    item = F.expr(f"substring(to_json(array(`{df.columns[0]}`)), 2, length(to_json(array(`{df.columns[0]}`))) - 2)") if one else F.to_json(F.struct("*"))

    def lines(batches):
        first = True
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                out.append(("[" if first else ",") + v)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    df.select(item.alias("value")).mapInArrow(lines, "value string").write.mode(mode).text(path)
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for st in fs.listStatus(p):  # the ending that readers look for
        name = st.getPath().getName()
        if name.startswith("part-"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(p, name.rsplit(".", 1)[0] + ".json"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; texts may hold quotes, newlines and white space at their ends."""
    (df.write.mode(mode).options(header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                 ignoreTrailingWhiteSpace=False).csv(path))


def write_embeddings(vectors: DataFrame, path: str, mode: str = "overwrite",
                     by: tuple[str, ...] = ("model", "suite")) -> None:
    """B2: vectors partitioned by model and suite."""
    vectors.write.mode(mode).partitionBy(*[c for c in by if c in vectors.columns]).parquet(path)


def label_pool(run: DataFrame) -> DataFrame:
    """B3 (frame): nested run per (model, task, event) query row, hits in rank order."""
    hits = F.sort_array(F.collect_list(F.struct("rank", "passage", "doc_id")))
    return (run.groupBy("model", "task", "event", "qrow", "query", "qid")
            .agg(hits.alias("hits"))
            .select("model", "task", "event", "qrow", F.col("query").alias("user_query"),
                    F.col("qid").alias("query_id"),
                    F.transform("hits", lambda h: h["passage"]).alias("passages"),
                    F.transform("hits", lambda h: h["doc_id"]).alias("doc_ids")))


def write_label_pool(run: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested JSON per task/event."""
    label_pool(run).write.mode(mode).partitionBy("model", "task", "event").json(path)


def write_metrics(per_event: DataFrame, per_task: DataFrame, overall: DataFrame,
                  stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-event CSVs (one per variant), per-task CSV, overall text with
    4 decimals, stats JSON; one directory per output, partitioned by model."""
    for v in ("zero", "ignore"):
        (per_event.where(F.col("variant") == v).drop("variant")
         .write.mode(mode).option("header", True).partitionBy("model").csv(f"{path}/metrics_{v}_per_event"))
    per_task.write.mode(mode).option("header", True).partitionBy("model").csv(f"{path}/ndcg_per_task")
    overall.select("model", F.col("overall_text").alias("value")).write.mode(mode) \
        .partitionBy("model").text(f"{path}/ndcg_overall")
    stats.write.mode(mode).partitionBy("model").json(f"{path}/retrieval_stats")
