"""Readers (A1-A9).

JSON inputs come as one JSON document per file (an array, or one object over
several lines) or as JSON Lines. Spark's two JSON modes are not
interchangeable (multi-line mode silently reads only the first object of a
JSON Lines file; line mode turns an array file into corrupt records), so the
mode is chosen per file from its head: ``[`` is a document; otherwise the
first non-blank line is a whole value (JSON Lines) or only the beginning of one
(a document). Only that head is read on the driver (like a file listing); the
data itself is read by Spark tasks, and malformed JSON raises.

Row order inside a file matters for ordered corpora. JSON Lines files are
read with the splittable text source; the order key of a line is
(file, split start, position inside the split), which follows the file
order without reading a file in one task. Documents are parsed whole (a
JSON array cannot be split) and exploded with their positions. The order keys
are ``_pos`` and ``_sub``, so that data fields may be called ``pos``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import drop_blank, id_text, strip
from ..operators.corpus import ordered_index
from .json_array import array_elements


def _hadoop_list(spark: SparkSession, path: str, exts: tuple[str, ...], recursive: bool = False) -> list[str]:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = []
    statuses = fs.globStatus(p) or []
    for st in statuses:
        if st.isDirectory():
            for ch in fs.listStatus(st.getPath()):
                if ch.isFile() and ch.getPath().getName().endswith(exts) and ch.getLen() > 0:
                    out.append(ch.getPath().toString())
        elif st.getPath().getName().endswith(exts) and st.getLen() > 0:
            out.append(st.getPath().toString())
    return sorted(out)


def _mode(spark: SparkSession, path: str) -> str:
    """``array``, ``object`` (one JSON object over several lines) or ``lines``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        c = reader.read()
        while c >= 0 and chr(c) in " \t\r\n\ufeff":  # however many blanks there are
            c = reader.read()
        if c < 0 or chr(c) == "[":
            return "array" if c >= 0 else "lines"
        try:
            json.loads(chr(c) + (reader.readLine() or ""))  # one record of a lines file
            return "lines"
        except ValueError:
            return "object" if chr(c) == "{" else "lines"
    finally:
        stream.close()


def split_by_mode(spark: SparkSession, path: str, exts=(".json", ".jsonl")) -> dict[str, list[str]]:
    """Files under ``path`` by mode: array, object, lines."""
    out: dict[str, list[str]] = {"array": [], "object": [], "lines": []}
    for f in _hadoop_list(spark, path, exts):
        out[_mode(spark, f)].append(f)
    return out


def _valid(value: str) -> Column:
    """The JSON text, or an error that names the file."""
    return F.when(F.get_json_object(value, "$").isNotNull(), F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file"))))


def _raw_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, _pos, _sub, value) of the non-blank lines."""
    return (spark.read.text(files)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").cast("long").alias("_pos"),
                    (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_sub"), "value")
            .where(F.length(strip(F.col("value"))) > 0))


def _raw_objects(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, _pos, _sub, value) of files that are one object each."""
    zero = F.lit(0).cast("long")
    return (spark.read.text(files, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), zero.alias("_pos"), zero.alias("_sub"), F.ltrim(F.col("value"), F.lit("\ufeff")).alias("value")))


def _json_texts(spark: SparkSession, files: dict[str, list[str]]) -> list[DataFrame]:
    """(file, _pos, _sub, value) of the values of all files, one frame per mode."""
    read = {"array": array_elements, "object": _raw_objects, "lines": _raw_lines}
    return [read[mode](spark, names) for mode, names in files.items() if names]


def read_json_any(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    """A1: JSON documents and JSON Lines files, one row per object, plus
    ``file`` (``_file`` if the data have that field) and the order keys
    ``_pos``, ``_sub`` that follow the order inside the file. ``path``: a file,
    a directory, a glob or a list of files."""
    files: dict[str, list[str]] = {"array": [], "object": [], "lines": []}
    for p in path if isinstance(path, (list, tuple)) else [path]:
        for mode, names in split_by_mode(spark, p).items():
            files[mode] += names
    texts = _json_texts(spark, files)
    if not texts:
        raise FileNotFoundError(f"no JSON input under {path}")
    parts = []
    for raw in texts:
        elem = _struct(schema) if schema is not None else _infer(raw)
        parts.append(raw.withColumn("value", _valid("value")).select("file", "_pos", "_sub", F.from_json("value", elem).alias("obj")))
    flat = []
    for p in parts:
        fields = [f.name for f in p.schema["obj"].dataType.fields]
        name = "_file" if "file" in fields else "file"
        flat.append(p.select(F.col("file").alias(name), "_pos", "_sub", "obj.*"))
    out = flat[0]
    for p in flat[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _struct(schema) -> StructType:
    """The schema as a type (field names may hold any character)."""
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _infer(raw: DataFrame) -> StructType:
    """Schema of JSON texts, by Spark's own inference."""
    spark = raw.sparkSession
    texts = getattr(raw.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read._jreader.json(texts), spark).schema


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """A2: ``*.json`` string-array files (or one value per line) in name order
    -> (file, pos, passage), ``pos`` ascending in file order. Non-string items
    are kept as their JSON text; blank items are dropped."""
    parts = []
    for raw in _json_texts(spark, split_by_mode(spark, path, (".json",))):
        # a value may be of any kind: it is read as the element of an array
        item = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")
        bad = F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file")))
        item = F.when(F.get_json_object(F.concat(F.lit("["), F.col("value"), F.lit("]")), "$").isNotNull(), F.get(item, 0)).otherwise(bad)
        parts.append(raw.select("file", (F.col("_pos").cast("decimal(30,0)") * (1 << 33) + F.col("_sub")).cast("decimal(30,0)").alias("pos"), item.alias("passage")))
    if not parts:
        raise FileNotFoundError(f"no passages under {path}")
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    return items.withColumn("passage", strip(F.col("passage"))).where(drop_blank("passage")).select("file", "pos", "passage")


def task_event(file_col) -> tuple:
    """A3: file stem split at the first '_' -> (task, event); files that a
    partitioned writer has put below ``task=../event=..`` go by these names."""
    stem = F.regexp_extract(file_col, r"([^/]+?)(\.[^./]*)?$", 1)
    task = F.regexp_extract(stem, r"^([^_]+)", 1)
    event = F.when(F.instr(stem, "_") > 0, F.regexp_extract(stem, r"^[^_]+_(.*)$", 1)).otherwise(stem)
    event = F.regexp_replace(event, r"_label_pool$", "")
    part = lambda k: F.url_decode(F.regexp_extract(file_col, f"/{k}=([^/]+)/", 1))
    named = lambda k, other: F.when(part(k) != "", part(k)).otherwise(other)
    return named("task", task), named("event", event)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``<task>_<event>_qrels.json`` files -> (task, event, qkey, dkey, score) and the file order."""
    df = read_json_any(spark, path, "user_query string, passage string, score double")
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1)
    return df.select(F.regexp_extract(stem, r"^([^_]+)_(.*)_qrels$", 1).alias("task"),
                     F.regexp_extract(stem, r"^([^_]+)_(.*)_qrels$", 2).alias("event"),
                     F.col("user_query").alias("qkey"), F.col("passage").alias("dkey"),
                     F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), "file", "_pos", "_sub")


def read_qrels_ids(spark: SparkSession, path: str, task: str = "QA", event: str = "trec_covid") -> DataFrame:
    """A5: id-keyed judgements (``query-id``, ``corpus-id``, score)."""
    df = read_json_any(spark, path, "`query-id` string, `corpus-id` string, score string")
    return df.select(F.lit(task).alias("task"), F.lit(event).alias("event"),
                     id_text(F.col("`query-id`")).alias("qkey"), id_text(F.col("`corpus-id`")).alias("dkey"),
                     F.coalesce(F.col("score").try_cast("int"), F.lit(0)).cast("double").alias("score"),
                     "file", "_pos", "_sub")


TRAIN_SCHEMA = ("query string, pos array<string>, neg array<string>, pos_scores array<double>, "
                "neg_scores array<double>, prompt string, type string, batch_size int, train_group_size int")


def read_train(spark: SparkSession, paths: list[str], distill: bool = False) -> DataFrame:
    """Training files (files or directories, not recursive, only
    .json/.jsonl, empty files skipped); one dataset per file.

    Adds what the batch planner needs: ``dataset_id`` (the file's number in the
    given order), ``source_file``, ``source_dir`` (the directory it was found in,
    the unit of merging; null for a file given by itself) and ``row_id``, dense
    over all files in file order."""
    files: list[str] = []
    alone: set[str] = set()
    for p in paths:
        found = _hadoop_list(spark, p, (".json", ".jsonl"))
        alone |= set(found) if p.endswith((".json", ".jsonl")) else set()
        files += found
    files = list(dict.fromkeys(files))
    if not files:
        raise FileNotFoundError("no training files")
    df = read_json_any(spark, files, TRAIN_SCHEMA).withColumnRenamed("file", "source_file")
    # the file listing (bounded by the number of files) numbers the datasets, by directory and name
    cut = lambda f: (f.rsplit("/", 2)[-2], f.rsplit("/", 1)[-1])
    known = spark.createDataFrame([(*cut(f), i, f in alone) for i, f in enumerate(files)],
                                  "_dir string, _name string, dataset_id long, _alone boolean")
    split = F.split("source_file", "/")
    df = (df.withColumn("_dir", F.url_decode(F.element_at(split, -2))).withColumn("_name", F.url_decode(F.element_at(split, -1)))
          .join(F.broadcast(known), ["_dir", "_name"]))
    df = (df.withColumn("source_dir", F.when(~F.col("_alone"), F.regexp_replace("source_file", "/[^/]*$", "")))
          .withColumn("dataset", F.col("source_file")).drop("_dir", "_name", "_alone"))
    df = ordered_index(df, ["dataset_id", "_pos", "_sub"], idx="row_id").drop("_pos", "_sub")
    return df if distill else df.drop("pos_scores", "neg_scores")


def read_text(spark: SparkSession, path: str, fmt: str | None = None, column: str = "text") -> DataFrame:
    """The text column of txt / csv / json; other extensions are rejected."""
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "txt":
        df = spark.read.text(path).withColumnRenamed("value", column)
    elif fmt == "csv":
        # a quoted field may hold newlines and doubled quotes, so a CSV file is one task
        df = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).select(column)
    elif fmt in ("json", "jsonl"):
        df = read_json_any(spark, path).select(column)
    else:
        raise ValueError(f"unsupported text format: {fmt}")
    return df


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their ids in the same row."""
    return spark.read.parquet(path)


def read_runs(spark: SparkSession, path: str, prefer: str | None = None, model: str = "run",
              qrels: DataFrame | None = None, keys: str = "text") -> tuple[DataFrame, DataFrame]:
    """Label pools of a model -> (hits, queries) for ``judge.per_query``.

    hits (model, task, event, qrow, qkey, rank, dkey, query, passage, qid,
    doc_id); queries (model, task, event, qrow, qkey) holds every query, also
    those without a hit. ``keys``: 'text' joins by md5 of the texts, 'id' by the ids. With
    ``qrels``, files whose (task, event) has no judgement are skipped. With ``prefer``
    (single-file suites) only the file whose name holds it is used, else
    the first file by name (a choice over the file listing, not the data)."""
    files = _hadoop_list(spark, path, (".json",))
    if prefer is not None and files:
        named = [f for f in files if prefer in f.rsplit("/", 1)[-1]]
        files = named[:1] or files[:1]
    schema = "user_query string, passages array<string>, query_id string, doc_ids array<string>"
    df = read_json_any(spark, files, schema)
    task, event = task_event(F.col("file"))
    base = df.withColumn("task", task).withColumn("event", event)
    if qrels is not None:
        base = base.join(qrels.select("task", "event").distinct(), ["task", "event"], "left_semi")
    base = ordered_index(base, ["task", "event", "file", "_pos", "_sub"], idx="qrow")
    by_text = keys == "text"
    base = base.select(F.lit(model).alias("model"), "task", "event", "qrow",
                       (F.md5("user_query") if by_text else id_text("query_id")).alias("qkey"),
                       F.col("user_query").alias("query"), F.col("query_id").alias("qid"), "passages", "doc_ids")
    hits = base.select("model", "task", "event", "qrow", "qkey", "query", "qid", "doc_ids",
                       F.posexplode(F.coalesce(F.col("passages"), F.array().cast("array<string>")))
                       .alias("rank0", "passage"))
    doc = F.try_element_at("doc_ids", F.col("rank0") + 1)
    hits = hits.select("model", "task", "event", "qrow", "qkey", (F.col("rank0") + 1).cast("long").alias("rank"),
                       (F.md5("passage") if by_text else id_text(doc)).alias("dkey"), "query", "passage", "qid", doc.alias("doc_id"))
    return hits, base.select("model", "task", "event", "qrow", "qkey")
