"""Corpus pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns the columns of ``docs`` (the last one its ids
digest per row). ``run`` writes each stage's rows as Parquet into the shared
folder and rereads them, so a lost executor repeats one stage's tasks at most.

Rows with null or empty text pass the filters by their scores like any other;
rows without an id are never duplicates; an empty table gives an empty result;
further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.llm import mixing, quality, simhash, spm, toxicity
from ranksmith.llm.common import freeze, table
from ranksmith.llm.queries import tokenizer_path
from ranksmith.operators.corpus import free_names


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, = free_names(docs, "__quality")
    return quality.score_documents(docs, model, out=score).where(F.col(score) >= quality.KEEP).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, = free_names(docs, "__toxic")
    return toxicity.score_documents(docs, model, out=score).where(F.col(score) < toxicity.SPAN).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate."""
    return mixing.mix_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy that the mix takes: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return spm.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: Classifiers, SimHash and SentencePiece are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
