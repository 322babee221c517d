"""A training corpus from raw documents: quality, near-dedup, decontamination, mixing, token files.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. :func:`run` writes each stage's rows as Parquet in the shared folder and gives them to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inclina.llm import decontaminate, mixing, quality, simhash, token_files
from inclina.llm.store import stored
from inclina.operators.joins import BROADCAST_ROWS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels that are not held out, does not reject.

    Null and empty texts are scored like any other; repeated rows stay repeated, rows without an id are judged by their text."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(docs, machine) >= quality.GOOD)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of copies (five-word shingles at least 0.8 similar), and all others. SimHash fingerprints
    propose copies, MinHash keys those that fingerprints miss, and whole shingle sets decide.

    Null and empty texts are copies of each other. Rows without an id cannot be named as copies and stay; rows that share
    the smallest id of a group all stay."""
    copies = stored(simhash.near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")), "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(copies) if few else copies, docs["doc_id"] == copies["_copy"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are judged alike."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, repeats included, in the shuffled order of its shards. Rows without words go in with whole
    repetitions of their source alone; a null source is one."""
    return mixing.mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document. A null text has its end id alone; rows without an id come last."""
    return token_files.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("tokens", token_output),
]

#: SQL cannot state hashed classifiers, draws or tokenizers; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
