"""A training corpus from documents: quality rules, near-duplicates, repeated passages, packing.

Each stage takes any table with doc_id (an integer) and text, whatever other columns it has, empty or not, and keeps those
columns, but for the last, whose rows are pieces of documents. Null texts count as empty; very long ones are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import common, packing, quality, simhash, suffix


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; null, empty and very short texts go, repeated rows are judged alike."""
    return quality.keep_good(spark, docs, sf_dir)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id; of rows that repeat id and text one. Rows without
    doc_id stay, of equal texts of them one."""
    return simhash.keep_one(spark, docs, sf_dir)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller doc_id have; documents of which nothing is left go, empty ones
    stay. Rows of one doc_id lose nothing to each other, rows without doc_id lose nothing."""
    return suffix.cut_passages(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; every row of docs is packed, repeated and null ones too."""
    return packing.packing(spark, sf_dir, docs)


STAGES = [("quality_rules", good_texts), ("simhash_near_dedup", without_near_copies), ("suffix_array_dedup", without_passages), ("packing", packed)]

#: Training, components and passages are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _finished(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, f"{name}/_SUCCESS")
    return fs.exists(path)


def run(spark: SparkSession, sf_dir: str, keep: str | None = None) -> DataFrame:
    """The stages in order over documents; each result is written to the shared folder and read again.

    A stage's table goes as soon as the next one is written. keep, a name for the run, lets all of them stay: after a
    failure, a run of the same name over the same tables reads the stages that were finished and goes on from there.
    """
    common.ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{keep or uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        if not (keep and _finished(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before and not keep:
            fs, old = _path(spark, before)
            fs.delete(old, True)
        before = path
    return docs
