"""The corpus pipeline: toxicity, exact dedup, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all
but the last return the columns of documents.  run() applies them to the whole documents table, each
result written as Parquet and read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import chunk_dedup, exact_dedup, packing, simhash, toxicity
from veilspark.llm.common import shared_folder, table
from veilspark.llm.queries import tokenizer

#: Documents with this score or more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose calibrated score reaches TOXIC go."""
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts one row stays, whatever its id."""
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near-duplicates the document with the smallest id stays."""
    return simhash.near_dedup(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that a document with a smaller id holds are cut from the texts."""
    cut = chunk_dedup.dedup_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sequences of at most 1024 ids, as their pieces with the ids themselves."""
    return packing.pack_sequences(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("substring_dedup", cut_passages), ("packing", pack)]

#: SQL can express neither the classifier nor chunks and packing; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus, from the documents table of sf_dir; what is between the stages is deleted as soon as the next has read it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            gone = spark._jvm.org.apache.hadoop.fs.Path(last)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        last = path
    return docs
