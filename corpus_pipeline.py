"""A training corpus out of raw documents: five stages, each written as Parquet and reread by the next.

toxicity           documents that the classifier rejects go
simhash            of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest doc_id stays
substring_dedup    passages that an earlier document holds are cut out; emptied documents go
decontamination    documents that hold a benchmark item go
bpe                what is left, as token ids with the digest of what they decode to
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconlink.llm import bpe, chaining, decontam, neardup, toxicity
from reconlink.llm.common import checkpoint_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, folder, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return neardup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return chaining.cut_passages(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontam.clean(docs, table(spark, folder, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, the ids as an array, their number, and the digest of the bytes decoded from them."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: a fitted classifier and fuzzy passages are beyond SQL; tests hold the run against brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder."""
    shared = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
    return STAGES[-1][1](spark, docs, folder)
