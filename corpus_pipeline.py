"""Stages from documents to packed training batches, each on what the one before kept.

1. quality classifier: learns from the labelled rows that are among its documents (outside the held-out
   fold) and keeps the documents that score at least 0.7.
2. n-gram Jaccard join: of each group of linked documents the one with the smallest id stays.
3. secret scan: every span found is replaced by a mark; all documents stay, n_chars is counted again.
4. mixing: Poisson replication to weights by the square root of a source's characters.  A document
   may go (count 0) or come several times, which is what the stage is for.
5. packing: length buckets and batches over what the mix holds.

All but the last return the columns that they were given.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versify.llm import jaccard_join, mixing, packing, quality, secret_scan
from versify.llm.common import keep, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", single),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: The classifier and the join are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
