"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  ``run`` writes every stage as Parquet to the shared
folder and reads it again, so a lost executor never costs more than one stage; a stage's
input, and what the stage kept, goes when its result is written.

A stage returns a lazy DataFrame.  It deletes its own intermediate tables and keeps small
ones (limits, deleted lines, ids) that its result reads; no stage touches another's, so
stages can be chained without writing, and runs can be interleaved.

Defined results: null, empty and very long texts, ties, repeated rows and empty tables are
treated as each operator's docstring says; columns besides doc_id, text, lang and source, of
any name, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm import decontaminate, jaccard, lines, mixing, quality
from keelstone.llm.common import forget, prepare, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses all of its lines stays, with empty text."""
    return lines.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked or equal texts stays."""
    return jaccard.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the documents of which the mix takes any word."""
    sizes = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    return mixing.mix(sizes).filter("taken > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", source_mix),
]

#: Alignment scores and MinHash groups are not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            forget(f"{folder}/{k - 1}")
    return docs
