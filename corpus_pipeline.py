"""A training corpus from raw documents: quality rules, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads what the one
before wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenseq.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from lumenseq.llm.common import checkpointed, table
from lumenseq.llm.queries import tokenizer_path
from lumenseq.session import ship_package


#: Rows of an Arrow batch. Documents are long, and both ends of the exchange with Python hold whole batches.
BATCH_ROWS = 250
#: Pieces that the packing stage remembers; its processes still hold what the stages before left.
PIECES = 20_000


def prepared(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or any rule go. Null and empty texts have no words and go; a repeated row is judged again."""
    prepared(spark)
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier place has are cut out of the text, from their first line to their last.

    The row stays, with an empty text if all of it repeats. Null texts and ids are left as they are; rows with one id lose the same lines.
    """
    prepared(spark)
    return line_dedup.without_repeats(docs, count=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least id: five-word shingles, 0.8 or more alike.

    Null and empty texts are one class; a repeated row stays once; rows with one id and unlike texts, and rows without an id, all stay.
    """
    prepared(spark)
    return simhash.keep_one(docs, width=5)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null texts contain none; rows without an id stay; rows with one id go together."""
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences; a null or empty text is its end token, a repeated row is packed again."""
    prepared(spark)
    return packing.packed(docs, tokenizer_path(), memory=PIECES)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("pack", pack)]

#: Packing and SimHash can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        if shared:
            path = os.path.join(shared, f"pipeline-{uuid.uuid4().hex}", name)
            made.write.parquet(path)
            docs = spark.read.parquet(path)
        else:
            docs = checkpointed(made)
    return STAGES[-1][1](spark, docs, sf_dir)
