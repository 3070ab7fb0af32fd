"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; it is what bytes.split() splits on.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of a table of keys that may be broadcast.
FEW_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; -1 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the cluster shares."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more; it does so when the driver's JVM collects garbage,
    which in a driver with memory to spare may be after the job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few_or_none(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A checkpointed table, to be broadcast in joins if it has at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


def looked_up(rows: DataFrame, values: DataFrame, on: list[str], hot: int) -> DataFrame:
    """rows joined to values, which has one row a key and n, the key's number of rows: keys with over `hot` rows are
    broadcast, if their checked number allows it, so that no task takes in all of a frequent key."""
    frequent = checkpointed(values.where(F.col("n") > hot))
    plain = rows.join(values.where(F.col("n") <= hot), on)
    return plain.unionByName(rows.join(few_or_none(frequent), on)) if frequent.limit(1).count() else plain
