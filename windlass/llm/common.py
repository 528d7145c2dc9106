"""Shared plumbing of the training-data operators: shared work folder, cut lineage, size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.sources.shared import PLAIN_FILES, shared_path

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it stays until shared.clear()."""
    return shared_path(spark, "windlass")


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage with files that survive the loss of any executor and are computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.options(compression="zstd", **PLAIN_FILES)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if a count shows at most `rows` rows; beyond that leave a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16_000_000) -> None:
    """Arrow batches of at most `rows` rows and about `size` bytes, so that a Python worker holds few whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
