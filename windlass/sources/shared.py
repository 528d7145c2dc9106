"""Tables between the steps of an iteration: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
#: Writes to file: folders go without checksum files. The local file system with checksums starts a chmod process for each of
#: its two files, and a JVM that starts one is seen twice in memory until it runs. Other schemes are not touched.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: Folders that this process has named, for clear().
_MADE: list[str] = []


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local master may do without that setting: a temporary folder takes its place. What is written there stays until
    clear(), as results read it when they are computed.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="windlass-")
        spark.conf.set("spark.checkpoint.dir", root)
    _MADE.append(f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this process made below spark.checkpoint.dir; DataFrames that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame) -> DataFrame:
    """df written and read again: computed once, without lineage, safe against lost executors."""
    path = shared_path(df.sparkSession)
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if a count shows at most `rows` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
