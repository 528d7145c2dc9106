"""Exact dedup over an extendible-hash index kept in shared files. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checked_broadcast, shared_dir, stored, text_of

#: A bucket with more distinct keys than this is split.
CAPACITY = 50_000


def directory_of(cells: DataFrame, depth: int, capacity: int = CAPACITY) -> DataFrame:
    """Extendible hashing over the numbers n of distinct keys per cell, a `depth`-bit prefix of the keys: (cell, local, bucket).

    From one bucket of local depth 0, an overfull bucket splits by one more bit, and the directory doubles where that
    passes its depth; so a cell's bucket is its shortest prefix with no more keys than the capacity. Cells that are
    overfull at full depth stay whole, and chains keep their keys apart. Buckets are numbered 2**local + prefix.
    """
    steps = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local"))
    steps = steps.withColumn("bucket", F.expr(f"shiftleft(1L, local) + shiftrightunsigned(cell, {depth} - local)"))
    fits = steps.groupBy("bucket").agg(F.sum("n").alias("total")).where(F.col("total") <= capacity).select("bucket")
    deepest = F.expr(f"shiftleft(1L, {depth}) + cell")
    found = steps.join(fits, "bucket").groupBy("cell").agg(F.min_by(F.struct("local", "bucket"), "local").alias("b"))
    return cells.select("cell").join(found, "cell", "left").select("cell", F.coalesce("b.local", F.lit(depth)).alias("local"), F.coalesce("b.bucket", deepest).alias("bucket"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest doc_id (null ids last). doc_id is the document's key: rows that repeat
    it with an equal text count in group_size and share one decision. An empty table gives an empty result; columns
    other than doc_id and text are not read.

    1. Entries (key hash, digest, lengths, doc_id) of all rows; the counts of key prefixes build the directory, whose depth
       grows with the number of rows.
    2. The entries go to the buckets' files in the shared folder; REBALANCE lets the engine split a hot bucket.
    3. Owner tasks read the key ranges and count each key's chain; map-side combine folds a hot key first.
    4. Texts of keys that occur twice or more are grouped by (key, text), which compares their bytes and keeps colliding
       keys apart.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    norm = F.translate(text_of(), SPACE, "")
    entries = stored(
        docs.select("doc_id", F.length(text_of()).alias("n_cp"), norm.alias("norm")).select(
            "doc_id", "n_cp", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256")
        )
    )
    # Eight times as many cells as full buckets: the depth grows with the input, and the directory stays in tables.
    depth = max(1, math.ceil(math.log2(max(1, entries.count()) / capacity + 1)) + 3)
    cell = F.shiftrightunsigned("h", 64 - depth)
    cells = entries.select("h").distinct().groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    directory = stored(directory_of(stored(cells), depth, capacity).select("cell", "bucket"))

    path = shared_dir(spark)
    placed = entries.withColumn("cell", cell).join(checked_broadcast(directory), "cell").drop("cell")
    placed.hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    index = spark.read.schema("doc_id long, n_cp int, h long, text_sha256 string, bucket long").parquet(path)

    chains = index.groupBy("bucket", "h").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "h")
    repeated = stored(index.join(checked_broadcast(stored(chains)), ["bucket", "h"], "left_semi").select(F.col("doc_id").alias("__id")).distinct())
    texts = docs.select("doc_id", "text").join(checked_broadcast(repeated), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    texts = texts.select("doc_id", F.length(text_of()).alias("n_cp"), norm.alias("norm"))
    best = F.min(F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = (
        texts.groupBy(F.xxhash64("norm").alias("h"), "norm")
        .agg(best.alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h", F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), "n")
    )
    found = index.join(stored(groups), ["h", "text_sha256"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
