"""A training-corpus pipeline over `documents`: reject, dedup exactly, dedup nearly, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm import exact_dedup, jaccard_join, mixing, pieces, quality
from windlass.llm.common import checked_broadcast, stored, table

#: Near duplicates: five-word shingles, Jaccard similarity of 8 / 10 or more.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 8, 10


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for every row in __n: its doc_id, or for rows without one, and all but the first of
    those that repeat one, a number beyond all doc_ids."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__n", F.col("doc_id").cast("long")))
    firsts = rows.where("__n IS NOT NULL").groupBy(F.col("__n").alias("__id")).agg(F.min("__row").alias("__first"), F.count("*").alias("__count"))
    repeated = stored(firsts.where("__count > 1").select("__id", "__first"))
    least, most, last = rows.agg(F.min("__n"), F.max("__n"), F.max("__row")).first()
    least, most, last = least or 0, most or 0, last or 0
    if most + 1 + last < 1 << 63:
        other = F.lit(most + 1).cast("long") + F.col("__row")
    elif least - 1 - last >= -(1 << 63):
        other = F.lit(least - 1).cast("long") - F.col("__row")
    else:
        raise ValueError("doc_ids leave no room for numbers of rows without one")
    rows = rows.join(checked_broadcast(repeated), F.col("__n") == F.col("__id"), "left")
    number = F.when(F.col("__n").isNull() | (F.col("__row") != F.col("__first")), other).otherwise(F.col("__n"))
    return rows.select(*docs.columns, number.alias("__n"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("__n").alias("doc_id"), "text")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows of _numbered without those whose number is in dropped (doc_id), which is broadcast only if it was counted to be small."""
    ids = stored(dropped.select(F.col("doc_id").alias("__drop")).distinct())
    return rows.join(checked_broadcast(ids), F.col("__n") == F.col("__drop"), "left_anti").drop("__n")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target comes from the table `labels`.

    Null and empty texts have no words and go. Repeated rows get equal decisions, and a null doc_id changes none. Whole texts
    of any length are judged. Without labels only the base rules decide. No documents give none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the most code points, then the smallest number.

    A row's number is its doc_id, or for rows without one, and all but the first that repeat one, a number beyond all ids; so
    every row is decided by its own text, and one row of each group stays whatever the ids are. Null texts equal empty ones.
    """
    rows = _numbered(docs)
    return _without(rows, exact_dedup.exact_dedup(_keyed(rows)).where("NOT kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest number (as in exact_stage), of each group of near duplicates.

    Texts without words, null ones too, are linked with nothing and stay. Texts of fewer words than a shingle are one shingle.
    Very long texts are compared whole.
    """
    rows = _numbered(docs)
    return _without(rows, jaccard_join.jaccard_components(_keyed(rows), NEAR_WORDS, NEAR_NUM, NEAR_DEN).where("component_id <> doc_id"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as their source's target asks.

    Null sources are one source, the last. Rows that repeat a doc_id share its draw, and so do rows without one. Texts without
    words weigh nothing and are repeated like the others of their source.
    """
    return mixing.emit_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids, text_sha256 of the decoded text, lossless.

    One row per row, copies too, which share their segmentation as they share their doc_id. Null and empty texts have no pieces.
    """
    return pieces.round_trip(docs, with_ids=True).select("doc_id", "n_bytes", "n_pieces", "ids", "text_sha256", "lossless")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: Hashed features and sampled segmentations have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
