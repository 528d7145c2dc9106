"""Mixing sources to target weights: water-filled targets, repetition rates, hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, stored, text_of

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is stretched beyond this many times its own size.
CAP = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    `sized` has (source, size). Targets share the total of all sizes by weight; a source stops at `cap` times its size
    and the excess is reshared by weight. With sources ordered by cap * size / weight, the stopped ones are a prefix of
    that order, so running sums over the (one row per source) table solve the resharing exactly, without iteration.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (pos + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", weight.alias("w"))
    limit = F.col("source_size") * cap
    order = W.orderBy((limit / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    per = per.select(
        "source", "source_size", "w", limit.alias("limit"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("size_left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    stops = F.col("limit") * F.col("w_left") < F.col("w") * F.col("size_left")
    per = per.withColumn("stops", stops)
    size_free = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0)).over(everything)
    w_free = F.sum("w").over(everything) - F.sum(F.when(F.col("stops"), F.col("w")).otherwise(0)).over(everything)
    shared = (F.col("w") * size_free).cast("double") / F.nullif(w_free, F.lit(0)).cast("double")
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.coalesce(shared, F.lit(0.0)))
    per = per.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))))
    return per.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by (key, seed): the leading 32 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 17) -> DataFrame:
    """Per document (doc_id, size, source_size, target, taken, copies), size in words.

    `copies` is floor(rate) of its source plus one with the probability of the fraction, decided by a hash of doc_id, so
    reruns agree. Null texts and texts without words have size 0; a source without words has target 0 and rate 0, so
    none of its documents is emitted; a null source is a source of its own and the last. Repeated rows are documents of
    their own with the same decision. Columns other than doc_id, text, source are not read.
    """
    sized = stored(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")))
    targets = source_targets(sized, weights, cap)
    # One row per source; the optimizer broadcasts it when the finished aggregate is small and shuffles it otherwise.
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    whole = F.floor("rate")
    copies = (whole + F.when(uniform(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long")
    return rows.select("d.doc_id", "d.size", "t.source_size", "t.target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of docs `copies` times, all its columns kept."""
    sized = stored(docs.select("source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")))
    targets = stored(source_targets(sized, weights, cap).select(F.col("source").alias("__source"), F.col("rate").alias("__rate")))
    whole = F.floor("__rate")
    copies = (whole + F.when(uniform(F.col("doc_id"), seed) < F.col("__rate") - whole, 1).otherwise(0)).cast("int")
    rows = docs.join(checked_broadcast(targets, 100_000), docs["source"].eqNullSafe(F.col("__source")), "inner")
    rows = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), copies)))
    return rows.select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), per AS (
  SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM per0
), run AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_left,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM per WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, encode(source) NULLS LAST)
), cut AS (
  SELECT *, 3 * source_size * w_left < w * size_left AS stops FROM run
), tgt AS (
  SELECT source, source_size,
         CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * (sum(source_size) OVER () - sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(w) OVER () - sum(CASE WHEN stops THEN w ELSE 0 END) OVER () AS DOUBLE) END AS target
  FROM cut
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM tgt
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (floor(t.rate) + CASE WHEN CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':17'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < t.rate - floor(t.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(t.rate) + CASE WHEN CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':17'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < t.rate - floor(t.rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM sized d JOIN rated t ON d.source IS NOT DISTINCT FROM t.source
"""
