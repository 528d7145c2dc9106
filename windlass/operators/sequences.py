"""Order-dependent operators: gap clusters, interval merging, prev/next filling, sliding means, strips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_clusters(rows: DataFrame, part: list[str], value: str, gap: float) -> DataFrame:
    """Adds `cluster`: a new one starts where the sorted value is more than `gap` beyond the one before."""
    w = W.partitionBy(*part).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return rows.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("__new").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("__new")


def largest_cluster_mean(rows: DataFrame, part: list[str], value: str, gap: float) -> DataFrame:
    """Per part the mean of its largest gap cluster, the first of equal ones, and its size."""
    per = gap_clusters(rows, part, value, gap).groupBy(*part, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return per.groupBy(*part).agg(F.max_by(F.struct("n", "mean"), F.struct("n", -F.col("cluster"))).alias("b")).select(*part, "b.n", "b.mean")


def merge_intervals(rows: DataFrame, part: list[str], low: str, high: str) -> DataFrame:
    """Unions of overlapping or touching closed intervals per part."""
    w = W.partitionBy(*part).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce((F.col(low) > before).cast("int"), F.lit(0)))
    rows = rows.withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*part, "__g").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("__g")


def prev_next_fill(rows: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Fills nulls by the line through the nearest values on both sides; beyond the ends by the nearest one."""
    # Both frames run from an end of the part, so that each row costs one step.
    back, ahead = (W.partitionBy(*part).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.col(order), F.desc(order)))
    at = F.when(F.col(value).isNotNull(), F.col(order))
    rows = rows.withColumns({
        "__p": F.last(value, True).over(back), "__pi": F.last(at, True).over(back),
        "__n": F.last(value, True).over(ahead), "__ni": F.last(at, True).over(ahead),
    })
    t = (F.col(order) - F.col("__pi")) / F.nullif(F.col("__ni") - F.col("__pi"), F.lit(0))
    line = F.col("__p") + t * (F.col("__n") - F.col("__p"))
    return rows.withColumn(value, F.coalesce(value, line, "__p", "__n")).drop("__p", "__pi", "__n", "__ni")


def sliding_mean(rows: DataFrame, part: list[str], order: str, value: str, half: int) -> DataFrame:
    """Mean over the rows whose order value lies within `half` on either side."""
    return rows.withColumn("mean", F.avg(value).over(W.partitionBy(*part).orderBy(order).rangeBetween(-half, half)))


def tumbling_strips(triangles: DataFrame, corners: list[str], width: float) -> DataFrame:
    """Each triangle once for every strip [s * width, (s + 1) * width) that holds one of its corners."""
    strips = F.array_distinct(F.array(*[F.floor(F.col(c) / width) for c in corners]))
    return triangles.withColumn("strip", F.explode(strips))


def prefix_offsets(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Exclusive running sum over one row per key (a table of groups, not of rows)."""
    w = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(value).over(w), F.lit(0)))


def best_window(rows: DataFrame, keys: list[str], value: str, half: float) -> DataFrame:
    """Per key the value nearest to the mean of its longest window, and n, the number of rows; ties to the smaller value.

    A window runs over the ordered values; whenever one is added, the smallest go until the smallest left is within `half` of
    the mean. Of windows of one length the first counts. Equal values are folded into one with a count on the map side, so a
    key holds its distinct values only.
    """
    per = rows.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__m"))
    lists = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__v", "__m"))).alias("__l"))
    lists = lists.select(*keys, F.col("__l.__v").alias("__v"), F.col("__l.__m").alias("__m"))

    def best(values: list[float], counts: list[int]) -> float | None:
        every = [v for v, m in zip(values, counts, strict=True) if v is not None for _ in range(m)]
        start, total, n, most, mean = 0, 0.0, 0, 0, 0.0
        for i, v in enumerate(every):
            total, n = total + v, n + 1
            while start < i and abs(every[start] - total / n) > half:
                total, n, start = total - every[start], n - 1, start + 1
            if n > most:
                most, mean = n, total / n
        return min(((abs(v - mean), v) for v in values if v is not None), default=(0.0, None))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = batch["__v"].to_pylist(), batch["__m"].to_pylist()
            found = pa.array([best(v, m) for v, m in zip(values, counts, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], found, pa.array([sum(m) for m in counts], pa.int64())], [*keys, value, "n"])

    kinds = {f.name: f.dataType.simpleString() for f in lists.schema}
    return lists.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{value} double", "n long"]))


def spaced(rows: DataFrame, part: str, order: str, value: str, least: float) -> DataFrame:
    """Rows that are kept going through each part in order: the first, and each that is `least` or more from the last kept.

    The rows arrive sorted and pass through as a stream of batches; one number per part is all that is remembered.
    """
    kinds = {f.name: f.dataType for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0.0
        for frame in batches:
            keep = []
            for p, v in zip(frame[part].tolist(), frame[value].tolist(), strict=True):
                new = now is None or p != now or abs(v - last) >= least
                if new:
                    now, last = p, v
                keep.append(new)
            yield frame[keep]

    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items())
    return rows.repartition(part).sortWithinPartitions(part, order).mapInPandas(run, schema)
