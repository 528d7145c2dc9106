"""Evaluation: confusion, intersection over union, average precision, greedy suppression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import raster


def confusion(rows: DataFrame, pred: str, gt: str) -> DataFrame:
    return rows.groupBy(F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count("*").alias("n"))


def iou(rows: DataFrame, pred: str, gt: str) -> DataFrame:
    """Per class TP / (TP + FP + FN). One pass: every row counts for its prediction, its truth, and both if they agree."""
    parts = F.explode(F.array(F.struct(F.col(pred).alias("c"), F.lit(1).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("t")), F.struct(F.col(gt).alias("c"), F.lit(0).alias("p"), F.lit(1).alias("g"), (F.col(pred) == F.col(gt)).cast("int").alias("t"))))
    per = rows.select(parts.alias("r")).groupBy(F.col("r.c").alias("cls")).agg(F.sum("r.p").alias("p"), F.sum("r.g").alias("g"), F.sum("r.t").alias("tp"))
    return per.select("cls", (F.col("tp") / (F.col("p") + F.col("g") - F.col("tp"))).alias("iou"))


def average_precision(rows: DataFrame, cls: str, conf: str, hit: str, key: str) -> DataFrame:
    """Per class the area under precision's monotone envelope over recall, from detections with a hit flag; ties by key."""
    w = W.partitionBy(cls).orderBy(F.desc(conf), key)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col(hit).cast("int")).over(W.partitionBy(cls))
    rows = rows.select(cls, conf, key, F.col(hit).cast("int").alias("h"), F.sum(F.col(hit).cast("int")).over(run).alias("tp"), F.row_number().over(w).alias("n"), total.alias("total"))
    rows = rows.withColumn("precision", F.col("tp") / F.col("n"))
    best = F.max("precision").over(W.partitionBy(cls).orderBy(F.asc(conf), F.desc(key)).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("best", best).groupBy(cls).agg((F.sum(F.col("h") * F.col("best")) / F.nullif(F.max("total"), F.lit(0))).alias("ap"))


def eleven_points(rows: DataFrame, cls: str, conf: str, hit: str, key: str) -> DataFrame:
    """Per class with a hit the mean over recalls 0, 0.1 .. 1 of the best precision at that recall or more; ties by key."""
    w = W.partitionBy(cls).orderBy(F.desc(conf), key)
    h = F.col(hit).cast("int")
    rows = rows.select(cls, F.sum(h).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("tp"), F.row_number().over(w).alias("n"), F.sum(h).over(W.partitionBy(cls)).alias("total")).where("total > 0")
    rows = rows.withColumns({"rec": F.col("tp") / F.col("total"), "prec": F.col("tp") / F.col("n")})
    best = [F.coalesce(F.max(F.when(F.col("rec") >= level / 10.0 - 1e-12, F.col("prec"))), F.lit(0.0)) for level in range(11)]
    return rows.groupBy(cls).agg((sum(best[1:], best[0]) / 11.0).alias("ap"))


def precision_recall(rows: DataFrame, pred: str, gt: str) -> DataFrame:
    """(cls, n_pred, n_gt, n_true, precision, recall): 0 where a class is never predicted or never true. One pass."""
    parts = F.explode(F.array(F.struct(F.col(pred).alias("c"), F.lit(1).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("t")), F.struct(F.col(gt).alias("c"), F.lit(0).alias("p"), F.lit(1).alias("g"), (F.col(pred) == F.col(gt)).cast("int").alias("t"))))
    per = rows.select(parts.alias("r")).groupBy(F.col("r.c").alias("cls")).agg(F.sum("r.p").alias("n_pred"), F.sum("r.g").alias("n_gt"), F.sum("r.t").alias("n_true"))
    share = lambda n: F.coalesce(F.col("n_true") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    return per.withColumns({"precision": share("n_pred"), "recall": share("n_gt")})


def matched(detections: DataFrame, truths: DataFrame, cell: float, least: float) -> DataFrame:
    """(id, score, truth, hit): each detection's truth of the greatest overlap, ties to the smaller id, and whether it counts.

    Boxes are (id, x0, y0, x1, y1); detections have a score. Of the detections whose best truth overlaps by more than `least`,
    the one with the greatest score, ties to the smaller id, is the truth's hit. truth is null where nothing overlaps.
    """
    pairs = raster.box_pairs(detections, truths, cell)
    best = pairs.groupBy("a").agg(F.max(F.struct("iou", (-F.col("b")).alias("n"))).alias("best")).select(F.col("a").alias("id"), (-F.col("best.n")).alias("truth"), "best.iou")
    rows = detections.select("id", "score").join(best, "id", "left")
    first = rows.where(F.col("iou") > least).groupBy("truth").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("first")).select("first.id", F.lit(True).alias("hit"))
    return rows.join(first, "id", "left").select("id", "score", "truth", F.coalesce("hit", F.lit(False)).alias("hit"))


def nms_1d(rows: DataFrame, part: str, low: str, high: str, score: str, key: str, overlap: float) -> DataFrame:
    """Greedy suppression per part: by falling score, a segment stays unless it overlaps a kept one by more than `overlap`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score, key], ascending=[False, True])
        lo, hi = frame[low].to_numpy(float), frame[high].to_numpy(float)
        keep: list[int] = []
        for i in range(len(frame)):
            if all((min(hi[i], hi[j]) - max(lo[i], lo[j])) / (max(hi[i], hi[j]) - min(lo[i], lo[j])) <= overlap for j in keep):
                keep.append(i)
        return frame.iloc[keep]

    return rows.groupBy(part).applyInPandas(run, rows.schema)
