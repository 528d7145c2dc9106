"""Triangles over a pixel lattice: containment joins by cells, barycentric interpolation, adjacency, box overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mesh


def barycentric(rows: DataFrame, px: str, py: str) -> DataFrame:
    """Adds b1, b2 of (px, py) in the triangle (c0_u, c0_v) .. (c2_u, c2_v); null in a degenerate one."""
    c = lambda i, x: F.col(f"c{i}_{x}")
    area = (c(1, "u") - c(0, "u")) * (c(2, "v") - c(0, "v")) - (c(2, "u") - c(0, "u")) * (c(1, "v") - c(0, "v"))
    b1 = ((F.col(px) - c(0, "u")) * (c(2, "v") - c(0, "v")) - (c(2, "u") - c(0, "u")) * (F.col(py) - c(0, "v"))) / F.nullif(area, F.lit(0.0))
    b2 = ((c(1, "u") - c(0, "u")) * (F.col(py) - c(0, "v")) - (F.col(px) - c(0, "u")) * (c(1, "v") - c(0, "v"))) / F.nullif(area, F.lit(0.0))
    return rows.withColumns({"b1": b1, "b2": b2})


def rasterize(triangles: DataFrame, vertices: DataFrame, step: float, columns: list[str]) -> DataFrame:
    """(tid, i, j, columns) for the lattice points (i, j) * step inside each triangle's (u, v), borders included.

    The pixels of a triangle's bounding box are made beside the triangle, so there is no join at all.
    """
    rows = mesh.corners(triangles, vertices, ["u", "v", *columns])
    span = lambda x: F.sequence(F.ceil(F.least(*[F.col(f"c{k}_{x}") for k in range(3)]) / step - 1e-9), F.floor(F.greatest(*[F.col(f"c{k}_{x}") for k in range(3)]) / step + 1e-9))
    rows = rows.withColumn("i", F.explode(span("u"))).withColumn("j", F.explode(span("v")))
    rows = barycentric(rows.withColumns({"pu": F.col("i") * step, "pv": F.col("j") * step}), "pu", "pv").where("b1 >= -1e-9 AND b2 >= -1e-9 AND b1 + b2 <= 1 + 1e-9")
    at = lambda x: F.col(f"c0_{x}") + F.col("b1") * (F.col(f"c1_{x}") - F.col(f"c0_{x}")) + F.col("b2") * (F.col(f"c2_{x}") - F.col(f"c0_{x}"))
    return rows.select("tid", "i", "j", *[at(x).alias(x) for x in columns])


def sharing_vertices(triangles: DataFrame) -> DataFrame:
    """(a, b): pairs a < b of triangles with a common vertex. A vertex has few triangles; all pairs of these are meant."""
    uses = triangles.select("tid", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    return uses.withColumnRenamed("tid", "a").join(uses.withColumnRenamed("tid", "b"), "v").where("a < b").select("a", "b").distinct()


def box_pairs(a: DataFrame, b: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """(a, b, iou) of axis-parallel boxes (x0, y0, x1, y1) of a and b that overlap. Boxes meet in the cells that they touch."""

    def spread(boxes: DataFrame, side: str) -> DataFrame:
        boxes = boxes.withColumn("i", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))))
        boxes = boxes.withColumn("j", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
        return boxes.select("i", "j", *[F.col(c).alias(f"{side}_{c}") for c in (key, "x0", "y0", "x1", "y1")])

    low = lambda x: F.greatest(f"a_{x}0", f"b_{x}0")
    w, h = F.least("a_x1", "b_x1") - low("x"), F.least("a_y1", "b_y1") - low("y")
    # Two boxes share several cells; they are compared only where their overlap begins.
    first = (F.floor(low("x") / cell) == F.col("i")) & (F.floor(low("y") / cell) == F.col("j"))
    pairs = spread(a, "a").join(spread(b, "b"), ["i", "j"]).where((w > 0) & (h > 0) & first)
    size = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    return pairs.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), (w * h / (size("a") + size("b") - w * h)).alias("iou"))


def box_overlaps(boxes: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """(a, b, iou) of box_pairs among one set of boxes, a < b."""
    return box_pairs(boxes, boxes, cell, key).where("a < b")
