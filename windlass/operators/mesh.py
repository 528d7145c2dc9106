"""Grid and mesh operators over long tables: vertices (vid, x, y, z, u, v), triangles (tid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalars import norm, triangle_area

from . import graph


def quad_mesh(grid: DataFrame, i: str, j: str, width: int) -> DataFrame:
    """Two triangles for every cell whose four corners exist; vertex number i * width + j. Corners meet by one key each."""
    cell = F.explode(F.array(*[F.struct((F.col(i) - a).alias("i"), (F.col(j) - b).alias("j"), F.lit(2 * a + b).alias("corner")) for a in (0, 1) for b in (0, 1)]))
    full = grid.select(cell.alias("c")).groupBy("c.i", "c.j").agg(F.countDistinct("c.corner").alias("n")).where("n = 4")
    v = lambda a, b: (F.col("i") + a) * width + F.col("j") + b
    two = F.explode(F.array(F.struct(F.lit(0).alias("h"), v(0, 0).alias("v0"), v(1, 0).alias("v1"), v(0, 1).alias("v2")), F.struct(F.lit(1).alias("h"), v(1, 0).alias("v0"), v(1, 1).alias("v1"), v(0, 1).alias("v2"))))
    return full.select(((F.col("i") * width + F.col("j")) * 2).alias("base"), two.alias("t")).select((F.col("base") + F.col("t.h")).alias("tid"), "t.v0", "t.v1", "t.v2")


def grid_neighbours(grid: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """Adds the four neighbours' values, null where there is none: every cell is sent to those that ask for it."""
    ways = {"top": (-1, 0), "bottom": (1, 0), "left": (0, -1), "right": (0, 1)}
    own = grid.select(F.col(i).alias("__i"), F.col(j).alias("__j"), F.lit("own").alias("__w"), F.col(value).alias("__v"))
    sent = grid.select(F.explode(F.array(*[F.struct((F.col(i) - a).alias("i"), (F.col(j) - b).alias("j"), F.lit(w).alias("w")) for w, (a, b) in ways.items()])).alias("t"), F.col(value).alias("__v"))
    rows = own.union(sent.select("t.i", "t.j", "t.w", "__v")).groupBy("__i", "__j")
    pick = lambda w: F.max(F.when(F.col("__w") == w, F.col("__v")))
    out = rows.agg(F.max((F.col("__w") == "own").cast("int")).alias("__own"), pick("own").alias(value), *[pick(w).alias(w) for w in ways])
    return out.where("__own = 1").select(F.col("__i").alias(i), F.col("__j").alias(j), value, *ways)


def edges_of(triangles: DataFrame) -> DataFrame:
    """(a, b, tid) with a < b, three per triangle."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return triangles.select("tid", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).select("e.a", "e.b", "tid")


def boundary_edges(triangles: DataFrame) -> DataFrame:
    return edges_of(triangles).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def without_non_manifold(triangles: DataFrame) -> DataFrame:
    """Triangles none of whose edges belongs to three triangles or more."""
    odd = edges_of(triangles).groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 2")
    bad = edges_of(triangles).join(odd, ["a", "b"], "left_semi").select("tid").distinct()
    return triangles.join(bad, "tid", "left_anti")


def corners(triangles: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """Triangles with the columns of their vertices as c0_x, c1_x, c2_x, .... A vertex travels once per use, in one shuffle.

    The corners are stacked, joined once, and put together per triangle.
    """
    uses = triangles.select("tid", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("vid")) for i in range(3)])).alias("u")).select("tid", "u.c", "u.vid")
    rows = uses.join(vertices.select("vid", *columns), "vid")
    return rows.groupBy("tid").agg(*[F.max(F.when(F.col("c") == i, F.col(x))).alias(f"c{i}_{x}") for i in range(3) for x in columns])


def areas(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    rows = corners(triangles, vertices, ["x", "y", "z"])
    p = [[F.col(f"c{i}_{x}") for x in "xyz"] for i in range(3)]
    return rows.select("tid", triangle_area(*p).alias("area"))


def stretch(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per triangle its L2 and L-infinity stretch from (u, v) to (x, y, z), and both areas; no stretch without an area."""
    rows = corners(triangles, vertices, ["x", "y", "z", "u", "v"])
    c = lambda i, x: F.col(f"c{i}_{x}")
    area2 = ((c(1, "u") - c(0, "u")) * (c(2, "v") - c(0, "v")) - (c(2, "u") - c(0, "u")) * (c(1, "v") - c(0, "v"))) / 2.0
    rows = rows.withColumn("a2", area2)
    over = lambda x: F.coalesce(x / F.nullif(2.0 * F.col("a2"), F.lit(0.0)), F.lit(0.0))
    # Fixed formulas: the published texture stretch metric.
    du = {x: over(c(0, x) * (c(1, "v") - c(2, "v")) + c(1, x) * (c(2, "v") - c(0, "v")) + c(2, x) * (c(0, "v") - c(1, "v"))) for x in "xyz"}
    dv = {x: over(c(0, x) * (c(2, "u") - c(1, "u")) + c(1, x) * (c(0, "u") - c(2, "u")) + c(2, x) * (c(1, "u") - c(0, "u"))) for x in "xyz"}
    rows = rows.withColumns({"aa": sum((du[x] * du[x] for x in "yz"), du["x"] * du["x"]), "bb": sum((du[x] * dv[x] for x in "yz"), du["x"] * dv["x"]), "cc": sum((dv[x] * dv[x] for x in "yz"), dv["x"] * dv["x"])})
    wide = F.sqrt((F.col("aa") - F.col("cc")) * (F.col("aa") - F.col("cc")) + 4.0 * F.col("bb") * F.col("bb"))
    area3 = triangle_area(*[[c(i, x) for x in "xyz"] for i in range(3)])
    return rows.select("tid", F.sqrt((F.col("aa") + F.col("cc")) / 2.0).alias("l2"), F.sqrt((F.col("aa") + F.col("cc") + wide) / 2.0).alias("linf"), area3.alias("area3"), F.abs("a2").alias("area2"))


def longest_sides(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    rows = corners(triangles, vertices, ["x", "y", "z"])
    side = lambda a, b: norm(*[F.col(f"c{a}_{x}") - F.col(f"c{b}_{x}") for x in "xyz"])
    return rows.select("tid", F.greatest(side(0, 1), side(1, 2), side(2, 0)).alias("side"))


def largest_cluster(triangles: DataFrame) -> DataFrame:
    """The triangles of the largest cluster that is connected by shared vertices; of equal ones that with the smallest tid."""
    links = triangles.select(F.explode(F.array(F.struct(F.col("v0").alias("src"), F.col("v1").alias("dst")), F.struct(F.col("v1").alias("src"), F.col("v2").alias("dst")))).alias("e")).select("e.src", "e.dst")
    vertices = triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("id")).distinct()
    named = triangles.join(graph.components(vertices, links).withColumnRenamed("id", "v0"), "v0")
    best = named.groupBy("component").agg(F.count("*").alias("n"), F.min("tid").alias("least")).agg(F.max_by("component", F.struct("n", -F.col("least"))).alias("component"))
    return named.join(F.broadcast(best), "component", "left_semi").select("tid", "v0", "v1", "v2")  # one row
