"""Constrained random walks over a winding graph, and assignment along a spanning tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windlass.sources.shared import materialize

from . import graph


def random_walks(starts: DataFrame, edges: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(walk, node, k) after `steps` steps from starts (walk, node): all walks take a step at once.

    A node's ways are numbered by (dst, k); the first 32 bits of the MD5 of "walk:step:seed" choose among them, so reruns
    repeat the walk; k adds up. A walk without a way on stays where it is. A step joins one row per walk, whatever the degree.
    """
    ways = graph.both_ways(edges.select("src", "dst", "k")).select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("k").alias("dk"))
    ways = materialize(ways.withColumn("number", F.row_number().over(W.partitionBy("node").orderBy("to", "dk")) - 1))
    degrees = materialize(ways.groupBy("node").agg(F.count("*").alias("degree")))
    at = starts.select("walk", "node", F.lit(0.0).alias("k"))
    for step in range(steps):
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", "walk", F.lit(step), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
        tried = at.join(degrees, "node", "left").withColumn("number", F.try_mod(draw, F.col("degree")).cast("int"))
        moved = tried.join(ways, ["node", "number"], "left")
        at = materialize(moved.select("walk", F.coalesce("to", "node").alias("node"), (F.col("k") + F.coalesce("dk", F.lit(0.0))).alias("k")))
    return at


def votes(walks: DataFrame, least: int) -> DataFrame:
    """(node, turns, n): the number of whole turns that most walks give a node, if at least `least` do; ties to the smaller."""
    per = walks.groupBy("node", F.round(F.col("k") / 360.0).cast("long").alias("turns")).agg(F.count("*").alias("n"))
    best = per.groupBy("node").agg(F.max_by(F.struct("turns", "n"), F.struct("n", -F.col("turns"))).alias("b"))
    return best.select("node", "b.turns", "b.n").where(F.col("n") >= least)


def assign_along_tree(tree: DataFrame, root: int) -> DataFrame:
    """(id, f): f is 0 at the root and grows by k along the edges of a tree, whatever its depth."""
    return from_root(graph.forest(tree.select("src", "dst", "k", F.lit(0.0).alias("cost")))[1], root)


def from_root(told: DataFrame, root: int) -> DataFrame:
    """(id, f) of the nodes (id, tree, f) of graph.forest in the root's tree, f counted from the root."""
    at = told.where(F.col("id") == root).select("tree", F.col("f").alias("__f"))
    return told.join(F.broadcast(at), "tree").select("id", (F.col("f") - F.col("__f")).alias("f"))  # one row


def spring_series(start: float, steps: int) -> list[float]:
    """Spring constants that swing about 1, above it and by the reciprocal below; the swing shrinks to 0.1, the last is 1."""
    shrink = (0.1 / (start - 1.0)) ** (1.0 / steps)
    swings = [1.0 + (start - 1.0) * shrink**i for i in range(steps)]
    return [x if i % 2 == 0 else 1.0 / x for i, x in enumerate(swings)] + [1.0]


def spiral(spark, n: int, turns: float = 5.0, pitch: float = 2.0) -> DataFrame:
    """Points on an Archimedean spiral with their true winding angle in degrees."""
    t = F.col("id") / float(n) * 360.0 * turns
    r = pitch * (1.0 + t / 360.0)
    return spark.range(n).select("id", (r * F.cos(F.radians(t))).alias("x"), (F.col("id") % 7).cast("double").alias("y"), (r * F.sin(F.radians(t))).alias("z"), t.alias("w"))
