"""The winding solver: rounds of Jacobi steps over a series of spring constants, deletion of edges that do not fit, re-anchoring.

Nodes are (id, f), edges (src, dst, k, certainty, same_block) with k = f_dst - f_src where an edge is right. An optional
column `fixed` keeps a node's f, or an edge from deletion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalars import closest_winding
from windlass.sources.shared import materialize

from . import graph, walks


@dataclass(frozen=True)
class Schedule:
    """How often and how stiffly the solver steps, and when it deletes edges."""

    iterations: int = 20
    spring: float = 2.0
    steps: int = 3
    pull: float = 2.0
    warm_factor: float = 2.0
    warm_pull: float = 0.25
    warm_spring: float = 6.0
    threshold: float = 3.5
    shrink: float = 0.7
    less: float = 0.1
    least: float = 0.3
    rounds: int = 2

    def phases(self, number: int) -> list[tuple[int, float, float]]:
        """(iterations, pull, spring) of a round: a warm-up in the first one, the series, and a longer last phase."""
        springs = walks.spring_series(self.spring, self.steps)
        warm = [(int(self.iterations * self.warm_factor), self.pull * self.warm_pull, self.warm_spring)] if number == 0 else []
        last = (int(self.iterations * (3.0 if number else 1.5)), self.pull, 1.0)
        return [*warm, *[(self.iterations, self.pull, s) for s in springs[:-1]], last]

    def thresholds(self) -> list[float]:
        """Turns by which an edge may be off, round by round."""
        out, now = [], self.threshold
        for _ in range(self.rounds):
            now = max(self.least, now * self.shrink - self.less)
            out.append(now)
        return out


def without_invalid(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Edges that are fixed or less than `threshold` turns off."""
    off = F.abs("diff") < 360.0 * threshold
    keep = off | F.col("fixed") if "fixed" in edges.columns else off
    return graph.edge_errors(nodes, edges).where(keep).select(*edges.columns)


def fold_step(nodes: DataFrame, edges: DataFrame, push: float = 1.01) -> DataFrame:
    """(id, fold): the mean fold of the neighbours, 1 - fold across edges of one block, pushed out from 1/2 and kept in [0, 1].

    A node without edges keeps its fold.
    """
    links = edges.select("src", "dst", "same_block").union(edges.select("dst", "src", "same_block"))
    seen = links.join(nodes.select(F.col("id").alias("dst"), "fold"), "dst")
    per = seen.groupBy("src").agg(F.avg(F.when(F.col("same_block"), 1.0 - F.col("fold")).otherwise(F.col("fold"))).alias("m"))
    pushed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("m") - 0.5) * push + 0.5))
    return nodes.join(per, F.col("id") == F.col("src"), "left").select("id", F.coalesce(pushed, "fold").alias("fold"))


def anchored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose f is snapped along a spanning tree of the edges that fit best: each to its f plus the whole turns that
    bring it nearest to what the tree says from the tree's smallest node."""
    cost = graph.edge_errors(nodes, edges).select("src", "dst", "k", F.abs("diff").alias("cost"))
    told = graph.forest(cost)[1]
    first = told.agg(F.min("id")).first()[0]
    if first is None:
        return nodes
    told = walks.from_root(told, first)
    start = nodes.where(F.col("id") == first).select(F.col("f").alias("f0"))
    rows = nodes.join(told.select(F.col("id").alias("tid"), F.col("f").alias("tf")), F.col("id") == F.col("tid"), "left").join(F.broadcast(start))  # one row
    return rows.withColumn("f", F.when(F.col("tf").isNull(), F.col("f")).otherwise(closest_winding(F.col("f"), F.col("f0") + F.col("tf")))).select(*nodes.columns)


def solve(nodes: DataFrame, edges: DataFrame, schedule: Schedule | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the schedule: each round steps, deletes what does not fit, and keeps the largest component.

    A step is one job over edges and nodes and leaves a table, as the next one reads it twice.
    """
    schedule = schedule or Schedule()
    nodes, edges = materialize(nodes), materialize(edges)
    for number, threshold in enumerate(schedule.thresholds()):
        links = materialize(graph.both_ways(edges.select("src", "dst", "k", "certainty")))
        for count, pull, spring in schedule.phases(number):
            for _ in range(count):
                nodes = materialize(graph.jacobi_on(nodes, links, pull, spring))
        edges = materialize(without_invalid(nodes, edges, threshold))
        named = graph.components(nodes, edges)
        best = named.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
        kept = materialize(named.join(F.broadcast(best), "component", "left_semi").select("id"))  # one row
        nodes, edges = materialize(nodes.join(kept, "id", "left_semi")), materialize(graph.induced(edges, kept))
    return anchored(nodes, edges), edges
