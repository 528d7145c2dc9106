"""Operators on neighbourhoods: inverse-distance interpolation, grouped features, density clusters, farthest points."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windlass.sources.shared import materialize

from . import graph, spatial


def interpolate(targets: DataFrame, sources: DataFrame, radius: float, key: str, value: str, k: int = 3) -> DataFrame:
    """Value at each target: mean of its k nearest sources within radius, weighted by inverse distance."""
    w = 1.0 / (F.col("d") + 1e-8)
    near = spatial.nearest(targets, sources, radius, key, k)
    return near.groupBy(F.col(f"a_{key}").alias(key)).agg((F.sum(w * F.col(f"b_{value}")) / F.sum(w)).alias(value), F.count("*").alias("n"))


def grouped(points: DataFrame, radius: float, key: str, value: str) -> DataFrame:
    """Per point over its neighbours within radius, itself left out: their number, mean difference and greatest value."""
    pairs = spatial.radius_join(points, points, radius).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    return pairs.groupBy(F.col(f"a_{key}").alias(key)).agg(F.count("*").alias("n"), F.avg(F.col(f"b_{value}") - F.col(f"a_{value}")).alias("mean_diff"), F.max(f"b_{value}").alias("most"))


def dbscan(points: DataFrame, radius: float, least: int, key: str) -> DataFrame:
    """(key, cluster): cluster is the smallest key of its core points, null for noise; a border point takes its nearest core.

    Core points have `least` points within radius, themselves included; cores within radius of each other share a cluster.
    """
    pairs = spatial.radius_join(points, points, radius).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), "d")
    core = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id"))
    links = pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    comp = graph.components(core, links.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    near = pairs.join(comp.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min_by("component", F.struct("d", "b")).alias("cluster"))
    return points.select(key).join(near.withColumnRenamed("a", key), key, "left")


def core_distances(points: DataFrame, radius: float, count: int, key: str) -> DataFrame:
    """(key, core): distance to the count-th nearest point, the point itself counted, of those that have as many within radius."""
    if count <= 1:
        return points.select(key, F.lit(0.0).alias("core"))
    return spatial.k_nearest(points, count - 1, radius, key).where(F.col("rank") == count - 1).select(key, F.col("d").alias("core"))


_LINK = "comp long, cost double, src long, dst long, other long"


def _link_finder(radius: float):
    # a function within, so that it travels to the tasks as a whole
    def links(q: pd.DataFrame, p: pd.DataFrame, most: np.ndarray) -> pd.DataFrame:
        """Of the rows of q the least link of each component (by cost, src, dst) to a row of p of another one, up to most (per row)."""
        p = p.sort_values("pid")  # of equal costs the first is meant, whose (src, dst) is the least of its row
        a, b, step, found = q[["x", "y", "z"]].to_numpy(float), p[["x", "y", "z"]].to_numpy(float), max(1, 2_000_000 // max(1, len(p))), []
        mine, theirs, near, far, keys, names = (f[c].to_numpy() for c in ("comp", "core", "pid") for f in (q, p))
        for s in range(0, len(q) if len(p) else 0, step):
            part = slice(s, s + step)
            d = [a[part, None, i] - b[None, :, i] for i in range(3)]
            d = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            cost = np.maximum(np.maximum(d, near[part, None]), far[None, :])
            cost[(d > radius) | (mine[part, None] == theirs[None, :])] = np.inf
            to = cost.argmin(axis=1)
            least = cost[np.arange(len(to)), to]
            row = np.flatnonzero((least <= most[part]) & (least < np.inf))
            x, y = keys[part][row], names[to[row]]
            found.append(pd.DataFrame({"comp": mine[part][row], "cost": least[row], "src": np.minimum(x, y), "dst": np.maximum(x, y), "other": theirs[to[row]]}))
        if not found:
            return pd.DataFrame({c.split()[0]: [] for c in _LINK.split(", ")})
        return pd.concat(found, ignore_index=True).sort_values(["cost", "src", "dst"], kind="stable").drop_duplicates("comp")

    return links


def _least_links(dealt: DataFrame, leaves: pd.DataFrame, radius: float) -> DataFrame:
    """(comp, x) with x (cost, src, dst, other): the least link of each component that has one.

    The points of a leaf first look in their leaf, and one point of each leaf at those of all others. What a component finds so
    bounds the leaves that its points visit: those at a greater distance, or of its own points alone, hold no better link.
    """
    links = _link_finder(radius)
    at, some = leaves["leaf"].to_numpy(), leaves[["pid", "x", "y", "z", "core", "comp"]]
    low, high = (leaves[[f"{c}_{e}" for c in "xyz"]].to_numpy(float) for e in ("low", "high"))
    first_comp, last_comp, least_core = (leaves[c].to_numpy() for c in ("first_comp", "last_comp", "least_core"))

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        return links(frame, frame, np.full(len(frame), np.inf))

    def reach(frame: pd.DataFrame) -> pd.DataFrame:
        frame, asked = frame.sort_values("most", ignore_index=True), []
        p, comp, most = frame[["x", "y", "z"]].to_numpy(float), frame["comp"].to_numpy(), frame["most"].to_numpy()
        gaps = lambda a, b, to: np.sqrt(sum(np.maximum(0.0, np.maximum(low[to, i] - b[:, None, i], a[:, None, i] - high[to, i])) ** 2 for i in range(3)))
        far, every = np.minimum(most, radius) * (1 + 1e-9), np.flatnonzero(at != frame["leaf"].iloc[0])
        for s in range(0, len(p), 64):  # few points at a time, with the leaves that the box around them reaches
            q, most_q = p[s : s + 64], most[s : s + 64, None]
            to = every[gaps(q.min(axis=0)[None], q.max(axis=0)[None], every)[0] <= far[s : s + 64].max()]
            near = (gaps(q, q, to) <= far[s : s + 64, None]) & (least_core[to] <= most_q)
            near &= (first_comp != last_comp)[to] | (first_comp[to] != comp[s : s + 64, None])
            row, hit = np.nonzero(near)
            asked.append(frame.iloc[s + row].assign(leaf=at[to[hit]]))
        return pd.concat(asked, ignore_index=True)

    def visit(asked: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        return links(asked, frame, asked["most"].to_numpy())

    def least(found: DataFrame) -> DataFrame:
        return found.groupBy("comp").agg(F.min(F.struct("cost", "src", "dst", "other")).alias("x"))

    heads = dealt.sparkSession.createDataFrame(links(some, some, np.full(len(some), np.inf)).astype({"cost": float} | dict.fromkeys(("comp", "src", "dst", "other"), "int64")), _LINK)
    first = materialize(least(dealt.groupBy("leaf").applyInPandas(own, _LINK).union(heads)))
    asked = dealt.join(first.select("comp", F.col("x.cost").alias("most")), "comp", "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))).where("core <= most")
    asked = asked.select("pid", "x", "y", "z", "core", "comp", "leaf", "most")
    asked = asked.groupBy("leaf").applyInPandas(reach, "pid long, x double, y double, z double, core double, comp long, leaf long, most double")
    found = asked.groupBy("leaf").cogroup(dealt.groupBy("leaf")).applyInPandas(visit, _LINK)
    return materialize(least(first.select("comp", "x.*").union(found)))


def reachability_forest(points: DataFrame, radius: float, count: int, key: str) -> DataFrame:
    """(src, dst, cost): minimum spanning forest of the points with a core distance under mutual reachability, the greatest of
    two points' distance and their core distances, over pairs within radius. The tree that a density hierarchy is cut from.

    Boruvka rounds without a table of pairs: each component looks for its least link in leaves of a tree of cuts, as far as what
    it has found allows. Points at one place hang on the smallest key there, at their core distance, which no link of theirs is
    below; otherwise links of equal cost come by (src, dst). The key is a whole number, unique.
    """
    xyz = ["x", "y", "z"]
    core = core_distances(points, radius, count, key).select(F.col(key).cast("long").alias("pid"), "core")
    clean = points.select(F.col(key).cast("long").alias("pid"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in xyz])
    clean = clean.where(" AND ".join(["pid IS NOT NULL", *[f"abs({c}) < double('infinity')" for c in xyz]]))
    rows = materialize(clean.join(core, "pid"))
    places = materialize(rows.groupBy(*xyz).agg(F.min("pid").alias("pid"), F.min_by("core", "pid").alias("core")))
    hung = rows.join(places.select(*xyz, F.col("pid").alias("src")), xyz).where("pid <> src").select("src", F.col("pid").alias("dst"), F.col("core").alias("cost"))
    dealt, _, _ = spatial.deal_to_leaves(places.select("pid", *xyz, "core", F.col("pid").alias("comp")))
    chosen = [hung]
    while True:
        head = F.min(F.struct("pid", *xyz, "core", "comp")).alias("head")
        sides = [f(c).alias(f"{c}_{e}") for c in xyz for f, e in ((F.min, "low"), (F.max, "high"))]
        leaves = dealt.groupBy("leaf").agg(head, *sides, F.min("comp").alias("first_comp"), F.max("comp").alias("last_comp"), F.min("core").alias("least_core"))
        leaves = leaves.select("head.*", *[c for c in leaves.columns if c != "head"]).toPandas()  # a row for each of spatial.LEAVES leaves at most
        if leaves.empty or leaves["first_comp"].min() == leaves["last_comp"].max():
            break
        best = _least_links(dealt, leaves, radius)
        if not best.limit(1).count():
            break
        links = best.select(F.col("comp").alias("c"), F.col("x.other").alias("p"), F.lit(0.0).alias("o"), F.struct("x.src", "x.dst", "x.cost").alias("e"))
        told = graph.rooted(links)
        chosen.append(told.where("e IS NOT NULL").select("e.src", "e.dst", "e.cost"))
        # A component without a link has none in later rounds either, and no other one has a link to it.
        dealt = materialize(dealt.join(told.select(F.col("c").alias("comp"), "p"), "comp").select("pid", *xyz, "core", F.col("p").alias("comp"), "leaf"))
    return reduce(DataFrame.union, chosen)


def farthest_points(points: DataFrame, part: str, key: str, count: int) -> DataFrame:
    """Per part `count` points, each the farthest from those before it; starts at the smallest key, ties by key."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, ignore_index=True)
        p = frame[["x", "y", "z"]].to_numpy(float)
        chosen, d = [0], ((p - p[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(p)):
            chosen.append(int(np.argmax(d)))
            d = np.minimum(d, ((p - p[chosen[-1]]) ** 2).sum(1))
        return pd.DataFrame({part: frame[part].iloc[chosen].to_numpy(), key: frame[key].iloc[chosen].to_numpy(), "rank": range(len(chosen))})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select(part, key, "x", "y", "z").groupBy(part).applyInPandas(run, f"{part} {kinds[part]}, {key} {kinds[key]}, rank long")
