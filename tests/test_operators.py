"""Operators against values known in closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass.functions import scalars as S
from windlass.operators import evaluate, graph, sequences, spatial, surface
from windlass.sources import formats
from windlass.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*v):
    return [F.lit(float(x)) for x in v]


@pytest.mark.parametrize(("a", "b", "angle"), [((1, 0, 0), (0, 1, 0), math.pi / 2), ((1, 0, 0), (-1, 0, 0), 0.0), ((0, 2, 0), (0, 5, 0), 0.0)])
def test_undirected_angle(spark, a, b, angle):
    assert one(spark, S.undirected_angle(lits(*a), lits(*b))) == pytest.approx(angle)


@pytest.mark.parametrize(("angle", "wrapped"), [(180.0, 180.0), (-180.0, -180.0), (190.0, -170.0), (-190.0, 170.0), (720.0, 0.0)])
def test_wrap_keeps_both_ends(spark, angle, wrapped):
    assert one(spark, S.wrap_closed(F.lit(angle))) == wrapped


@pytest.mark.parametrize(("v2", "angle"), [((0, 1), math.pi / 2), ((1, 0), 0.0), ((-1, 0), math.pi), ((0, -1), -math.pi / 2)])
def test_signed_angle(spark, v2, angle):
    assert one(spark, S.signed_angle(*lits(1, 0), *lits(*v2))) == pytest.approx(angle)


def test_unit_of_zero_is_null(spark):
    assert one(spark, S.unit(*lits(0, 0, 0))[0]) is None


def test_rounding_of_turns(spark):
    assert one(spark, S.winding_steps(*lits(180.0, 0.0, 0.0))) == 1.0  # the small addend decides the tie
    assert one(spark, S.closest_winding(*lits(10.0, 370.0))) == 370.0


def test_axis_join_outside(spark):
    axis = spark.createDataFrame([(0.0, 1.0, 2.0), (10.0, 11.0, 2.0), (20.0, 11.0, 12.0)], "y double, x double, z double")
    points = spark.createDataFrame([(i, y) for i, y in enumerate((-5.0, 0.0, 5.0, 10.0, 20.0, 25.0, 15.5))], "i long, y double")
    clamped = {r.i: (r.ax, r.az) for r in spatial.axis_join(points, axis).collect()}
    assert clamped == {0: (1.0, 2.0), 1: (1.0, 2.0), 2: (6.0, 2.0), 3: (11.0, 2.0), 4: (11.0, 12.0), 5: (11.0, 12.0), 6: (11.0, 7.5)}
    free = {r.i: (r.ax, r.az) for r in spatial.axis_join(points, axis, clamp=False).collect()}
    assert free[0] == (-4.0, 2.0) and free[5] == (11.0, 17.0)


def test_radius_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10, (120, 3))
    df = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(i=range(120)))
    got = {(r.a_i, r.b_i) for r in spatial.radius_join(df, df, 1.5).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert got == {tuple(t) for t in np.argwhere(d <= 1.5).tolist()}


def test_fill_and_gaps(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, None)], "p int, j int, t double")
    assert [r.t for r in sequences.prev_next_fill(rows, ["p"], "j", "t").orderBy("j").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0]
    values = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 50, 51, 52, 99)], "p int, v double")
    r = sequences.largest_cluster_mean(values, ["p"], "v", 5.0).first()
    assert (r.n, r["mean"]) == (3, 2.0)


def test_graph_solver_reaches_the_winding(spark):
    n = 12
    nodes = spark.createDataFrame([(i, 0.0) for i in range(n)], "id long, f double")
    edges = spark.createDataFrame([(i, i + 1, 360.0, 1.0, False) for i in range(n - 1)], "src long, dst long, k double, certainty double, same_block boolean")
    before = graph.edge_errors(nodes, edges).agg(F.sum(F.abs("diff"))).first()[0]
    after = graph.edge_errors(graph.jacobi(nodes, edges, rounds=5), edges).agg(F.sum(F.abs("diff"))).first()[0]
    assert after < before
    depth = {r.id: r.depth for r in graph.bfs_depth(nodes, edges, 0).collect()}
    assert depth == {i: i for i in range(n)}
    assert {r.component for r in graph.components(nodes, edges.where("src <> 5")).collect()} == {0, 6}


def test_spanning_forest_cost(spark):
    rng = np.random.default_rng(3)
    e = [(i, j, float(rng.uniform())) for i in range(9) for j in range(i + 1, 9) if rng.uniform() < 0.5]
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id long")
    edges = spark.createDataFrame([(a, b, 0.0, w) for a, b, w in e], "src long, dst long, k double, cost double")
    top, want = list(range(9)), 0.0

    def root(x):
        return x if top[x] == x else root(top[x])

    for a, b, w in sorted(e, key=lambda t: t[2]):
        if root(a) != root(b):
            top[root(a)] = root(b)
            want += w
    assert graph.spanning_forest(nodes, edges).agg(F.sum("cost")).first()[0] == pytest.approx(want)


def test_surface_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-1, 1, (2, 400))
    z = 1 + 2 * y + 3 * y**2 + 4 * x + 5 * x * y + 6 * x**2
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z}))
    assert surface.ridge_fit(df, F.col("x"), F.col("y"), F.col("z"), 2, 0.0) == pytest.approx([1, 2, 3, 4, 5, 6])


def test_suppression(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.0, 10.0), (2, 0, 0.8, 1.0, 11.0), (3, 0, 0.7, 20.0, 30.0)], "pid long, lab int, conf double, lo double, hi double")
    assert {r.pid for r in evaluate.nms_1d(df, "lab", "lo", "hi", "conf", "pid", 0.5).collect()} == {1, 3}


def test_formats(spark, tmp_path):
    columns = {c: np.arange(5.0) + i for i, c in enumerate(("x", "y", "z"))}
    (tmp_path / "a.ply").write_bytes(formats.ply_bytes(columns))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n7 8 9\n")
    rows = formats.read_ply(spark, str(tmp_path / "*.ply")).collect()
    assert sorted(r.x for r in rows) == [0.0, 1.0, 2.0, 3.0, 4.0, 7.0]
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    v, t = formats.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4 and sorted((r.v0, r.v1, r.v2) for r in t.collect()) == [(0, 1, 2), (0, 2, 3)]
    (tmp_path / "axis.txt").write_text("1, 2, 3\n4, 5, 6\n")
    assert formats.read_axis(spark, str(tmp_path / "axis.txt")).count() == 2
    nodes = pd.DataFrame({"id": [0, 1], "z": [1.0, 2.0], "f": [3.0, 4.0], "gt": [True, False], "gt_f": [0.0, 1.0]})
    edges = pd.DataFrame({"src": [0], "dst": [1], "certainty": [0.5], "k": [90.0], "same_block": [True]})
    n, e = formats.parse_graph(formats.graph_bytes(nodes, edges))
    assert n["f"].tolist() == [3.0, 4.0] and sorted(zip(e["src"], e["dst"], e["k"], strict=True)) == [(0, 1, 90.0), (1, 0, -90.0)]
    grid = np.zeros((2, 3, 6))
    grid[1, 2] = [5, 6, 7, 0, 0, 1]
    (tmp_path / "p.ppm").write_bytes(b"width: 3\nheight: 2\ndim: 6\n<>\n" + grid.astype("<f8").tobytes())
    r = formats.read_ppm(spark, str(tmp_path / "p.ppm")).collect()
    assert [(x.imx, x.imy, x.z) for x in r] == [(2, 1, 7.0)]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    want = {(r.bx, r.by_): (r.n, round(r.v, 3)) for r in incremental.block_sums(spark.read.parquet(path)).collect()}
    assert {(r.bx, r.by_): (r.n, round(r.v, 3)) for r in incremental.ingest_blocks(spark, path).collect()} == want
