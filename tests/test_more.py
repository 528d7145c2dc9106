"""Operators without SQL against brute force: windows of equal points, spaced rows, trees, suppression, walks, the solver."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from windlass.functions import scalars as S
from windlass.operators import evaluate, fields, graph, mesh, neighbours, sequences, solver, spatial, walks


def brute_window(values, half):
    """Longest window of sorted values, whose smallest leave while they are further than half from the mean; nearest to its mean."""
    w = sorted(values)
    start, total, n, best, mean = 0, 0.0, 0, 0, 0.0
    for v in w:
        total, n = total + v, n + 1
        while n > 1 and abs(w[start] - total / n) > half:
            total, n, start = total - w[start], n - 1, start + 1
        if n > best:
            best, mean = n, total / n
    return min(w, key=lambda x: (abs(x - mean), x))


def test_best_window(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0, 360, 720]) + r.randint(-100, 100) + 0.5) for k in range(30) for _ in range(r.randint(1, 25))]
    rows += [(99, 5.0)] * 40
    got = {x.k: (x.w, x.n) for x in sequences.best_window(spark.createDataFrame(rows, "k int, w double"), ["k"], "w", 90.0).collect()}
    for k in {k for k, _ in rows}:
        values = [w for j, w in rows if j == k]
        assert got[k] == (brute_window(values, 90.0), len(values))


def test_spaced(spark):
    r = random.Random(2)
    rows = [(i, j, r.uniform(0, 30)) for i in range(9) for j in range(40)]
    got = sorted((x.i, x.j) for x in sequences.spaced(spark.createDataFrame(rows, "i int, j int, t double"), "i", "j", "t", 7.0).collect())
    want, last = [], {}
    for i, j, t in rows:
        if i not in last or abs(t - last[i]) >= 7.0:
            want.append((i, j))
            last[i] = t
    assert got == want


def small_graph(seed, n=40, m=90):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, float(r.randint(-5, 5)), r.random()) for a, b in sorted(pairs)]


def test_spanning_forest_and_assignment(spark):
    edges = small_graph(3)
    df = spark.createDataFrame(edges, "src long, dst long, k double, cost double")
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    tree = graph.spanning_forest(nodes, df)
    got = sorted((x.src, x.dst) for x in tree.collect())
    top = list(range(40))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    want = []
    for a, b, _, _ in sorted(edges, key=lambda e: (e[3], e[0], e[1], e[2])):
        if root(a) != root(b):
            top[root(a)] = root(b)
            want.append((a, b))
    assert got == sorted(want)
    start = edges[0][0]
    f = {x.id: x.f for x in walks.assign_along_tree(tree, start).collect()}
    assert f[start] == 0.0 and set(f) == {i for i in range(40) if root(i) == root(start)}
    chosen = {(a, b): k for a, b, k, _ in edges if (a, b) in set(want)}
    assert all(f[b] - f[a] == k for (a, b), k in chosen.items() if a in f)


def test_walks_take_whole_ways(spark):
    edges = small_graph(4, 12, 20)
    df = spark.createDataFrame(edges, "src long, dst long, k double, cost double")
    starts = spark.createDataFrame([(i, i % 13) for i in range(60)], "walk long, node long")
    steps = [walks.random_walks(starts, df, n).collect() for n in (1, 1, 3)]
    assert sorted(steps[0]) == sorted(steps[1])
    ways = {(a, b): k for a, b, k, _ in edges} | {(b, a): -k for a, b, k, _ in edges}
    for x in steps[0]:
        near = {b for a, b in ways if a == x.walk % 13}
        assert x.node in near and x.k == ways[x.walk % 13, x.node] if near else (x.node, x.k) == (x.walk % 13, 0.0)
    assert len({x.node for x in steps[0] if x.walk % 13 == 1}) >= 1 and len(steps[2]) == 60


def test_suppression_and_farthest_points(spark):
    r = random.Random(5)
    rows = [(i, i % 3, r.random(), (lo := r.uniform(0, 20)), lo + 3) for i in range(60)]
    got = {x.pid for x in evaluate.nms_1d(spark.createDataFrame(rows, "pid long, lab int, conf double, lo double, hi double"), "lab", "lo", "hi", "conf", "pid", 0.5).collect()}
    want = set()
    for lab in range(3):
        kept = []
        for p, _, _, lo, hi in sorted((x for x in rows if x[1] == lab), key=lambda x: (-x[2], x[0])):
            if all((min(hi, b) - max(lo, a)) / (max(hi, b) - min(lo, a)) <= 0.5 for a, b in kept):
                kept.append((lo, hi))
                want.add(p)
    assert got == want
    points = [(i, i % 2, r.random(), r.random(), r.random()) for i in range(50)]
    far = {(x.lab, x["rank"]): x.pid for x in neighbours.farthest_points(spark.createDataFrame(points, "pid long, lab int, x double, y double, z double"), "lab", "pid", 6).collect()}
    for lab in range(2):
        mine = [p for p in points if p[1] == lab]
        chosen = [mine[0]]
        while len(chosen) < 6:
            chosen.append(max(mine, key=lambda p: (min(math.dist(p[2:], q[2:]) for q in chosen), -p[0])))
        assert [far[lab, k] for k in range(6)] == [p[0] for p in chosen]


def test_reachability_forest(spark):
    r = random.Random(9)
    points = [(i, r.uniform(0, 10), r.uniform(0, 10), r.uniform(0, 10)) for i in range(60)]
    got = neighbours.reachability_forest(spark.createDataFrame(points, "pid long, x double, y double, z double"), 4.0, 3, "pid").collect()
    near = {(a[0], b[0]): math.dist(a[1:], b[1:]) for a in points for b in points if math.dist(a[1:], b[1:]) <= 4.0}
    core = {p: ds[2] for p in range(60) if len(ds := sorted(d for (a, _), d in near.items() if a == p)) >= 3}
    cost = sorted((max(d, core[a], core[b]), a, b) for (a, b), d in near.items() if a < b and a in core and b in core)
    top, want = {p: p for p in core}, []

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for d, a, b in cost:
        if root(a) != root(b):
            top[root(a)] = root(b)
            want.append(d)
    assert len(got) == len(want) and abs(sum(x.cost for x in got) - sum(want)) < 1e-9


def test_reachability_forest_without_a_table_of_pairs(spark, monkeypatch):
    """Dense points within one radius, copies at one place, two clusters apart, points out of reach: the forest of all pairs, from few rows."""
    r = random.Random(11)
    points = [(i, r.gauss(0, 3), r.gauss(0, 3), r.gauss(0, 3)) for i in range(500)] + [(500 + i, r.gauss(25, 1), 0.0, r.gauss(0, 1)) for i in range(200)]
    points += [(700 + i, 1.0, 1.0, 1.0) for i in range(150)] + [(850 + i, 200.0, 0.1 * i, 0.0) for i in range(6)] + [(900, 500.0, 0.0, 0.0), (901, None, 0.0, 0.0)]
    monkeypatch.setattr(neighbours.spatial, "LEAF", 32)

    def no_pairs(*a, **b):
        raise AssertionError("all pairs within the radius were joined")

    monkeypatch.setattr(neighbours.spatial, "radius_join", no_pairs)
    got = neighbours.reachability_forest(spark.createDataFrame(points, "pid long, x double, y double, z double"), 24.0, 4, "pid").collect()
    p = np.array([x[1:] for x in points[:-1]])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    ranked = np.sort(d, axis=1)[:, 3]
    cost = np.maximum(np.maximum(d, ranked[:, None]), ranked[None])
    a, b = np.nonzero(np.triu(d <= 24.0, 1) & (ranked <= 24.0)[:, None] & (ranked <= 24.0)[None])
    keys, top = [x[0] for x in points[:-1]], list(range(len(p)))

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    want = []
    for i in np.argsort(cost[a, b], kind="stable"):
        x, y = root(a[i]), root(b[i])
        if x != y:
            top[x] = y
            want.append(cost[a[i], b[i]])
    assert np.allclose(sorted(x.cost for x in got), want, atol=1e-9)
    at, joined = {k: i for i, k in enumerate(keys)}, list(range(len(p)))
    top[:] = joined
    for x in got:
        i, j = at[x.src], at[x.dst]
        assert d[i, j] <= 24.0 and abs(cost[i, j] - x.cost) < 1e-9 and root(i) != root(j)
        top[root(i)] = root(j)


def test_springs_and_thresholds():
    springs = walks.spring_series(2.0, 5)
    value, shrink, want = 2.0, 0.1**0.2, []
    for _ in range(5):
        want.append(value)
        value = 1 / (1 + shrink * (value - 1)) if value > 1 else 1 + shrink * (1 / value - 1)
    assert np.allclose(springs, [*want, 1.0])
    assert np.allclose(solver.Schedule(rounds=4).thresholds(), [2.35, 1.545, 0.9815, 0.58705])
    assert S.angle_steps(7.0) == 52 and S.angle_steps(90.0) == 4
    m = [[0, 2, 0, 5], [1, 0, 0, 6], [0, 0, 3, 7], [0, 0, 0, 1]]
    assert np.allclose(S.combined_transform(m, S.inverse_transform(m)), np.eye(4))


def test_solver_recovers_a_spiral(spark):
    """Nodes along a spiral with noisy starts and a few wrong edges: the edges go, and all angles fit up to one turn count."""
    r = random.Random(6)
    n = 16
    truth = {i: 100.0 * i for i in range(n)}
    edges = [(i, j, truth[j] - truth[i], 1.0, False) for i in range(n) for j in (i + 1, i + 2, i + 5) if j < n]
    edges += [(3, 12, 0.0, 0.05, False), (1, 14, 100.0, 0.05, False)]
    nodes = spark.createDataFrame([(i, truth[i] % 360 - 180 + 360 * r.randint(-1, 1)) for i in range(n)], "id long, f double")
    df = spark.createDataFrame(edges, "src long, dst long, k double, certainty double, same_block boolean")
    schedule = solver.Schedule(iterations=15, steps=1, spring=1.5, warm_factor=1.0, rounds=1, threshold=1.0, least=0.2)
    got, left = solver.solve(nodes, df, schedule)
    assert {(x.src, x.dst) for x in left.collect()} <= {(a, b) for a, b, *_ in edges} - {(3, 12), (1, 14)}
    f = {x.id: x.f for x in got.collect()}
    assert len(f) == n and max(abs(f[i] - f[0] - truth[i]) for i in f) <= 180.0
    kept = solver.without_invalid(nodes, df.withColumn("fixed", F.col("src") == 3), 0.0)
    assert {(x.src, x.dst) for x in kept.collect()} == {(a, b) for a, b, *_ in edges if a == 3}


def test_ranks_hold_over_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = fields.ranked(rows, ["v"]).collect()
    assert sorted((x.v, x["rank"]) for x in got) == [(i, i) for i in range(1000)]
    assert fields.ranked(rows.limit(0), ["v"]).count() == 0


def test_division_by_nothing(spark):
    """Zero areas, certainties and axes of one point or none have results in ANSI mode."""
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 0.5, 0.0), (2, 0.0, 1.0, 0.0, 1.0, 0.0)], "vid int, x double, y double, z double, u double, v double")
    flat = mesh.stretch(spark.createDataFrame([(0, 0, 1, 2)], "tid int, v0 int, v1 int, v2 int"), v).first()
    assert (flat.l2, flat.linf, flat.area3, flat.area2) == (0.0, 0.0, 0.5, 0.0)
    n = spark.createDataFrame([(1, 0.0), (2, 900.0)], "id long, f double")
    e = spark.createDataFrame([(1, 2, 0.0, 0.0)], "src long, dst long, k double, certainty double")
    assert {x.turns for x in graph.laplacian_turns(n, e).collect()} == {0.0}
    points = spark.createDataFrame([(1, 5.0)], "id int, y double")
    axis = spark.createDataFrame([(1.0, 2.0, 3.0)], "y double, x double, z double")
    assert [(x.ax, x.az) for x in spatial.axis_join(points, axis, "y").collect()] == [(2.0, 3.0)]
    assert [(x.ax, x.az) for x in spatial.axis_join(points, axis.limit(0), "y").collect()] == [(None, None)]
