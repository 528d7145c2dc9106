"""Meshes, belief propagation, grid relaxation and matched boxes against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np

from windlass.operators import belief, closest, evaluate, graph, relax

CORNERS = "tid long, " + ", ".join(f"c{i}_{a} double" for i in range(3) for a in "xyz") + ", c0_w double"


def soup(seed, n):
    r = random.Random(seed)
    rows = []
    for tid in range(n):
        o = [r.uniform(0, 9) for _ in range(3)]
        rows.append((tid, *[v + (r.uniform(-1, 1) if i else 0.0) for i in range(3) for v in o], r.choice([0.0, 30.0, 300.0])))
    rows.append((n, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0))  # a point
    rows.append((n + 1, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0, 4.0, 4.0, 0.0))  # a line
    return rows


def brute_distance(p, t):
    """Least distance by nested ternary search over the triangle's barycentric coordinates, which is a convex problem."""
    a, b, c = (np.array(t[1 + 3 * i : 4 + 3 * i]) for i in range(3))

    def inner(u):
        lo, hi = 0.0, 1.0 - u
        for _ in range(36):
            m, n = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, n) if np.linalg.norm(a + u * (b - a) + m * (c - a) - p) < np.linalg.norm(a + u * (b - a) + n * (c - a) - p) else (m, hi)
        return np.linalg.norm(a + u * (b - a) + lo * (c - a) - p)

    lo, hi = 0.0, 1.0
    for _ in range(36):
        m, n = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, n) if inner(m) < inner(n) else (m, hi)
    return inner(lo)


def test_closest_triangles(spark):
    r, tris = random.Random(1), soup(2, 25)
    points = [(i, r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9)) for i in range(8)] + [(90, 1.0, 1.0, 1.5), (91, 3.0, 3.0, 3.5), (92, None, 0.0, 0.0), (93, 99.0, 99.0, 99.0)]
    got = closest.closest_triangles(spark.createDataFrame(points, "pid long, x double, y double, z double"), spark.createDataFrame(tris, CORNERS), 1.5, 2.0, "pid")
    got = {x.pid: x.d for x in got.collect()}
    for pid, *p in points[:-2]:
        best = min(brute_distance(np.array(p), t) for t in tris)
        assert (pid in got) == (best <= 1.5)
        assert pid not in got or abs(got[pid] - best) < 1e-5
    assert 92 not in got and 93 not in got


def test_ray_hits(spark):
    r, tris = random.Random(3), soup(4, 500)
    rays = []
    for i in range(60):
        d = np.array([r.uniform(-1, 1) for _ in range(3)])
        rays.append((i, *[r.uniform(0, 9) for _ in range(3)], *map(float, d / np.linalg.norm(d)), 0.0))
    got = closest.ray_hits(spark.createDataFrame(rays, "pid long, x double, y double, z double, dx double, dy double, dz double, w double"), spark.createDataFrame(tris, CORNERS), 4.0, 1.0, "pid", 45.0)
    got = {x.pid: (round(x.d, 6), x.tid, x.way) for x in got.collect()}
    for pid, *v, w in rays:
        o, d, hits = np.array(v[:3]), np.array(v[3:]), []
        for t in tris[:-2]:
            a, b, c = (np.array(t[1 + 3 * i : 4 + 3 * i]) for i in range(3))
            u, s, k = np.linalg.solve(np.stack([b - a, c - a, -d], axis=1), o - a)
            if u >= 0 and s >= 0 and u + s <= 1 and abs(k) <= 4 and abs(t[-1] - w) < 45:
                hits.append((round(abs(k), 6), t[0], 1 if k >= 0 else -1))
        assert got.get(pid) == (min(hits) if hits else None)
    assert 10 < len(got) < 60


def test_triangles_meet(spark):
    one = (0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    cuts = (1, 0.2, 0.2, -1.0, 0.2, 0.2, 1.0, 0.3, 0.3, 1.0, 360.0)
    misses = (2, 0.9, 0.8, -1.0, 0.9, 0.8, 1.0, 0.95, 0.9, 1.0, 360.0)
    same_turn = (3, 0.2, 0.2, -1.0, 0.2, 0.2, 1.0, 0.3, 0.3, 1.0, 10.0)
    df = spark.createDataFrame([one, cuts, misses, same_turn], CORNERS).withColumnRenamed("c0_w", "w")
    got = sorted(x.tid for x in closest.crossing_triangles(df, 2.0, 90.0).collect())
    assert got == [0, 1, 3]  # cuts and same_turn lie on each other, a turn apart
    assert sorted(x.tid for x in closest.crossing_triangles(df.where("tid <> 1"), 2.0, 90.0).collect()) == []
    # As defined, no axis separates triangles in one plane, so these count as meeting wherever they are in it.
    beside = spark.createDataFrame([one, (4, 3.0, 0.0, 0.0, 4.0, 0.0, 0.0, 3.0, 1.0, 0.0, 360.0)], CORNERS).withColumnRenamed("c0_w", "w")
    assert sorted(x.tid for x in closest.crossing_triangles(beside, 4.0, 90.0).collect()) == [0, 4]


def test_belief_on_trees_is_exact(spark):
    """On a tree the messages give the best assignment, whatever the potentials."""
    r = random.Random(5)
    for trial in range(2):
        n = 6
        edges = [(r.randrange(i), i, r.uniform(0.1, 2), 360.0 * r.randint(-2, 2)) for i in range(1, n)]
        f = [360.0 * r.randint(-1, 1) for _ in range(n)]
        nodes = spark.createDataFrame([(i, v) for i, v in enumerate(f)], "id long, f double")
        df = spark.createDataFrame(edges, "src long, dst long, certainty double, k double")
        got = {x.id: x.shift for x in belief.decode(belief.with_turns(nodes, df), 1, n, 0.0).collect()}
        price = lambda s: sum(w * abs((f[a] - f[b] + k) / 360 + s[a] - s[b]) for a, b, w, k in edges)  # noqa: B023, E731
        best = min(price(s) for s in itertools.product((-1, 0, 1), repeat=n))
        # Ties can be decoded inconsistently; a best shift of each node's own must exist all the same.
        for node in range(n):
            assert abs(min(price(s) for s in itertools.product((-1, 0, 1), repeat=n) if s[node] == got[node]) - best) < 1e-6


def test_belief_solves_consistent_graph(spark):
    r = random.Random(6)
    true = [r.uniform(0, 2000) for _ in range(12)]
    edges = [(a, b, 1.0, true[b] - true[a]) for a in range(12) for b in range(a + 1, 12) if b - a in (1, 5)]
    moved = [(i, t + 360.0 * r.choice([-1, 0, 1])) for i, t in enumerate(true)] + [(77, 5.0)]
    nodes = spark.createDataFrame(moved, "id long, f double")
    df = spark.createDataFrame(edges, "src long, dst long, certainty double, k double")
    solved = belief.solve(nodes, df, 2, 12)
    assert belief.loss(solved, df).first().loss == 0
    assert solved.where("id = 77").first().f == 5.0
    assert belief.solve(nodes, df.limit(0), 2, 2).count() == 13


def test_relaxation(spark):
    r, turn = random.Random(7), 4
    grid = {(i, j): (-(i // turn) * 10 - r.uniform(0, 9), r.random() < 0.4) for i in range(16) for j in range(7) if r.random() < 0.9}
    df = spark.createDataFrame([(i, j, t, f) for (i, j), (t, f) in grid.items()], "i int, j int, t double, fixed boolean")

    def step(i, j):
        t = grid[i, j][0]
        at = lambda a, b: grid[a, b][0] if (a, b) in grid else None
        mean = lambda v: sum(v) / len(v) if v else None
        near = [p for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if p in grid]
        total, count = mean([at(*p) for p in near]) or 0.0, 1
        for way in (turn, -turn):
            m = mean([at(p[0] + way, p[1]) - at(*p) for p in near if at(p[0] + way, p[1]) is not None])
            if at(i + way, j) is not None and m is not None:
                total, count = total + at(i + way, j) - m, count + 1
        d = min(0.0, total / count) - t
        for way in (-turn, turn):
            other = at(i + way, j)
            if other is not None and (t > other) != (t + d > other):
                d = (other - t) * 0.5
        return d

    want = {p: step(*p) for p in grid}
    for x in relax.steps(df, turn).collect():
        assert abs(x.d - want[x.i, x.j]) < 1e-9
    for x in relax.sweep(df, turn).collect():
        t, fixed = grid[x.i, x.j]
        assert abs(x.t - (t if fixed else t + 0.1 * want[x.i, x.j])) < 1e-9
    mean = lambda flag: np.mean([abs(want[p]) for p in grid if grid[p][1] == flag])
    over, under = 1.5 * mean(True), 0.2 * mean(False)
    for x in relax.refixed(df, turn, 1.5).collect():
        e = abs(want[x.i, x.j])
        assert x.fixed == ((grid[x.i, x.j][1] and e <= over) or e < under)
    assert relax.relax(df, turn, 1, 3).count() == len(grid)
    assert relax.relax(df.limit(0), turn, 1, 3).count() == 0


def test_matched(spark):
    r = random.Random(8)
    box = lambda: (lambda x, y: (x, y, x + r.uniform(1, 4), y + r.uniform(1, 4)))(r.uniform(0, 20), r.uniform(0, 20))
    truths, dets = [(i, *box()) for i in range(30)], [(i, *box(), r.random()) for i in range(80)]
    got = evaluate.matched(spark.createDataFrame(dets, "id long, x0 double, y0 double, x1 double, y1 double, score double"), spark.createDataFrame(truths, "id long, x0 double, y0 double, x1 double, y1 double"), 3.0, 0.2)
    got = {x.id: x.hit for x in got.collect()}

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = w * h if w > 0 and h > 0 else 0.0
        return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)

    taken = set()
    for det in sorted(dets, key=lambda x: -x[5]):
        best = max(truths, key=lambda t: (iou(det, t), -t[0]))
        hit = iou(det, best) > 0.2 and best[0] not in taken
        taken |= {best[0]} if hit else set()
        assert got[det[0]] == hit
    assert any(got.values()) and len(got) == 80


def test_frontier(spark):
    r = random.Random(9)
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(40)}
    open_ = {i: r.random() < 0.5 for i in range(30)}
    got = graph.frontier(spark.createDataFrame(list(open_.items()), "id long, open boolean"), spark.createDataFrame(list(pairs), "src long, dst long"), 2)
    got = {x.id: x.n for x in got.collect()}
    near = {i: {i} | {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(30)}
    assert got == {i: sum(open_[k] for k in set().union(*(near[j] for j in near[i]))) for i in range(30)}
