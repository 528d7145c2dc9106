"""Queries on tables whose part keys reach the suppliers' ids, as they do in large copies, and operators at ties."""

from __future__ import annotations

import compare
import duckdb
import numpy as np
import pytest

from windlass.operators import closest, graph, neighbours, sequences, solver, spatial, walks
from windlass.plans import catalogue, more, surfaces  # noqa: F401 - they add their queries
from windlass.sources import shared


@pytest.fixture(scope="module")
def met(tmp_path_factory):
    """Parts 1,000,000 - 1,000,029 beside suppliers with the same ids."""
    where = tmp_path_factory.mktemp("met")
    con = duckdb.connect()
    for name, text in {
        "part": "SELECT 999990 + i AS p_partkey FROM range(40) t(i)",
        "supplier": "SELECT i AS s_suppkey FROM range(30) t(i)",
        "lineitem": "SELECT 999990 + (i * 7) % 40 AS l_partkey, (i * 11 + i // 40) % 30 AS l_suppkey, CAST(i % 7 AS INT) AS l_linenumber, 1.0 + i % 50 AS l_quantity, (i % 11) / 100.0::DOUBLE AS l_discount, CASE WHEN i % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(600) t(i)",
    }.items():
        con.sql(f"COPY ({text}) TO '{where / name}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for name in ("part", "supplier", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{where / name}.parquet'")
    return con, str(where)


def same(spark, met, name):
    said = compare.compare(spark, met[0], name, catalogue.queries()[name], catalogue.oracle_sql()[name], met[1])
    assert ": same " in said, said


def test_parts_come_before_suppliers_whatever_their_ids(spark, met):
    same(spark, met, "edge_canonical_sum")


def test_potentials_of_edges_that_appear_twice(spark, met):
    same(spark, met, "belief_potentials")


def test_turns_at_a_half_do_not_follow_the_order_of_sums(spark):
    """Certainties of 0.3 for one turn and 0.3 for none: the half goes to the even 0, though 0.14 + 0.11 + 0.05 > 0.3 as sums."""
    turned, still = [0.14, 0.11, 0.05], [0.18, 0.12]
    nodes = spark.createDataFrame([(0, 0.0)] + [(i, 360.0 if i <= 3 else 0.0) for i in range(1, 6)], "id long, f double")
    edges = spark.createDataFrame([(0, i, 0.0, w) for i, w in enumerate(turned + still, 1)], "src long, dst long, k double, certainty double")
    assert {r.id: r.turns for r in graph.laplacian_turns(nodes, edges).collect()}[0] == 0.0


@pytest.mark.parametrize("name", ["jacobi_step_1", "jacobi_step_2"])
def test_steps_where_two_nodes_share_an_id(spark, met, name):
    same(spark, met, name)


def test_step_with_fixed_nodes_that_share_an_id(spark, met):
    same(spark, met, "solver_step_fixed")


def test_two_hops_are_no_rows(spark):
    """A hub of 3,000 nodes, a chain over the border of a block and negative ids: brute force, and no row for a pair of nodes."""
    pairs = [(5, i) for i in range(3000, 6000)] + [(i, i + 1) for i in range(4090, 4100)] + [(-3, 5), (-3, -4097)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    want = {a: len(set().union(*[near[m] - {m} for m in near[a]]) | {a}) for a in near if a >= -3}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.two_hops(edges, -3)
    assert {r.id: r.n for r in got.collect()} == want
    assert graph._block_pairs(edges, -3).count() < 10_000  # pairs are over 9 million


def test_depth_of_a_tree_costs_no_rounds(spark):
    """A chain of 400 nodes with ids in any order, beside a tree that the root does not reach."""
    order = [(i * 173) % 401 for i in range(400)]
    rows = [(a, b, 2.0) if a % 2 else (b, a, -2.0) for a, b in zip(order, order[1:], strict=False)] + [(1000, 1001, 5.0)]
    made = len(shared._MADE)
    got = {r.id: r.f for r in walks.assign_along_tree(spark.createDataFrame(rows, "src long, dst long, k double"), order[7]).collect()}
    assert got == {n: 2.0 * (i - 7) for i, n in enumerate(order)}
    assert len(shared._MADE) - made < 100


def test_depth_of_the_solvers_tree_costs_no_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1, 360.0, 1.0, False) for i in range(300)], "src long, dst long, k double, certainty double, same_block boolean")
    nodes = spark.createDataFrame([(i, float(i % 7)) for i in range(301)], "id long, f double")
    made = len(shared._MADE)
    assert {r.id: r.f for r in solver.anchored(nodes, edges).collect()} == {i: i % 7 + 360.0 * i for i in range(301)}
    assert len(shared._MADE) - made < 100


def crowded(spark):
    """1,500 points in space, 30,000 at one place, and some without a place: (points, numpy rows)."""
    p = np.random.default_rng(4).normal(0, 3, (1500, 3)).round(1)
    p = np.concatenate([p, np.ones((30_000, 3))])
    rows = [(i, *map(float, q)) for i, q in enumerate(p)] + [(90_000, None, 0.0, 0.0), (90_001, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double"), p


def test_nearest_points_beside_a_crowd(spark):
    df, p = crowded(spark)
    got = {}
    for r in spatial.k_nearest(df, 4, 2.0, "pid").collect():
        got.setdefault(r.pid, {})[r["rank"]] = (r.other, r.d)
    for i in [*range(0, 1500, 7), 1500, 1503, 1504, 1505, 31_499]:
        d = np.sqrt(((p - p[i]) ** 2)[:, 0] + ((p - p[i]) ** 2)[:, 1] + ((p - p[i]) ** 2)[:, 2])
        want = [(float(d[j]), int(j)) for j in np.lexsort((np.arange(len(p)), d))[:6] if j != i and d[j] <= 2.0][:4]
        assert got.get(i, {}) == {n: (j, far) for n, (far, j) in enumerate(want, 1)}
    assert set(got) <= set(range(len(p)))


def test_core_distances_beside_a_crowd(spark):
    df, p = crowded(spark)
    got = {r.pid: r.core for r in neighbours.core_distances(df, 2.0, 4, "pid").collect()}
    for i in range(0, 1500, 7):
        d = np.sort(np.sqrt(((p - p[i]) ** 2)[:, 0] + ((p - p[i]) ** 2)[:, 1] + ((p - p[i]) ** 2)[:, 2]))
        assert got.get(i) == (d[3] if d[3] <= 2.0 else None)
    assert got[31_499] == 0.0


def test_best_window_of_one_large_key(spark):
    """40,000 distinct values in one key, and one without a value: the window of a plain walk."""
    w = sorted({((i * 7919) % 400_009) / 8.0 for i in range(40_000)})
    start, total, n, most, mean = 0, 0.0, 0, 0, 0.0
    for v in w:
        total, n = total + v, n + 1
        while abs(w[start] - total / n) > 9000.0:
            total, n, start = total - w[start], n - 1, start + 1
        if n > most:
            most, mean = n, total / n
    want = min(w, key=lambda x: (abs(x - mean), x))
    rows = spark.createDataFrame([(1, v) for v in w] + [(1, None), (2, None)], "k int, w double")
    assert {r.k: (r.w, r.n) for r in sequences.best_window(rows, ["k"], "w", 9000.0).collect()} == {1: (want, len(w) + 1), 2: (None, 1)}


def test_equal_rays_are_followed_once(spark):
    """2,000 rays of one shape over 400 triangles in reach: every ray gets its hit; rays with keys of their own and one shared."""
    names = "tid long, c0_x double, c0_y double, c0_z double, c1_x double, c1_y double, c1_z double, c2_x double, c2_y double, c2_z double, c0_w double"
    flat = spark.createDataFrame([(t, -9.0, -9.0, 1.0 + t / 100, 9.0, -9.0, 1.0 + t / 100, 0.0, 9.0, 1.0 + t / 100, 0.0) for t in range(400)], names)
    rays = spark.createDataFrame([(i // 2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0 if i % 2 else -1.0, 1.0) for i in range(2000)] + [(5000, 0.0, 0.0, None, 0.0, 0.0, 1.0, 1.0)], "pid long, x double, y double, z double, dx double, dy double, dz double, w double")
    got = {r.pid: (r.tid, r.d, r.way) for r in closest.ray_hits(rays, flat, 6.0, 2.0, "pid", 45.0).collect()}
    assert got == {i: (0, 1.0, 1) for i in range(1000)}
