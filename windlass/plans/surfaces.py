"""Further named queries: points, rays and triangles against a mesh, belief propagation, grid relaxation, matched boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import scalars as S
from windlass.functions.scalars import r6
from windlass.operators import belief, closest, evaluate, graph, mesh, relax, spatial

from . import fixtures as X
from .catalogue import _TRI3, _triangles, c, query
from .fixtures import sql


def _o(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# --- meshes -------------------------------------------------------------------------------------------------------

_PROBES = X.SQL["dense"] + ", probes AS (SELECT pid, patch, x * 3 - 0.25::DOUBLE AS x, y * 0.6::DOUBLE + 10.3::DOUBLE AS y, z / 10.0::DOUBLE AS z, 54.0::DOUBLE * x AS w FROM dense)"


def _probes(spark, d):
    """Points about the lattice's mesh, one for every row of the dense points; w is near the mesh's winding there."""
    return X.dense(spark, d).select("pid", "patch", (c("x") * 3 - 0.25).alias("x"), (c("y") * 0.6 + 10.3).alias("y"), (c("z") / 10.0).alias("z"), (54.0 * c("x")).alias("w"))


def _corners(spark, d):
    v = X.lattice(spark, d).withColumn("w", 360.0 * c("u"))
    return mesh.corners(_triangles(spark, d), v, ["x", "y", "z", "w"])


def _dot(a, b):
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def _cross(a, b):
    return [f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]


def _less(a, b):
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


_A, _B, _C, _PT = ["ax", "ay", "az"], ["bx", "by_", "bz"], ["cx", "cy", "cz"], ["p.x", "p.y", "p.z"]
_NORMAL = ["nx", "ny", "nz"]


def _side(a, b):
    along, off = _less(b, a), _less(_PT, a)
    t = f"least(1.0, greatest(0.0, {_dot(off, along)} / {_dot(along, along)}))"
    away = [f"({o} - {t} * {v})" for o, v in zip(off, along, strict=True)]
    return f"sqrt({_dot(away, away)})"


_INSIDE = " AND ".join(f"{_dot(_cross(_less(b, a), _less(_PT, a)), _NORMAL)} >= 0" for a, b in ((_A, _B), (_B, _C), (_C, _A)))
_TO_TRIANGLE = f"round(CASE WHEN {_INSIDE} THEN abs({_dot(_less(_PT, _A), _NORMAL)}) / sqrt({_dot(_NORMAL, _NORMAL)}) ELSE least({_side(_A, _B)}, {_side(_B, _C)}, {_side(_C, _A)}) END, 9)"
#: Candidates by the unit columns of i that a triangle, widened by 1, touches; the rest by comparison.
_CLOSEST = _TRI3 + ", " + _PROBES + ", s AS (SELECT *, unnest(range(CAST(floor(least(ax, bx, cx) - 1) AS BIGINT), CAST(floor(greatest(ax, bx, cx) + 1) AS BIGINT) + 1)) AS col FROM n), m AS (SELECT pid, " + f"min({_TO_TRIANGLE}) AS d, CAST(arg_min(tid, {_TO_TRIANGLE} * 1e12 + tid / 1e6) AS BIGINT) AS tid FROM probes p JOIN s ON col = CAST(floor(p.x) AS BIGINT) AND p.y BETWEEN least(ay, by_, cy) - 1 AND greatest(ay, by_, cy) + 1 AND p.z BETWEEN least(az, bz, cz) - 1 AND greatest(az, bz, cz) + 1 WHERE {_TO_TRIANGLE} <= 1 GROUP BY pid)"


def _closest(spark, d):
    return closest.closest_triangles(_probes(spark, d), _corners(spark, d), 1.0, 2.0, "pid")


@query(_CLOSEST + " SELECT pid, round(d, 6) + 0.0 AS d FROM m")
def closest_triangles(spark, d):
    """Distance to the nearest triangle of the mesh, for points that have one within 1."""
    return _closest(spark, d).select("pid", r6(c("d")).alias("d"))


@query(_CLOSEST + " SELECT patch, count(*) AS n, round(count(m.pid) / count(*), 6) AS share, count(m.pid) > 0.1 * count(*) AS accepted FROM probes LEFT JOIN m USING (pid) GROUP BY patch")
def patches_near_mesh(spark, d):
    """Share of a patch's points that are near the mesh, and whether it is accepted by it."""
    shares = closest.share_near(_probes(spark, d), _closest(spark, d), "patch", "pid")
    return shares.select("patch", "n", r6(c("share")).alias("share"), (c("share") > 0.1).alias("accepted"))


_VERTICES = sql("lattice", "tri") + ", e AS (SELECT least(v0, v1) AS a, greatest(v0, v1) AS b FROM tri UNION ALL SELECT least(v1, v2), greatest(v1, v2) FROM tri UNION ALL SELECT least(v2, v0), greatest(v2, v0) FROM tri), o AS (SELECT a, b FROM e GROUP BY ALL HAVING count(*) = 1), rim AS (SELECT vid, x, y, z, 360.0::DOUBLE * u AS w FROM lattice WHERE vid IN (SELECT a FROM o UNION ALL SELECT b FROM o)), " + _PROBES


@query(_VERTICES + ", q AS (SELECT pid, vid, round(sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2), 9) AS d FROM probes p JOIN rim r ON abs(p.x - r.x) <= 1.5 AND abs(p.w - r.w) < 25) SELECT pid, CAST(vid AS BIGINT) AS nearest, round(d, 6) + 0.0 AS d FROM q WHERE d <= 1.5 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, vid) = 1")
def rim_vertex_in_band(spark, d):
    """The nearest vertex of the mesh's rim within 1.5 whose winding differs by less than 25."""
    t, v = _triangles(spark, d), X.lattice(spark, d).select("vid", "x", "y", "z", (360.0 * c("u")).alias("w"))
    ends = mesh.boundary_edges(t).select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    rim = v.join(ends, "vid", "left_semi").withColumnRenamed("vid", "pid")
    best = closest.nearest_in_band(_probes(spark, d).select("pid", "x", "y", "z", "w"), rim, 1.5, "pid", "w", 25.0)
    return best.select("pid", c("nearest").cast("long").alias("nearest"), r6(c("d")).alias("d"))


_E1, _E2, _OFF, _DIR = _less(_B, _A), _less(_C, _A), _less(_PT, _A), ["p.dx", "0.0", "p.dz"]
_H, _Q = _cross(_DIR, _E2), _cross(_OFF, _E1)
_RAYS = _TRI3.replace("WITH ", "WITH " + X.SQL["axis"] + ", " + X.SQL["iv"] + ", ", 1) + ", " + _PROBES + ", g AS (SELECT p.*, p.x - (x0 + (p.y - y0) / (y1 - y0) * (x1 - x0)) AS ox, p.z - (z0 + (p.y - y0) / (y1 - y0) * (z1 - z0)) AS oz FROM probes p JOIN iv ON (p.y >= y0 OR first) AND (p.y < y1 OR last)), rays AS (SELECT *, ox / sqrt(ox * ox + oz * oz) AS dx, oz / sqrt(ox * ox + oz * oz) AS dz FROM g)"


@query(_RAYS + f", k AS (SELECT pid, 18.0::DOUBLE * ax AS tw, p.w AS w, {_dot(_E1, _H)} AS det, {_dot(_OFF, _H)} AS u, {_dot(_DIR, _Q)} AS v, {_dot(_E2, _Q)} AS t FROM rays p JOIN n ON CAST(floor(p.y) AS BIGINT) = CAST(floor((ay + by_ + cy) / 3) AS BIGINT) AND abs(p.x - ax) < 8), h AS (SELECT pid, round(t / det, 9) AS t FROM k WHERE abs(w - tw) < 45 AND abs(det) > 1e-12 AND u / det >= -1e-9 AND v / det >= -1e-9 AND (u + v) / det <= 1 + 1e-9) SELECT pid, round(abs(t), 4) + 0.0 AS d, CASE WHEN t < 0 THEN -1 ELSE 1 END AS way FROM h WHERE abs(t) <= 6 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY abs(t), t < 0) = 1")
def ray_hits(spark, d):
    """The nearest hit within 6 on a triangle of nearly the same winding, along the direction from the axis or against it."""
    p = spatial.axis_join(_probes(spark, d), X.axis(spark, d), "y")
    way = S.unit(c("x") - c("ax"), c("z") - c("az"))
    rays = p.select("pid", "x", "y", "z", way[0].alias("dx"), F.lit(0.0).alias("dy"), way[1].alias("dz"), "w")
    return closest.ray_hits(rays, _corners(spark, d), 6.0, 2.0, "pid", 45.0).select("pid", (F.round("d", 4) + 0.0).alias("d"), "way")


_FOLDED = _TRI3 + ", f AS (SELECT tid * 2 AS tid, ax, ay, az, bx, by_, bz, cx, cy, cz, 360.0::DOUBLE * au AS w FROM n UNION ALL SELECT tid * 2 + 1, ax, ay, 3 - az, bx, by_, 3 - bz, cx, cy, 3 - cz, 360.0::DOUBLE * au + 360 FROM n), k AS (SELECT *, (bx + cx + ax) / 3.0::DOUBLE AS mx, (by_ + cy + ay) / 3.0::DOUBLE AS my, (bz + cz + az) / 3.0::DOUBLE AS mz FROM f)"


def _sat():
    name = lambda t, v: [f"{t}.{x}" for x in v]
    one, two = [name("a", v) for v in (_A, _B, _C)], [name("b", v) for v in (_A, _B, _C)]
    edges = lambda t: [_less(t[1], t[0]), _less(t[2], t[1]), _less(t[0], t[2])]
    e, g = edges(one), edges(two)
    tests = []
    for axis in [_cross(e[0], e[1]), _cross(g[0], g[1]), *[_cross(x, y) for x in e for y in g]]:
        p, q = (", ".join(_dot(v, axis) for v in t) for t in (one, two))
        tests.append(f"({_dot(axis, axis)} < 1e-6 OR (greatest({p}) >= least({q}) AND greatest({q}) >= least({p})))")
    return " AND ".join(tests)


@query(_FOLDED + f", s AS (SELECT a.tid AS a, b.tid AS b FROM k a JOIN k b ON a.tid < b.tid AND abs(a.mx - b.mx) <= 0.7 AND abs(a.my - b.my) <= 0.7 AND sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2 + (a.mz - b.mz) ** 2) <= 0.7 AND abs(a.w - b.w) >= 90 WHERE {_sat()}) SELECT CAST(tid AS BIGINT) AS tid FROM (SELECT a AS tid FROM s UNION SELECT b FROM s)")
def crossing_triangles(spark, d):
    """Triangles of the mesh and of its mirror image, a winding further, that cut one another."""
    rows = _corners(spark, d).withColumnRenamed("c0_w", "w")
    plain = [f"c{i}_{a}" for i in range(3) for a in "xyz"]
    here = rows.select((c("tid") * 2).alias("tid"), *plain, "w")
    there = rows.select((c("tid") * 2 + 1).alias("tid"), *[(3 - c(n)).alias(n) if n.endswith("z") else c(n) for n in plain], (c("w") + 360).alias("w"))
    return closest.crossing_triangles(here.union(there), 0.7, 90.0).select(c("tid").cast("long").alias("tid"))


_SIDES = sql("lattice", "tri") + ", e AS (SELECT v0 AS a, v1 AS b FROM tri UNION SELECT v1, v2 FROM tri UNION SELECT v2, v0 FROM tri), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h0 AS (SELECT vid AS a, vid AS b FROM lattice), h1 AS (SELECT * FROM h0 UNION SELECT h0.a, l.b FROM h0 JOIN l ON l.a = h0.b), h2 AS (SELECT * FROM h1 UNION SELECT h1.a, l.b FROM h1 JOIN l ON l.a = h1.b), h3 AS (SELECT * FROM h2 UNION SELECT h2.a, l.b FROM h2 JOIN l ON l.a = h2.b)"


@query(_SIDES + " SELECT CAST(h3.a AS BIGINT) AS id, count(*) FILTER (b.z > 1) AS n FROM h3 JOIN lattice b ON b.vid = h3.b GROUP BY h3.a")
def frontier_counts(spark, d):
    """Per vertex the vertices above a height within three steps along the mesh, itself included."""
    e = mesh.edges_of(_triangles(spark, d)).select(c("a").alias("src"), c("b").alias("dst"))
    nodes = X.lattice(spark, d).select(c("vid").alias("id"), (c("z") > 1).alias("open"))
    return graph.frontier(nodes, e, 3).select(c("id").cast("long").alias("id"), "n")


# --- belief propagation -------------------------------------------------------------------------------------------

_NODES = sql("nodes", "edges") + ", moved AS (SELECT id, f + 360 * (id % 3) AS f FROM nodes), el AS (SELECT src, dst, certainty, round((a.f - b.f + k) / 360 + 1e-9) AS ell FROM edges JOIN moved a ON a.id = src JOIN moved b ON b.id = dst)"


def _moved(spark, d):
    return X.nodes(spark, d).select("id", (c("f") + 360 * (c("id") % 3)).alias("f"))


@query(_NODES + ", p AS (SELECT *, abs(ell + s1 - s2) AS away FROM el, range(-1, 3) a(s1), range(-1, 3) b(s2)) SELECT src, dst, CAST(s1 AS INT) AS s1, CAST(s2 AS INT) AS s2, CASE WHEN s1 < 2 AND s2 < 2 THEN round(-certainty * away, 6) + 0.0 END AS plain, round(CASE WHEN s1 = 2 AND s2 = 2 THEN -1.0 WHEN s1 = 2 OR s2 = 2 THEN -0.5 ELSE -certainty * exp(away) END, 6) + 0.0 AS switched FROM p")
def belief_potentials(spark, d):
    """Potentials of all pairs of shifts, and those where an end can be switched off."""
    rows = belief.with_turns(_moved(spark, d), X.edges(spark, d))
    both = belief.potentials(rows, 1, 0.5)
    return both.select("src", "dst", "s1", "s2", r6(c("plain")).alias("plain"), r6(c("potential")).alias("switched"))


_STEP = _NODES + ", m AS (SELECT dst AS id, s2 AS s, max(-certainty * abs(ell + s1 - s2)) AS m FROM el, range(-2, 3) a(s1), range(-2, 3) b(s2) GROUP BY src, dst, certainty, ell, s2 UNION ALL SELECT src, s1, max(-certainty * abs(ell + s1 - s2)) FROM el, range(-2, 3) a(s1), range(-2, 3) b(s2) GROUP BY src, dst, certainty, ell, s1), t AS (SELECT id, s, sum(m) AS t FROM m GROUP BY id, s), z AS (SELECT id, s FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(t, 9) DESC, s) = 1)"


@query(_STEP + " SELECT id, CAST(coalesce(s, 0) AS INT) AS shift, round(f + 360 * coalesce(s, 0), 6) + 0.0 AS f FROM moved LEFT JOIN z USING (id)")
def belief_step(spark, d):
    """Every node's shift after one round of messages, and its angle moved by it."""
    nodes = _moved(spark, d)
    shifts = belief.decode(belief.with_turns(nodes, X.edges(spark, d)), 2, 1, 0.0)
    rows = belief.shifted(nodes, shifts).join(shifts, "id", "left")
    return rows.select("id", F.coalesce("shift", F.lit(0)).alias("shift"), r6(c("f")).alias("f"))


@query(_NODES + " SELECT count(*) AS n, round(avg(certainty * abs(ell)), 6) AS loss FROM el")
def belief_loss(spark, d):
    return belief.loss(_moved(spark, d), X.edges(spark, d)).select("n", r6(c("loss")).alias("loss"))


# --- grid relaxation ----------------------------------------------------------------------------------------------

_SHEETS = sql("lattice") + ", o AS (SELECT i, j, -4 * z - i * 0.25::DOUBLE AS t, (i + j) % 3 = 0 AS fixed FROM lattice), b AS (SELECT o.*, l.t AS l, r.t AS r FROM o LEFT JOIN o l ON l.i = o.i - 5 AND l.j = o.j LEFT JOIN o r ON r.i = o.i + 5 AND r.j = o.j), q AS (SELECT o.i, o.j, avg(n.t) AS m, avg(n.r - n.t) AS mr, avg(n.l - n.t) AS ml FROM b o LEFT JOIN b n ON abs(o.i - n.i) + abs(o.j - n.j) = 1 AND n.i BETWEEN o.i - 1 AND o.i + 1 GROUP BY o.i, o.j), a AS (SELECT b.*, least(0.0, (coalesce(m, 0) + coalesce(r - mr, 0) + coalesce(l - ml, 0)) / (1 + CAST(r - mr IS NOT NULL AS INT) + CAST(l - ml IS NOT NULL AS INT))) - t AS d0 FROM b JOIN q USING (i, j)), d1 AS (SELECT *, CASE WHEN l IS NOT NULL AND (t > l) <> (t + d0 > l) THEN (l - t) * 0.5 ELSE d0 END AS d1 FROM a), st AS (SELECT *, CASE WHEN r IS NOT NULL AND (t > r) <> (t + d1 > r) THEN (r - t) * 0.5 ELSE d1 END AS d FROM d1)"


def _sheets(spark, d):
    v = X.lattice(spark, d)
    return v.select("i", "j", (-4 * c("z") - c("i") * 0.25).alias("t"), ((c("i") + c("j")) % 3 == 0).alias("fixed"))


@query(_SHEETS + " SELECT i, j, round(t + CASE WHEN fixed THEN 0 ELSE 0.1::DOUBLE * d END, 6) + 0.0 AS t, fixed, round(CASE WHEN fixed THEN 0 ELSE d END, 6) + 0.0 AS d FROM st")
def relaxation_sweep(spark, d):
    """One sweep of the ordered grid; its sheets repeat every five steps."""
    rows = relax.sweep(_sheets(spark, d), 5)
    return rows.select("i", "j", r6(c("t")).alias("t"), "fixed", r6(c("d")).alias("d"))


@query(_SHEETS + ", li AS (SELECT 1.5::DOUBLE * avg(abs(d)) FILTER (fixed) AS hi, 0.2::DOUBLE * avg(abs(d)) FILTER (NOT fixed) AS lo FROM st) SELECT i, j, (fixed AND abs(d) <= hi) OR abs(d) < lo AS fixed FROM st, li")
def relaxation_refixed(spark, d):
    """Which cells are fixed after those with great errors came loose and those with small ones were fixed."""
    return relax.refixed(_sheets(spark, d), 5, 1.5).select("i", "j", "fixed")


# --- evaluation ---------------------------------------------------------------------------------------------------

_BOXES = sql("points") + ", dt AS (SELECT pid AS id, conf AS score, x AS x0, z AS y0, x + 6 + conf AS x1, z + 5 AS y1 FROM points), gt AS (SELECT pid AS id, x + 1 AS x0, y AS y0, x + 7 AS x1, y + 6 AS y1 FROM points WHERE lab >= 5), ov AS (SELECT a.id AS a, b.id AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM dt a, gt b), be AS (SELECT a AS id, b AS truth, w * h / (s - w * h) AS iou FROM ov WHERE w > 0 AND h > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY w * h / (s - w * h) DESC, b) = 1), hi AS (SELECT id FROM be JOIN dt USING (id) WHERE iou > 0.25 QUALIFY row_number() OVER (PARTITION BY truth ORDER BY score DESC, id) = 1)"


@query(_BOXES + " SELECT dt.id, be.truth, hi.id IS NOT NULL AS hit FROM dt LEFT JOIN be USING (id) LEFT JOIN hi ON hi.id = dt.id")
def matched_detections(spark, d):
    """Detections with their best ground truth; the best-scored one above the overlap is its hit."""
    p = X.points(spark, d)
    dt = p.select(c("pid").alias("id"), c("conf").alias("score"), c("x").alias("x0"), c("z").alias("y0"), (c("x") + 6 + c("conf")).alias("x1"), (c("z") + 5).alias("y1"))
    gt = p.where("lab >= 5").select(c("pid").alias("id"), (c("x") + 1).alias("x0"), c("y").alias("y0"), (c("x") + 7).alias("x1"), (c("y") + 6).alias("y1"))
    return evaluate.matched(dt, gt, 8.0, 0.25).select("id", "truth", "hit")
