"""Further named queries: fields, blocks, sampling, mesh filters, graph building and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windlass.functions import scalars as S
from windlass.functions.scalars import r6
from windlass.operators import evaluate, fields, graph, mesh, neighbours, sequences, solver, spatial
from windlass.sources.shared import materialize, table

from . import fixtures as X
from .catalogue import _BOTH, _ERR, _NEAR, _OVER, _POLAR, _TRI3, _overlaps, _triangles, _voxels, c, query
from .fixtures import sql


def _o(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _axes(names: str) -> list:
    return [c(n) for n in names.split()]


P, N = "x y z", "nx ny nz"
_UNIT = sql("points") + ", l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS m FROM points), u AS (SELECT *, nx / m AS vx, ny / m AS vy, nz / m AS vz FROM l)"

# --- vectors, rotations, coordinates ------------------------------------------------------------------------------


@query(sql("points") + ", a AS (SELECT pid, atan2(nz, nx) - atan2(z, x) AS a FROM points) SELECT pid, " + _o("degrees(CASE WHEN a > pi() THEN a - 2 * pi() WHEN a < -pi() THEN a + 2 * pi() ELSE a END)", "turn") + " FROM a")
def half_turn_wrap(spark, d):
    return X.points(spark, d).select("pid", r6(fields.one_turn_degrees(S.signed_angle(c("x"), c("z"), c("nx"), c("nz")))).alias("turn"))


@query(sql("points") + ", k AS (SELECT pid, least(20, greatest(-20, x)) AS x, least(20, greatest(-20, z)) AS z FROM points), t AS (SELECT greatest(1e-8, max(abs(x)), max(abs(z))) AS top FROM k) SELECT pid, " + _o("x / top", "x") + ", " + _o("z / top", "z") + " FROM k, t")
def scaled_field(spark, d):
    return fields.scaled_to_one(X.points(spark, d).select("pid", "x", "z"), ["x", "z"], 20.0).select("pid", r6(c("x")).alias("x"), r6(c("z")).alias("z"))


@query(sql("points") + ", s AS (SELECT *, CASE WHEN nx + 0.5 * ny < 0 THEN -1 ELSE 1 END AS s FROM points) SELECT pid, " + ", ".join(_o(f"s * n{a}", f"n{a}") for a in "xyz") + " FROM s")
def oriented_normals(spark, d):
    v = fields.facing(_axes(N), [F.lit(1.0), F.lit(0.5), F.lit(0.0)])
    return X.points(spark, d).select("pid", *[r6(x).alias(n) for x, n in zip(v, N.split(), strict=True)])


@query(sql("points") + ", m AS (SELECT lab, avg(nx) AS a, avg(ny) AS b, avg(nz) AS e, avg(sqrt(nx * nx + ny * ny + nz * nz)) AS l FROM points GROUP BY lab) SELECT lab, " + ", ".join(_o(f"{v} / sqrt(a * a + b * b + e * e) * l", n) for v, n in zip("abe", N.split(), strict=True)) + " FROM m")
def mean_amplitude(spark, d):
    per = X.points(spark, d).groupBy("lab").agg(*[F.avg(n).alias(n) for n in N.split()], F.avg(S.norm(*_axes(N))).alias("l"))
    return per.select("lab", *[r6(v * c("l")).alias(n) for v, n in zip(S.unit(*_axes(N)), N.split(), strict=True)])


_ALIGN = _UNIT + ", k AS (SELECT *, sqrt(vx * vx + vy * vy) AS f, acos(greatest(-1.0, least(1.0, -vz))) AS th FROM u), r AS (SELECT *, vy / f AS kx, -vx / f AS ky, sin(th) AS s, 1 - cos(th) AS q FROM k), t AS (SELECT *, x * (1 - q * ky * ky) + y * q * kx * ky - z * s * ky AS rx, x * q * kx * ky + y * (1 - q * kx * kx) + z * s * kx AS ry, x * s * ky - y * s * kx + z * (1 - q * (kx * kx + ky * ky)) AS rz FROM r)"


@query(_ALIGN + " SELECT pid, " + ", ".join(_o(f"r{a}", f"r{a}") for a in "xyz") + " FROM t")
def aligned_points(spark, d):
    t = fields.times(_axes(P), fields.alignment(_axes(N)))
    return X.points(spark, d).select("pid", *[r6(v).alias(f"r{a}") for v, a in zip(t, "xyz", strict=True)])


_FLAT = "(0.5 + 0.1 * ry + 0.002 * ry * ry - 0.2 * rx + 0.001 * rx * ry + 0.003 * rx * rx)"


@query(_ALIGN + f" SELECT pid, {_o(f'abs(rz - {_FLAT})', 'd')}, {_o(f'least(20, greatest(0.5, abs(rz - {_FLAT})))', 'clipped')} FROM t")
def surface_distance(spark, d):
    x, y, z = fields.times(_axes(P), fields.alignment(_axes(N)))
    rows = X.points(spark, d).select("pid", x.alias("x"), y.alias("y"), z.alias("z"))
    dist = F.abs(c("z") - S.polynomial(c("x"), c("y"), [0.5, 0.1, 0.002, -0.2, 0.001, 0.003], 2))
    return rows.select("pid", r6(dist).alias("d"), r6(F.least(F.lit(20.0), F.greatest(F.lit(0.5), dist))).alias("clipped"))


_MATRIX = [[0.0, 0.25, 0.0, 125.0], [0.0, 0.0, 0.25, 125.0], [0.25, 0.0, 0.0, 125.0], [0.0, 0.0, 0.0, 1.0]]


@query(sql("points") + " SELECT pid, " + ", ".join(_o(e, n) for e, n in (("y * 0.25 + 125", "tx"), ("z * 0.25 + 125", "ty"), ("x * 0.25 + 125", "tz"), ("x", "bx"), ("y", "by_"), ("z", "bz"))) + " FROM points")
def affine_points(spark, d):
    """A 4 x 4 transform and its inverse."""
    there = X.points(spark, d).select("pid", *[v.alias(f"t{a}") for v, a in zip(fields.affine(_axes(P), _MATRIX), "xyz", strict=True)])
    back = fields.affine([c("tx"), c("ty"), c("tz")], S.inverse_transform(_MATRIX))
    return there.select("pid", *[r6(c(f"t{a}")).alias(f"t{a}") for a in "xyz"], *[r6(v).alias(n) for v, n in zip(back, ("bx", "by_", "bz"), strict=True)])


@query(sql("lattice") + ", e AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM lattice) SELECT vid, " + _o("(u - u0) / (u1 - u0)", "u") + ", " + _o("(v - v0) / (v1 - v0)", "v") + " FROM lattice, e")
def unit_uv(spark, d):
    return fields.scaled_to_range(X.lattice(spark, d).select("vid", "u", "v"), ["u", "v"]).select("vid", r6(c("u")).alias("u"), r6(c("v")).alias("v"))


@query(_POLAR + ", o AS (SELECT pid, x - ax AS ox, z - az AS oz, nx, nz, conf FROM g) SELECT pid, " + ", ".join((_o("ox", "ox"), _o("oz", "oz"), _o("-sqrt(ox * ox + oz * oz)", "radius"), _o("nz * ox - nx * oz", "beside"))) + ", greatest(0, CAST(trunc((conf * 5000 - 90 + 180) / 360) AS INT)) AS turn FROM o")
def about_origin(spark, d):
    """Points about the axis, their negative radius, their distance beside a direction, and the turn that a winding angle is in."""
    rows = spatial.axis_join(X.points(spark, d), X.axis(spark, d), "y").withColumns({"ox": c("x") - c("ax"), "oz": c("z") - c("az")})
    return rows.select("pid", r6(c("ox")).alias("ox"), r6(c("oz")).alias("oz"), r6(-S.norm(c("ox"), c("oz"))).alias("radius"), r6(S.beside(c("ox"), c("oz"), c("nx"), c("nz"))).alias("beside"), S.turn_index(c("conf") * 5000, F.lit(0.0), F.lit(90.0)).alias("turn"))


@query(sql("dense") + ", v AS (SELECT DISTINCT x, y, z FROM dense) SELECT x, y, z, " + ", ".join(_o(f"{a} / 24.5 - 1", f"g{a}") for a in "zyx") + ", " + ", ".join(f"CAST((({a} - 3) % 16 + 16) % 16 AS BIGINT) AS l{a}, CAST(floor(({a} - 3) / 16.0) AS BIGINT) AS i{a}" for a in "xyz") + " FROM v")
def sample_coordinates(spark, d):
    """Array positions as reversed coordinates in [-1, 1] and as (chunk, position in the chunk)."""
    rows = X.dense(spark, d).select("x", "y", "z").distinct()
    local = [e for a in "xyz" for e in (F.pmod(c(a) - 3, F.lit(16)).cast("long").alias(f"l{a}"), F.floor((c(a) - 3) / 16).alias(f"i{a}"))]
    return rows.select("x", "y", "z", *[r6(c(a) / (0.5 * 51 - 1.0) - 1.0).alias(f"g{a}") for a in "zyx"], *local)


@query(_UNIT + ", t AS (SELECT *, cos(radians(30)) AS k, sin(radians(30)) AS s, vx * x + vy * y + vz * z AS a FROM u) SELECT pid, " + ", ".join((_o("k * x + s * (vy * z - vz * y) + (1 - k) * a * vx", "ax"), _o("k * y + s * (vz * x - vx * z) + (1 - k) * a * vy", "ay"), _o("k * z + s * (vx * y - vy * x) + (1 - k) * a * vz", "az"), _o("cos(radians(40)) * x - sin(radians(40)) * y", "zx"), _o("sin(radians(40)) * x + cos(radians(40)) * y", "zy"))) + " FROM t")
def axis_rotations(spark, d):
    """Points turned about their own normals by 30 degrees, and about z by 40."""
    a = fields.turned(_axes(P), S.unit(*_axes(N)), F.radians(F.lit(30.0)))
    z = S.rotate_about_z(*_axes(P), F.radians(F.lit(40.0)))
    return X.points(spark, d).select("pid", *[r6(v).alias(f"a{n}") for v, n in zip(a, "xyz", strict=True)], r6(z[0]).alias("zx"), r6(z[1]).alias("zy"))


# --- blocks -------------------------------------------------------------------------------------------------------

_BLOCKS = sql("dense") + ", b AS (SELECT DISTINCT x // 25 * 25 AS bx, y // 25 * 25 AS by_, z // 25 * 25 AS bz FROM dense)"


def _blocks(spark, d, size=25):
    cell = lambda v: F.floor(c(v) / size) * size
    return X.dense(spark, d).select(cell("x").alias("bx"), cell("y").alias("by_"), cell("z").alias("bz")).distinct()


@query(_BLOCKS + " SELECT bx, by_, bz, bx + 25 AS nx, by_ AS ny, bz AS nz FROM b UNION ALL SELECT bx, by_, bz, bx, by_ + 25, bz FROM b UNION ALL SELECT bx, by_, bz, bx, by_, bz + 25 FROM b")
def forward_blocks(spark, d):
    return fields.forward_blocks(_blocks(spark, d), ("bx", "by_", "bz"))


@query(sql("points") + " SELECT CAST(floor(x / 25) * 25 + a AS BIGINT) AS cx, CAST(floor(y / 25) * 25 + b AS BIGINT) AS cy, CAST(floor(z / 25) * 25 + e AS BIGINT) AS cz, count(*) AS n FROM points, range(-25, 26, 25) t1(a), range(-25, 26, 25) t2(b), range(-25, 26, 25) t3(e) GROUP BY ALL")
def cells_of_points(spark, d):
    return fields.cells_around(X.points(spark, d)).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


@query(sql("dense") + ", b AS (SELECT DISTINCT x // 5 * 5 AS bx, y // 5 * 5 AS by_, z // 5 * 5 AS bz FROM dense WHERE (x + y + z) % 4 = 0) SELECT a.bx, a.by_, a.bz, count(*) AS n FROM b a JOIN b ON abs(a.bx - b.bx) <= 10 AND abs(a.by_ - b.by_) <= 10 AND abs(a.bz - b.bz) <= 10 GROUP BY ALL")
def block_neighbourhood(spark, d):
    cell = lambda v: F.floor(c(v) / 5) * 5
    b = X.dense(spark, d).where("(x + y + z) % 4 = 0").select(cell("x").alias("bx"), cell("y").alias("by_"), cell("z").alias("bz")).distinct()
    return fields.neighbour_counts(b, ("bx", "by_", "bz"), 5, 2)


@query(sql("dense") + ", b AS (SELECT DISTINCT x // 5 * 5 AS bx, y // 5 * 5 AS by_, z // 5 * 5 AS bz FROM dense), s AS (SELECT *, least(abs(bx - 10), abs(40 - bx), abs(by_ - 10), abs(40 - by_)) AS border, abs((bx - 20) * (bx - 20) + (by_ - 20) * (by_ - 20) - 225) AS ring FROM b) (SELECT 'border' AS rule, bx, by_, bz FROM s ORDER BY border, bx, by_, bz LIMIT 1) UNION ALL (SELECT 'ring', bx, by_, bz FROM s ORDER BY ring, bx, by_, bz LIMIT 1)")
def picked_blocks(spark, d):
    """The block nearest to the border of a region, and that nearest to a ring about a centre; ties to the smallest."""
    b = _blocks(spark, d, 5)
    border = F.least(F.abs(c("bx") - 10), F.abs(40 - c("bx")), F.abs(c("by_") - 10), F.abs(40 - c("by_")))
    ring = F.abs((c("bx") - 20) * (c("bx") - 20) + (c("by_") - 20) * (c("by_") - 20) - 225)
    best = b.agg(*[F.min(F.struct(cost.alias("cost"), "bx", "by_", "bz")).alias(name) for name, cost in (("border", border), ("ring", ring))])
    return best.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c(f"{n}.bx").alias("bx"), c(f"{n}.by_").alias("by_"), c(f"{n}.bz").alias("bz")) for n in ("border", "ring")])).alias("s")).select("s.*")


@query(sql("dense", recursive=True) + ", b AS (SELECT DISTINCT x // 5 AS bx, y // 5 AS by_, z // 5 AS bz FROM dense WHERE (x // 5 - 4) * (x // 5 - 4) + (z // 5 - 4) * (z // 5 - 4) <= 16 AND (x // 5 + 2 * (y // 5) + z // 5) % 5 > 0), r AS (SELECT bx, by_, bz FROM b WHERE bx = 4 AND by_ = 4 AND bz = 4 UNION SELECT b.bx, b.by_, b.bz FROM r JOIN b ON abs(r.bx - b.bx) + abs(r.by_ - b.by_) + abs(r.bz - b.bz) = 1) SELECT bx, by_, bz FROM r")
def flooded_blocks(spark, d):
    """Blocks that a flood from one block reaches over its six neighbours: those of the start's component."""
    cell = lambda v: F.floor(c(v) / 5)
    b = X.dense(spark, d).select(cell("x").alias("bx"), cell("y").alias("by_"), cell("z").alias("bz")).distinct().where("(bx - 4) * (bx - 4) + (bz - 4) * (bz - 4) <= 16 AND (bx + 2 * by_ + bz) % 5 > 0")
    key = lambda x, y, z: (x * 1000 + y) * 1000 + z
    b = materialize(b.withColumn("id", key(c("bx"), c("by_"), c("bz"))))
    ahead = F.explode(F.array(key(c("bx") + 1, c("by_"), c("bz")), key(c("bx"), c("by_") + 1, c("bz")), key(c("bx"), c("by_"), c("bz") + 1)))
    links = b.select(c("id").alias("src"), ahead.alias("dst")).join(b.select(c("id").alias("dst")), "dst", "left_semi")
    named = materialize(b.join(graph.components(b, links), "id"))
    start = named.where("bx = 4 AND by_ = 4 AND bz = 4").select("component")
    return named.join(F.broadcast(start), "component", "left_semi").select("bx", "by_", "bz")  # one row


# --- samples, ranges ----------------------------------------------------------------------------------------------


@query(sql("dense") + ", r AS (SELECT patch, x, y, pid, q, disc, w, z, count(*) FILTER (disc < 0.005) OVER (PARTITION BY patch, x) AS few, row_number() OVER (PARTITION BY patch, x ORDER BY pid, y, z, w, q) AS number FROM dense WHERE y < 10) SELECT patch, x, count(*) AS n, min(pid) AS pid FROM r WHERE disc < 0.005 OR (few = 0 AND number = 1) GROUP BY ALL")
def ratio_sample(spark, d):
    """Rows below a ratio, and the first of every group that has none: the group's aggregates say which, without a window."""
    per = X.dense(spark, d).where("y < 10").groupBy("patch", "x").agg(F.count_if(c("disc") < 0.005).alias("n"), F.min(F.when(c("disc") < 0.005, c("pid"))).alias("pid"), F.min("pid").alias("first"))
    return per.select("patch", "x", F.greatest(c("n"), F.lit(1)).alias("n"), F.coalesce("pid", "first").alias("pid"))


@query(sql("points") + " SELECT pid FROM points ORDER BY md5(pid || ':7'), pid LIMIT 100")
def uniform_subsample(spark, d):
    return fields.drawn(X.points(spark, d).select("pid"), "pid", 100, 7)


@query(_POLAR + " SELECT pid, lab FROM g WHERE conf * 3600 > 100 AND conf * 3600 < 900 AND z - az < 5")
def open_winding_range(spark, d):
    rows = spatial.axis_join(X.points(spark, d), X.axis(spark, d), "y")
    return rows.where("conf * 3600 > 100 AND conf * 3600 < 900 AND z - az < 5").select("pid", "lab")


@query(sql("points") + f", p AS (SELECT pid, x, y, z, conf * 3600 AS w FROM points), n AS (SELECT a.pid, a.w, b.w AS bw FROM p a JOIN p b ON a.pid <> b.pid AND {_NEAR} <= 9 AND abs(a.w - b.w) > 120) SELECT pid FROM p WHERE pid NOT IN (SELECT pid FROM n WHERE w > bw)")
def larger_winding_removed(spark, d):
    """Of two near points on different windings that with the larger angle goes."""
    p = X.points(spark, d).select("pid", "x", "y", "z", (c("conf") * 3600).alias("w"))
    gone = spatial.radius_join(p, p, 9.0).where("a_w - b_w > 120").select(c("a_pid").alias("pid")).distinct()
    return p.select("pid").join(gone, "pid", "left_anti")


@query(sql("points") + f", n AS (SELECT a.pid AS a, b.pid AS b, a.lab < 5 AS low, {_NEAR} AS d FROM points a JOIN points b ON (a.lab < 5) <> (b.lab < 5) AND {_NEAR} <= 15), m AS (SELECT low, a, min(d) AS d FROM n GROUP BY ALL) SELECT low, count(*) AS n, round(avg(d * d), 6) AS mean FROM m GROUP BY low")
def two_way_nearest(spark, d):
    """Mean squared distance to the nearest point of the other half, both ways."""
    p = X.points(spark, d).select("pid", "x", "y", "z", (c("lab") < 5).alias("low"))
    pairs = spatial.radius_join(p, p, 15.0).where("a_low <> b_low").groupBy(c("a_low").alias("low"), "a_pid").agg(F.min("d").alias("d"))
    return pairs.groupBy("low").agg(F.count("*").alias("n"), r6(F.avg(c("d") * c("d"))).alias("mean"))


@query(sql("points") + ", i AS (SELECT pid, lab, x AS lo, x + 0.6 AS hi, conf * 3600 AS w FROM points) SELECT a.pid AS a, count(*) AS n FROM i a JOIN i b ON a.pid <> b.pid AND a.lo <= b.hi AND b.lo <= a.hi AND abs(a.w - b.w) < 300 GROUP BY a.pid")
def interval_partners(spark, d):
    """Overlapping intervals of one length on near windings: starts no further apart than that length."""
    p = X.points(spark, d).select("pid", "x", (c("conf") * 3600).alias("w"))
    return spatial.band_join(p, p, "x", 0.6).where("a_pid <> b_pid AND abs(a_w - b_w) < 300 AND a_x <= b_x + 0.6 AND b_x <= a_x + 0.6").groupBy(c("a_pid").alias("a")).agg(F.count("*").alias("n"))


# --- windings -----------------------------------------------------------------------------------------------------

_FILL = sql("grid") + ", s AS (SELECT i, avg(CASE WHEN t IS NULL THEN 0 ELSE 1 END) AS rate FROM grid GROUP BY i), v AS (SELECT i // 5 AS winding, avg(CASE WHEN rate > 0.09 THEN 1 ELSE 0 END) AS valid FROM s GROUP BY 1)"


def _windings(spark, d):
    steps = X.grid(spark, d).groupBy("i").agg(F.avg(c("t").isNotNull().cast("int")).alias("rate"))
    return steps.groupBy(F.floor(c("i") / 5).alias("winding")).agg(F.avg((c("rate") > 0.09).cast("int")).alias("valid"))


@query(_FILL + " SELECT winding, round(valid, 6) AS valid, winding BETWEEN (SELECT min(winding) FROM v WHERE valid > 0.5) AND (SELECT max(winding) FROM v WHERE valid > 0.5) AS kept FROM v")
def trimmed_windings(spark, d):
    """Windings before the first and after the last valid one are trimmed."""
    v = _windings(spark, d)
    ends = v.where("valid > 0.5").agg(F.min("winding").alias("lo"), F.max("winding").alias("hi"))
    return v.join(F.broadcast(ends)).select("winding", r6(c("valid")).alias("valid"), c("winding").between(c("lo"), c("hi")).alias("kept"))  # one row


@query(_FILL + ", w AS (SELECT winding - 3 AS lo, winding + 3 AS hi FROM v WHERE valid > 0.9), b AS (SELECT *, max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w), g AS (SELECT *, sum(CASE WHEN lo > m THEN 1 ELSE 0 END) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS r FROM b) SELECT CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi, count(*) AS n FROM g GROUP BY r")
def valid_sectors(spark, d):
    """Runs of valid sectors, widened by three on both sides and merged."""
    v = _windings(spark, d).where("valid > 0.9").select(F.lit(0).alias("one"), (c("winding") - 3).alias("lo"), (c("winding") + 3).alias("hi"))
    return sequences.merge_intervals(v, ["one"], "lo", "hi").select("lo", "hi", "n")


@query(sql("grid") + ", r AS (SELECT j, count(t) / count(*) AS rate FROM grid GROUP BY j) SELECT min(j) AS first, max(j) AS last, count(*) AS n FROM r WHERE rate > 0.09")
def z_fill_range(spark, d):
    r = X.grid(spark, d).groupBy("j").agg((F.count("t") / F.count("*")).alias("rate"))
    return r.where("rate > 0.09").agg(F.min("j").alias("first"), F.max("j").alias("last"), F.count("*").alias("n"))


@query(sql("grid") + ", h AS (SELECT i, j, t, 2 * i < (SELECT max(i) FROM grid) AS outer_half FROM grid), e AS (SELECT i, min(t) AS lo, max(t) AS hi FROM grid GROUP BY i) SELECT round(avg(t) FILTER (outer_half), 6) + 0.0 AS outermost, round(avg(t) FILTER (NOT outer_half), 6) + 0.0 AS innermost, avg(t) FILTER (outer_half) >= avg(t) FILTER (NOT outer_half) AS reversed, (SELECT round(avg(lo), 6) + 0.0 FROM e) AS lo, (SELECT round(avg(hi), 6) + 0.0 FROM e) AS hi FROM h")
def winding_direction(spark, d):
    """Means of the outer and the inner half say the direction; means of every step's ends say the range. One pass per step."""
    g = X.grid(spark, d).groupBy("i").agg(F.sum("t").alias("s"), F.count("t").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    top = g.agg(F.max("i").alias("top"))
    rows = g.join(F.broadcast(top)).withColumn("outer_half", 2 * c("i") < c("top"))  # one row
    mean = lambda side: F.sum(F.when(side, c("s"))) / F.sum(F.when(side, c("n")))
    a, b = mean(c("outer_half")), mean(~c("outer_half"))
    return rows.agg(a.alias("a"), b.alias("b"), F.avg("lo").alias("lo"), F.avg("hi").alias("hi")).select(r6(c("a")).alias("outermost"), r6(c("b")).alias("innermost"), (c("a") >= c("b")).alias("reversed"), r6(c("lo")).alias("lo"), r6(c("hi")).alias("hi"))


@query(sql("nodes") + " SELECT round(abs(360.0 * 60 / (max(f) - min(f))), 6) AS scale, min(f) AS lo, max(f) AS hi FROM nodes")
def winding_scale(spark, d):
    return X.nodes(spark, d).agg(r6(F.abs(360.0 * 60 / F.nullif(F.max("f") - F.min("f"), F.lit(0.0)))).alias("scale"), F.min("f").alias("lo"), F.max("f").alias("hi"))


@query(sql("grid") + " SELECT CAST(j % 24 AS BIGINT) AS step, count(*) AS n, round(avg(t), 6) + 0.0 AS mean FROM grid GROUP BY 1")
def same_direction_columns(spark, d):
    """Positions of one angle stand a whole turn of steps apart."""
    return X.grid(spark, d).groupBy((c("j") % 24).alias("step")).agg(F.count("*").alias("n"), r6(F.avg("t")).alias("mean"))


@query()
def spaced_columns(spark, d):
    return sequences.spaced(X.grid(spark, d).where("t IS NOT NULL").select("i", "j", "t"), "i", "j", "t", 40.0).select("i", "j")


@query()
def best_w_dedup(spark, d):
    return sequences.best_window(X.dense(spark, d), ["x", "y", "z"], "w", 90.0).select("x", "y", "z", "w", "n")


@query(sql("points") + ", m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points), s AS (SELECT lab, count(*) AS n, min(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) AS d FROM points, m GROUP BY lab) SELECT lab, n, round(d, 6) AS d FROM s WHERE n > 20 ORDER BY s.d, lab LIMIT 1")
def starting_patch(spark, d):
    """The patch with enough points that comes nearest to the centroid."""
    p = X.points(spark, d)
    mid = p.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    per = p.join(F.broadcast(mid)).groupBy("lab").agg(F.count("*").alias("n"), F.min(S.norm(*[c(a) - c(f"m{a}") for a in "xyz"])).alias("d"))  # one row
    return per.where("n > 20").agg(F.min(F.struct("d", "lab", "n")).alias("b")).select("b.lab", "b.n", r6(c("b.d")).alias("d"))


@query(sql("dense") + ", a AS (SELECT patch, x, max(w) AS w FROM dense WHERE patch <= 4 GROUP BY ALL), b AS (SELECT patch, x, min(w) AS w FROM dense WHERE patch >= 3 GROUP BY ALL) SELECT patch, x, w FROM b UNION ALL SELECT patch, x, w FROM a WHERE (patch, x) NOT IN (SELECT (patch, x) FROM b)")
def upserted_patches(spark, d):
    """New rows replace those of their key: a full join that takes the new side where it is there."""
    rows = X.dense(spark, d)
    old = rows.where("patch <= 4").groupBy("patch", "x").agg(F.max("w").alias("w"))
    new = rows.where("patch >= 3").groupBy("patch", "x").agg(F.min("w").alias("v"))
    return old.join(new, ["patch", "x"], "full").select("patch", "x", F.coalesce("v", "w").alias("w"))


# --- mesh ---------------------------------------------------------------------------------------------------------

_MEASURED = _TRI3 + ", q AS (SELECT *, 0.5 * sqrt(nx * nx + ny * ny + nz * nz) AS area, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) AS l0, sqrt((cx - bx) ** 2 + (cy - by_) ** 2 + (cz - bz) ** 2) AS l1, sqrt((ax - cx) ** 2 + (ay - cy) ** 2 + (az - cz) ** 2) AS l2 FROM n)"


def _corners(spark, d):
    rows = mesh.corners(_triangles(spark, d), X.lattice(spark, d), ["x", "y", "z"])
    return rows, [[c(f"c{i}_{a}") for a in "xyz"] for i in range(3)]


@query(_MEASURED + " SELECT CAST(tid AS BIGINT) AS tid FROM q WHERE area > 0.6 AND area < 1000 AND greatest(l0, l1, l2) < 3 AND least(l0, l1, l2) > 1e-3")
def filtered_triangles(spark, d):
    """Triangles neither too small nor too large, without long or short sides."""
    rows, p = _corners(spark, d)
    side = fields.sides(*p)
    return rows.where((S.triangle_area(*p).between(0.6000000001, 999.9999999)) & (F.greatest(*side) < 3) & (F.least(*side) > 1e-3)).select(c("tid").cast("long").alias("tid"))


@query(_TRI3 + " SELECT CAST(tid AS BIGINT) AS tid, " + ", ".join(_o(f"(a{a} + b{a}{'_' if a == 'y' else ''} + c{a}) / 3", f"m{a}") for a in "xyz") + " FROM n WHERE greatest(ax, bx, cx) <= 100 AND least(ax, bx, cx) >= 20 AND greatest(ay, by_, cy) <= 40 AND least(az, bz, cz) < 2")
def trimmed_mesh(spark, d):
    """Triangles inside a box and cut at a height, with their centroids."""
    rows, p = _corners(spark, d)
    ends = lambda f, a: f(*[q[a] for q in p])
    inside = (ends(F.greatest, 0) <= 100) & (ends(F.least, 0) >= 20) & (ends(F.greatest, 1) <= 40) & (ends(F.least, 2) < 2)
    return rows.where(inside).select(c("tid").cast("long").alias("tid"), *[r6((p[0][i] + p[1][i] + p[2][i]) / 3).alias(f"m{a}") for i, a in enumerate("xyz")])


@query(sql("lattice", "tri") + ", u AS (SELECT tid, unnest([v0, v1, v2]) AS vid FROM tri), e AS (SELECT DISTINCT tid, CAST(floor((x + a) / 10) AS BIGINT) AS cx, CAST(floor((y + b) / 10) AS BIGINT) AS cy FROM u JOIN lattice USING (vid), (VALUES (-2.0), (0.0), (2.0)) s(a), (VALUES (-2.0), (0.0), (2.0)) t(b)) SELECT cx, cy, count(*) AS n FROM e GROUP BY ALL")
def padded_cell_triangles(spark, d):
    """Triangles with a corner in a cell or within 2 of it: corners are dealt to the cells that they reach."""
    uses = _triangles(spark, d).select("tid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(X.lattice(spark, d).select("vid", "x", "y"), "vid")
    reach = lambda v: F.explode(F.array_distinct(F.array(*[F.floor((c(v) + a) / 10) for a in (-2.0, 0.0, 2.0)])))
    return uses.withColumn("cx", reach("x")).withColumn("cy", reach("y")).select("tid", "cx", "cy").distinct().groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query(sql("lattice", "tri") + ", o AS (SELECT vid, row_number() OVER (ORDER BY z, x, vid) - 1 AS number FROM lattice) SELECT CAST(tid AS BIGINT) AS tid, a.number AS v0, b.number AS v1, e.number AS v2 FROM tri JOIN o a ON a.vid = v0 JOIN o b ON b.vid = v1 JOIN o e ON e.vid = v2")
def ordered_vertices(spark, d):
    """Vertices numbered by (z, x), and the triangles with these numbers."""
    order = fields.ranked(X.lattice(spark, d).select("vid", "x", "z"), ["z", "x", "vid"], "number").select("vid", "number")
    rows = mesh.corners(_triangles(spark, d), order, ["number"])
    return rows.select(c("tid").cast("long").alias("tid"), *[c(f"c{i}_number").alias(f"v{i}") for i in range(3)])


@query(sql("lattice", "tri", recursive=True) + ", h AS (SELECT tid, v0, v1, v2 FROM tri JOIN lattice a ON a.vid = v0 JOIN lattice b ON b.vid = v1 JOIN lattice e ON e.vid = v2 WHERE least(a.z, b.z, e.z) >= 1.5), l AS (SELECT v0 AS a, v1 AS b FROM h UNION SELECT v1, v0 FROM h UNION SELECT v1, v2 FROM h UNION SELECT v2, v1 FROM h UNION SELECT v0, v2 FROM h UNION SELECT v2, v0 FROM h), r AS (SELECT DISTINCT a AS id, a AS g FROM l UNION SELECT l.b, r.g FROM r JOIN l ON l.a = r.id AND l.b > r.g), m AS (SELECT id, min(g) AS g FROM r GROUP BY id), t AS (SELECT tid, g FROM h JOIN m ON m.id = v0) SELECT CAST(tid AS BIGINT) AS tid FROM t WHERE g = (SELECT g FROM t GROUP BY g ORDER BY count(*) DESC, min(tid) LIMIT 1)")
def largest_triangle_cluster(spark, d):
    """The largest cluster of valid triangles that share vertices; of equal ones that with the smallest triangle."""
    rows = mesh.corners(_triangles(spark, d), X.lattice(spark, d), ["z"]).where("least(c0_z, c1_z, c2_z) >= 1.5")
    return mesh.largest_cluster(_triangles(spark, d).join(rows.select("tid"), "tid", "left_semi")).select(c("tid").cast("long").alias("tid"))


# --- graph --------------------------------------------------------------------------------------------------------


@query(sql("nodes", "edges") + " SELECT src, dst FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE edges.k = b.f - a.f AND NOT same_block")
def selected_subgraph(spark, d):
    """Cross-block edges whose k is what their nodes' angles say."""
    return graph.edge_errors(X.nodes(spark, d), X.edges(spark, d)).where("diff = 0 AND NOT same_block").select("src", "dst")


_GT = ", g AS (SELECT l_partkey AS id, max(l_linenumber) * 360.0::DOUBLE AS gt FROM lineitem WHERE l_discount > 0.08 GROUP BY 1 UNION ALL SELECT s_suppkey + 1000000, 720.0::DOUBLE FROM supplier)"


def _truth(spark, d):
    gt = table(spark, d, "lineitem").where("l_discount > 0.08").groupBy(c("l_partkey").alias("id")).agg((F.max("l_linenumber") * 360.0).alias("gt"))
    return gt.union(table(spark, d, "supplier").select((c("s_suppkey") + 1000000).alias("id"), F.lit(720.0)))


@query(sql("nodes", "edges") + _GT + " SELECT src, dst, round(certainty, 6) AS certainty, b.gt - a.gt AS k FROM edges JOIN g a ON a.id = src JOIN g b ON b.id = dst")
def ground_truth_graph(spark, d):
    """The graph of the nodes with a known angle, which becomes theirs."""
    gt = _truth(spark, d)
    e = graph.induced(X.edges(spark, d), gt)
    rows = graph.edge_errors(gt.withColumnRenamed("gt", "f"), e.withColumn("k", F.lit(0.0)))
    return rows.select("src", "dst", r6(c("certainty")).alias("certainty"), c("diff").alias("k"))


@query(sql("nodes") + _GT + " SELECT n.id, CASE WHEN g.gt IS NOT NULL AND (abs(z - 50) < 10 OR abs(z - 150) < 10) THEN gt ELSE f END AS f, coalesce(g.gt IS NOT NULL AND (abs(z - 50) < 10 OR abs(z - 150) < 10), false) AS fixed FROM nodes n LEFT JOIN g USING (id)")
def fixed_ground_truth(spark, d):
    """Nodes with a known angle near given heights get it and are fixed."""
    rows = X.nodes(spark, d).join(_truth(spark, d), "id", "left")
    fixed = c("gt").isNotNull() & ((F.abs(c("z") - 50) < 10) | (F.abs(c("z") - 150) < 10))
    return rows.select("id", F.when(fixed, c("gt")).otherwise(c("f")).alias("f"), fixed.alias("fixed"))


@query(sql("nodes", "edges") + ", s AS (SELECT id, f > 0 AS up, CASE WHEN f > 0 THEN 0.9 ELSE 0.2 END::DOUBLE AS fold FROM nodes), l AS (SELECT src, dst, same_block FROM edges UNION ALL SELECT dst, src, same_block FROM edges), m AS (SELECT src AS id, avg(CASE WHEN same_block THEN 1 - fold ELSE fold END) AS m FROM l JOIN s ON s.id = dst GROUP BY src) SELECT id, round(coalesce(greatest(0.0, least(1.0, (m - 0.5) * 1.01 + 0.5)), fold), 11) AS fold FROM s LEFT JOIN m USING (id)")
def fold_step(spark, d):
    nodes = X.nodes(spark, d).select("id", F.when(c("f") > 0, 0.9).otherwise(0.2).alias("fold"))
    return solver.fold_step(nodes, X.edges(spark, d)).select("id", F.round("fold", 11).alias("fold"))


@query(sql("nodes", "edges") + " SELECT src, dst, round(certainty, 6) AS certainty FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE abs(b.f * 3 - a.f * 3 - k) < 360 * 0.4")
def invalid_edges_removed(spark, d):
    n = X.nodes(spark, d).withColumn("f", c("f") * 3)
    return solver.without_invalid(n, X.edges(spark, d), 0.4).select("src", "dst", r6(c("certainty")).alias("certainty"))


@query(sql("nodes", "edges") + _BOTH + " SELECT n.id, CASE WHEN n.z < 20 OR count(b.src) = 0 THEN any_value(n.f) ELSE round((sum(b.certainty * (o.f - 2 * b.k)) + 0.5 * any_value(n.f)) / (sum(b.certainty) + 0.5), 9) END + 0.0 AS f FROM nodes n LEFT JOIN b ON b.src = n.id LEFT JOIN nodes o ON o.id = b.dst GROUP BY n.id, n.z")
def solver_step_fixed(spark, d):
    """A solver step with a spring constant of 2 that keeps fixed nodes."""
    n = X.nodes(spark, d).withColumn("fixed", c("z") < 20)
    return graph.jacobi(n, X.edges(spark, d), 0.5, 2.0).select("id", (F.round("f", 9) + 0.0).alias("f"))


@query(_ERR + ", b AS (SELECT src AS id, certainty AS w, abs(diff) AS e FROM e UNION ALL SELECT dst, certainty, abs(diff) FROM e), m AS (SELECT id, sum(w * e) / sum(w) AS m FROM b GROUP BY id) SELECT id, round(any_value(m), 9) AS mean, round(avg(abs(e - m)), 9) AS away FROM b JOIN m USING (id) GROUP BY id")
def node_weighted_errors(spark, d):
    """Per node the weighted mean error of its edges, and how far they are from it on the average."""
    n, edges = X.nodes(spark, d).withColumn("f", c("f") * 3), X.edges(spark, d)
    e = graph.edge_errors(n, edges).withColumn("e", F.abs("diff"))
    b = materialize(e.select(c("src").alias("id"), c("certainty").alias("w"), "e").union(e.select("dst", "certainty", "e")))
    mean = b.groupBy("id").agg((F.sum(c("w") * c("e")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return b.join(mean, "id").groupBy("id").agg(F.round(F.first("m"), 9).alias("mean"), F.round(F.avg(F.abs(c("e") - c("m"))), 9).alias("away"))


_PAIRED = sql("nodes") + ", h AS (SELECT id, f, z * 3.0::DOUBLE AS gt, CAST('0x' || substr(md5(id || ':3'), 1, 8) AS BIGINT) % 500 AS b FROM nodes), e AS (SELECT abs((x.gt - y.gt) - (x.f - y.f)) AS e FROM h x JOIN h y ON x.b = y.b AND x.id < y.id), r AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM e)"


@query(_PAIRED + " SELECT any_value(n) AS n, round(avg(e), 6) AS mean, round(min(e), 6) AS lo, round(max(e) FILTER (i = n // 4), 6) AS q1, round(max(e) FILTER (i = n // 2), 6) AS q2, round(max(e) FILTER (i = 3 * n // 4), 6) AS q3, round(max(e), 6) AS hi FROM r")
def pair_errors(spark, d):
    """Errors of the angles between random pairs of nodes: nodes meet by a hash, and quartiles are order statistics by index.

    Equal errors are counted first, so that the ordered table has one row per distinct error.
    """
    b = F.conv(F.substring(F.md5(F.concat(c("id").cast("string"), F.lit(":3")).cast("binary")), 1, 8), 16, 10).cast("long") % 500
    h = X.nodes(spark, d).select("id", "f", (c("z") * 3.0).alias("gt"), b.alias("b"))
    y = h.select("b", c("id").alias("id2"), c("f").alias("f2"), c("gt").alias("gt2"))
    e = h.join(y, "b").where("id < id2").select(F.abs((c("gt") - c("gt2")) - (c("f") - c("f2"))).alias("e"))
    per = e.groupBy("e").agg(F.count("*").alias("m"))
    run = per.withColumn("hi", F.sum("m").over(W.orderBy("e"))).withColumn("n", F.sum("m").over(W.partitionBy()))
    at = lambda i: F.max(F.when((F.floor(i) < c("hi")) & (F.floor(i) >= c("hi") - c("m")), c("e")))
    out = run.agg(F.max("n").alias("n"), (F.sum(c("e") * c("m")) / F.sum("m")).alias("mean"), F.min("e").alias("lo"), at(c("n") / 4).alias("q1"), at(c("n") / 2).alias("q2"), at(3 * c("n") / 4).alias("q3"), F.max("e").alias("top"))
    return out.select("n", *[r6(c(a)).alias(a) for a in ("mean", "lo", "q1", "q2", "q3")], r6(c("top")).alias("hi"))


@query(sql("edges") + ", b AS (SELECT src AS id, k FROM edges UNION ALL SELECT dst, -k FROM edges) SELECT id, count(*) AS degree, round(min(k), 6) + 0.0 AS lo, round(max(k), 6) + 0.0 AS hi, CAST(sum(CAST(k < 0 AS INT)) AS BIGINT) AS backward FROM b GROUP BY id")
def adjacency(spark, d):
    """Every node's edges, seen from it: an edge counts once per k, and its k changes sign at the other end."""
    b = graph.both_ways(X.edges(spark, d).select("src", "dst", "k"))
    return b.groupBy(c("src").alias("id")).agg(F.count("*").alias("degree"), r6(F.min("k")).alias("lo"), r6(F.max("k")).alias("hi"), F.count_if(c("k") < 0).alias("backward"))


@query(sql("nodes") + " SELECT id, CAST(CAST(f / 360 * 7 AS INT) - (SELECT min(CAST(f / 360 * 7 AS INT)) FROM nodes) AS BIGINT) AS k, round(f - 360 * (CAST(f / 360 * 7 AS INT) - (SELECT min(CAST(f / 360 * 7 AS INT)) FROM nodes)), 6) + 0.0 AS w FROM nodes")
def shifted_windings(spark, d):
    """Winding numbers start at 0, and angles lose their whole turns."""
    rows = X.nodes(spark, d).withColumn("k", F.round(c("f") / 360 * 7).cast("long"))
    least = rows.agg(F.min("k").alias("least"))
    return rows.join(F.broadcast(least)).select("id", (c("k") - c("least")).alias("k"), r6(c("f") - 360 * (c("k") - c("least"))).alias("w"))  # one row


_PATCH = _OVER + ", m AS (SELECT patch, degrees(atan2(avg(z) - 24, avg(x) - 25)) AS a FROM dense GROUP BY patch)"


@query(_PATCH + " SELECT p AS src, q AS dst, round(((b.a - a.a + 180) % 360 + 360) % 360 - 180, 6) + 0.0 AS k, n / least(x.size, y.size) AS certainty, false AS same_block FROM o JOIN m a ON a.patch = p JOIN m b ON b.patch = q JOIN s x ON x.patch = p JOIN s y ON y.patch = q WHERE n / least(x.size, y.size) >= 0.02 UNION ALL SELECT patch, patch + 1, round(((lead(a) OVER (ORDER BY patch) - a + 180) % 360 + 360) % 360 - 180 - 360, 6) + 0.0, 1.0, true FROM m QUALIFY lead(a) OVER (ORDER BY patch) IS NOT NULL")
def patch_edges(spark, d):
    """Edges between patches: overlapping ones by the difference of their polar angles, next windings by a turn less."""
    dense = X.dense(spark, d)
    m = materialize(dense.groupBy("patch").agg(F.degrees(F.atan2(F.avg("z") - 24, F.avg("x") - 25)).alias("a")))
    over = _overlaps(spark, d).where("share >= 0.02").select(c("p").alias("src"), c("q").alias("dst"), c("share").alias("certainty"), F.lit(False).alias("same_block"), F.lit(0).alias("turns"))
    nxt = m.select(c("patch").alias("src"), (c("patch") + 1).alias("dst"), F.lit(1.0).alias("certainty"), F.lit(True).alias("same_block"), F.lit(1).alias("turns"))
    rows = over.unionByName(nxt).join(m.toDF("src", "sa"), "src").join(m.toDF("dst", "da"), "dst")
    return rows.select("src", "dst", r6(S.wrap_half_open(c("da") - c("sa")) - 360.0 * c("turns")).alias("k"), "certainty", "same_block")


@query()
def winding_solver(spark, d):
    """The whole schedule on the graph of strong edges, whose parts are small."""
    nodes, edges = solver.solve(X.nodes(spark, d).select("id", "f"), X.edges(spark, d).where("certainty > 0.107"), solver.Schedule(iterations=2, steps=1, rounds=1))
    return nodes.select("id", r6(c("f")).alias("f"))


# --- volumes, directions, evaluation ------------------------------------------------------------------------------

_VOXEL = sql("dense") + ", v AS (SELECT x, y, z, CAST(count(*) AS DOUBLE) AS v FROM dense GROUP BY ALL), pos AS (SELECT vec_id AS pid, 25 + 10 * CAST(embedding[1] AS DOUBLE) AS px, 24 + 10 * CAST(embedding[2] AS DOUBLE) AS py, 24 + 10 * CAST(embedding[3] AS DOUBLE) AS pz FROM embeddings), k AS (SELECT pid, CAST(floor(px) + a AS BIGINT) AS x, CAST(floor(py) + b AS BIGINT) AS y, CAST(floor(pz) + e AS BIGINT) AS z, CASE a WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE b WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END * CASE e WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END AS w FROM pos, range(2) t1(a), range(2) t2(b), range(2) t3(e))"


def _positions(spark, d):
    e = lambda i: 10 * c("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(c("vec_id").alias("pid"), (25 + e(0)).alias("px"), (24 + e(1)).alias("py"), (24 + e(2)).alias("pz"))


@query(_VOXEL + " SELECT pid, round(sum(w * coalesce(v.v, 0)), 6) AS v FROM k LEFT JOIN v USING (x, y, z) GROUP BY pid")
def trilinear_sample(spark, d):
    return fields.sample(_positions(spark, d), _voxels(spark, d), "pid", ("px", "py", "pz")).select("pid", r6(c("v")).alias("v"))


@query(_VOXEL + " SELECT x, y, z, round(sum(w * (1 + pid % 3)), 6) AS v FROM k WHERE w > 0 GROUP BY ALL")
def trilinear_splat(spark, d):
    rows = _positions(spark, d).withColumn("v", (1 + c("pid") % 3).cast("double"))
    return fields.splat(rows, "v", ("px", "py", "pz")).select("x", "y", "z", r6(c("v")).alias("v"))


@query(sql("dense", "axis", "iv") + ", b AS (SELECT DISTINCT x // 10 * 10 + 5.0 AS x, y // 10 * 10 + 5.0 AS y, z // 10 * 10 + 5.0 AS z FROM dense), m AS (SELECT b.*, x - (x0 + least(1.0, greatest(0.0, (y - y0) / (y1 - y0))) * (x1 - x0)) AS dx, z - (z0 + least(1.0, greatest(0.0, (y - y0) / (y1 - y0))) * (z1 - z0)) AS dz FROM b JOIN iv ON (b.y >= y0 OR first) AND (b.y < y1 OR last)) SELECT x, y, z, round(dx / sqrt(dx * dx + dz * dz), 6) + 0.0 AS ux, round(dz / sqrt(dx * dx + dz * dz), 6) + 0.0 AS uz FROM m")
def reference_vectors(spark, d):
    """Unit vectors from the axis to the middles of blocks."""
    cell = lambda v: (F.floor(c(v) / 10) * 10 + 5.0).cast("double").alias(v)
    b = X.dense(spark, d).select(cell("x"), cell("y"), cell("z")).distinct()
    rows = spatial.axis_join(b, X.axis(spark, d), "y")
    u = S.unit(c("x") - c("ax"), c("z") - c("az"))
    return rows.select("x", "y", "z", r6(u[0]).alias("ux"), r6(u[1]).alias("uz"))


@query(sql("points") + ", t AS (SELECT i, 1 - (2.0::DOUBLE * i + 1) / 200 AS h, pi() * (3 - sqrt(5)) * i AS a FROM range(200) r(i)), k AS (SELECT i, sqrt(1 - h * h) * cos(a) AS kx, sqrt(1 - h * h) * sin(a) AS ky, h AS kz FROM t), s AS (SELECT lab, i, sum(acos(least(1.0, abs((nx * kx + ny * ky + nz * kz) / sqrt(nx * nx + ny * ny + nz * nz) / sqrt(kx * kx + ky * ky + kz * kz))))) AS cost FROM points, k GROUP BY ALL) SELECT lab, CAST(i AS BIGINT) AS number, round(cost, 4) AS cost FROM s QUALIFY row_number() OVER (PARTITION BY lab ORDER BY round(cost, 6), i) = 1")
def mean_line(spark, d):
    rows = fields.mean_line(X.points(spark, d), "lab", _axes(N))
    return rows.select("lab", c("number").cast("long").alias("number"), F.round("cost", 4).alias("cost"))


_DET = sql("points") + ", r AS (SELECT pid, CAST(lab AS BIGINT) AS pred, pid % 10 AS gt, conf FROM points), o AS (SELECT *, sum(CAST(pred = gt AS INT)) OVER w AS tp, row_number() OVER w AS n, sum(CAST(pred = gt AS INT)) OVER (PARTITION BY pred) AS total FROM r WINDOW w AS (PARTITION BY pred ORDER BY conf DESC, pid))"


@query(_DET + ", q AS (SELECT pred, tp / total AS rec, tp / n AS prec FROM o WHERE total > 0), l AS (SELECT pred, unnest(range(0, 11)) AS level FROM (SELECT DISTINCT pred FROM q)), m AS (SELECT l.pred, level, coalesce(max(prec) FILTER (rec >= level / 10.0::DOUBLE - 1e-12), 0) AS p FROM l JOIN q ON q.pred = l.pred GROUP BY ALL) SELECT pred, round(sum(p) / 11, 6) AS ap FROM m GROUP BY pred")
def eleven_point_ap(spark, d):
    rated = X.points(spark, d).select("pid", c("lab").cast("long").alias("pred"), (c("pid") % 10).alias("gt"), "conf")
    return evaluate.eleven_points(rated.withColumn("hit", c("pred") == c("gt")), "pred", "conf", "hit", "pid").select("pred", r6(c("ap")).alias("ap"))


@query(sql("points") + ", r AS (SELECT CAST(lab AS BIGINT) AS cls, count(*) AS n FROM points GROUP BY 1), g AS (SELECT pid % 10 AS cls, count(*) AS n FROM points GROUP BY 1), t AS (SELECT CAST(lab AS BIGINT) AS cls, count(*) AS n FROM points WHERE lab = pid % 10 GROUP BY 1) SELECT cls, round(coalesce(t.n, 0) / r.n, 6) AS precision, round(coalesce(t.n, 0) / g.n, 6) AS recall FROM r JOIN g USING (cls) LEFT JOIN t USING (cls)")
def precision_recall(spark, d):
    rated = X.points(spark, d).select(c("lab").cast("long").alias("pred"), (c("pid") % 10).alias("gt"))
    return evaluate.precision_recall(rated, "pred", "gt").where("n_pred > 0 AND n_gt > 0").select("cls", r6(c("precision")).alias("precision"), r6(c("recall")).alias("recall"))


@query(sql("points") + ", k AS (SELECT lab, round(avg(x), 9) AS m, round(avg(conf), 9) AS mc FROM points GROUP BY lab) SELECT lab, round(avg(CASE WHEN abs(x - m) < 10 THEN 1 ELSE 0 END), 6) AS near, round(avg(x), 6) + 0.0 AS mean, round(avg(abs(x - m)), 6) AS away, round(stddev_pop(x), 6) AS deviation FROM points JOIN k USING (lab) GROUP BY lab")
def deviation_stats(spark, d):
    """Share within a distance of the mean, mean, mean absolute and standard deviation."""
    p = X.points(spark, d).select("lab", "x")
    rows = p.join(p.groupBy("lab").agg(F.avg("x").alias("m")), "lab")
    away = F.abs(c("x") - c("m"))
    return rows.groupBy("lab").agg(r6(F.avg((away < 10).cast("int"))).alias("near"), r6(F.avg("x")).alias("mean"), r6(F.avg(away)).alias("away"), r6(F.stddev_pop("x")).alias("deviation"))


@query(sql("points") + " SELECT CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, CAST(floor(z / 10) AS BIGINT) AS cz, count(*) AS n, min(pid) AS first FROM points GROUP BY ALL")
def cube_groups(spark, d):
    return X.points(spark, d).groupBy(*[F.floor(c(a) / 10).alias(f"c{a}") for a in "xyz"]).agg(F.count("*").alias("n"), F.min("pid").alias("first"))


@query(sql("points") + ", v AS (SELECT CAST(floor(x / 4) AS BIGINT) AS vx, CAST(floor(y / 4) AS BIGINT) AS vy, CAST(floor(z / 4) AS BIGINT) AS vz, lab, conf FROM points), m AS (SELECT vx, vy, vz, lab, count(*) AS n FROM v GROUP BY ALL), a AS (SELECT vx, vy, vz, count(*) AS n, avg(conf) AS conf FROM v GROUP BY ALL) SELECT a.vx, a.vy, a.vz, a.n, round(a.conf, 6) AS conf, m.lab FROM a JOIN m ON a.vx = m.vx AND a.vy = m.vy AND a.vz = m.vz QUALIFY row_number() OVER (PARTITION BY a.vx, a.vy, a.vz ORDER BY m.n DESC, m.lab) = 1")
def voxel_collate(spark, d):
    """Voxels with their mean feature and most frequent label, ties to the smaller."""
    p = X.points(spark, d)
    per = p.groupBy(*[F.floor(c(a) / 4).alias(f"v{a}") for a in "xyz"], "lab").agg(F.count("*").alias("m"), F.sum("conf").alias("s"))
    rows = per.groupBy("vx", "vy", "vz").agg(F.sum("m").alias("n"), (F.sum("s") / F.sum("m")).alias("conf"), F.max_by("lab", F.struct("m", -c("lab"))).alias("lab"))
    return rows.select("vx", "vy", "vz", "n", r6(c("conf")).alias("conf"), "lab")


@query("WITH b AS (SELECT conv_id, CAST('0x' || substr(md5(conv_id || ':5'), 1, 8) AS BIGINT) % 5 AS fold FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT fold, role, count(*) AS n, count(DISTINCT conv_id) AS groups FROM conversations JOIN b USING (conv_id) GROUP BY ALL")
def group_folds(spark, d):
    """Folds by a hash of the group, so that no group is in two."""
    fold = F.conv(F.substring(F.md5(F.concat(c("conv_id").cast("string"), F.lit(":5")).cast("binary")), 1, 8), 16, 10).cast("long") % 5
    return table(spark, d, "conversations").groupBy(fold.alias("fold"), "role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("groups"))


@query(sql("points") + f", n AS (SELECT a.pid, {_NEAR} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {_NEAR}, b.pid) AS rank FROM points a JOIN points b ON {_NEAR} <= 20) SELECT pid, round(d, 6) AS core FROM n WHERE rank = 4")
def core_distances(spark, d):
    return neighbours.core_distances(X.points(spark, d).select("pid", "x", "y", "z"), 20.0, 4, "pid").select("pid", r6(c("core")).alias("core"))


@query()
def reachability_forest(spark, d):
    f = neighbours.reachability_forest(X.points(spark, d).select("pid", "x", "y", "z"), 12.0, 4, "pid")
    return f.agg(F.count("*").alias("n"), r6(F.sum("cost")).alias("cost"))


@query(sql("dense") + ", e AS (SELECT DISTINCT x AS src, y AS dst, patch % 3 - 1 AS k FROM dense WHERE x <> y) SELECT src, dst, CAST(k AS INT) AS k FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src AND b.k = -a.k)")
def one_way_steps(spark, d):
    """Directed steps that cannot be walked back: there is no edge the other way with k of the other sign."""
    e = X.dense(spark, d).where("x <> y").select(c("x").cast("long").alias("src"), c("y").cast("long").alias("dst"), (c("patch") % 3 - 1).cast("int").alias("k")).distinct()
    back = e.select(c("dst").alias("src"), c("src").alias("dst"), (-c("k")).alias("k"))
    return e.join(back, ["src", "dst", "k"], "left_anti")
