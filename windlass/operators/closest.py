"""Points and rays against triangles, and triangles against each other: joins by cells, exact tests as built-in expressions.

Triangles come as mesh.corners gives them: (tid, c0_x, c0_y, c0_z, c1_x, ...). A triangle is sent to the cells that its box
touches, so cells should be about as wide as triangles are; a point is in one cell. Both sides are shuffled, and the engine's
skew join splits crowded cells. The best partner of a row is an aggregation with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalars import cross, dot, norm
from windlass.sources.shared import materialize, small

from . import spatial

#: Distances are compared to this many decimals; what is equal then is a tie.
DIGITS = 9


def _minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _corner(i: int, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}c{i}_{a}") for a in "xyz"]


def _low(a: str, prefix: str = "") -> Column:
    return F.least(*[F.col(f"{prefix}c{i}_{a}") for i in range(3)])


def _high(a: str, prefix: str = "") -> Column:
    return F.greatest(*[F.col(f"{prefix}c{i}_{a}") for i in range(3)])


def _in_cells(corners: DataFrame, margin: float, cell: float) -> DataFrame:
    for a in "xyz":
        corners = corners.withColumn(f"__{a}", F.explode(F.sequence(F.floor((_low(a) - margin) / cell), F.floor((_high(a) + margin) / cell))))
    return corners


def triangle_distance(p: list[Column], prefix: str = "") -> Column:
    """Distance from p to a triangle of with_sides: to its plane where the foot is inside, else to the nearest side. Triangles
    without area are their sides."""
    far = []
    inside = F.col(f"{prefix}size") > 0
    for i in range(3):
        along, out = ([F.col(f"{prefix}{n}{i}_{a}") for a in "xyz"] for n in ("along", "out"))
        off = _minus(p, _corner(i, prefix))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(off, along) * F.col(f"{prefix}per{i}")))
        far.append(dot(off, off) - 2.0 * t * dot(off, along) + t * t * dot(along, along))
        inside = inside & (dot(off, out) >= 0)
    plane = dot(_minus(p, _corner(0, prefix)), [F.col(f"{prefix}normal_{a}") for a in "xyz"])
    return F.when(inside, F.abs(plane)).otherwise(F.sqrt(F.greatest(F.least(*far), F.lit(0.0))))


def with_sides(corners: DataFrame) -> DataFrame:
    """corners with what triangle_distance needs: its size and unit normal; each side's vector, inward direction and the inverse of
    its squared length, 0 for a side that is a point."""
    side = {i: _minus(_corner((i + 1) % 3), _corner(i)) for i in range(3)}
    n = cross(side[0], side[1])
    rows = corners.withColumns({"size": norm(*n)} | {f"along{i}_{a}": v for i in side for a, v in zip("xyz", side[i], strict=True)})
    n = [v / F.nullif(F.col("size"), F.lit(0.0)) for v in n]
    rows = rows.withColumns({f"normal_{a}": F.coalesce(v, F.lit(0.0)) for a, v in zip("xyz", n, strict=True)})
    made = {}
    for i in range(3):
        along = [F.col(f"along{i}_{a}") for a in "xyz"]
        made[f"per{i}"] = F.coalesce(1.0 / F.nullif(dot(along, along), F.lit(0.0)), F.lit(0.0))
        made |= {f"out{i}_{a}": v for a, v in zip("xyz", cross([F.col(f"normal_{a}") for a in "xyz"], along), strict=True)}
    return rows.withColumns(made)


def closest_triangles(points: DataFrame, corners: DataFrame, radius: float, cell: float, key: str) -> DataFrame:
    """(key, tid, d): the triangle nearest to each point that has one within radius; ties to the smaller tid.

    Points without a triangle within radius, or with a null coordinate, are left out. Repeated keys are one point with the
    nearest of their triangles.
    """
    p = points.select(key, *[F.col(a).alias(f"p_{a}") for a in "xyz"], *[F.floor(F.col(a) / cell).alias(f"__{a}") for a in "xyz"])
    at = [F.col(f"p_{a}") for a in "xyz"]
    near = [F.col(f"p_{a}").between(_low(a) - radius, _high(a) + radius) for a in "xyz"]
    pairs = p.join(_in_cells(with_sides(corners), radius, cell), [f"__{a}" for a in "xyz"]).where(near[0] & near[1] & near[2])
    pairs = pairs.select(key, "tid", F.round(triangle_distance(at), DIGITS).alias("d"))
    best = pairs.groupBy(key).agg(F.min(F.struct("d", "tid")).alias("best")).select(key, "best.tid", "best.d")
    return best.where(F.col("d") <= radius)


def share_near(points: DataFrame, closest: DataFrame, part: str, key: str) -> DataFrame:
    """(part, n, share): points of each part, and the share of them that closest_triangles found a triangle for."""
    hits = closest.select(key, F.lit(1).alias("__hit"))
    return points.select(part, key).join(hits, key, "left").groupBy(part).agg(F.count("*").alias("n"), (F.count("__hit") / F.count("*")).alias("share"))


def nearest_in_band(a: DataFrame, b: DataFrame, radius: float, key: str, column: str, width: float) -> DataFrame:
    """(a's key, b's key as nearest, d): the row of b nearest within radius to each of a, of those with |a - b| < width in
    column; ties to the smaller key."""
    pairs = spatial.radius_join(a, b, radius).where(F.abs(F.col(f"a_{column}") - F.col(f"b_{column}")) < width)
    best = pairs.groupBy(F.col(f"a_{key}").alias(key)).agg(F.min(F.struct(F.round("d", DIGITS).alias("d"), F.col(f"b_{key}").alias("nearest"))).alias("best"))
    return best.select(key, "best.nearest", "best.d")


def ray_hits(rays: DataFrame, corners: DataFrame, reach: float, cell: float, key: str, band: float) -> DataFrame:
    """(key, tid, d, way): the nearest triangle that the line through each ray's start hits within reach, either way.

    rays: (key, x, y, z, dx, dy, dz, w) with unit directions; corners also carry c0_w. A hit counts if |w - c0_w| < band. way is
    1 along the direction and -1 against it; a tie goes along it, then to the smaller tid. The line is cut into pieces as long
    as a cell, each of which is in eight cells at most. Rays without a hit are left out. Equal rays are followed once.
    """
    shape = ["x", "y", "z", "dx", "dy", "dz", "w"]
    one = materialize(rays.select(*shape).distinct().withColumn("__ray", F.monotonically_increasing_id()))
    # Triangles beyond the reach of all rays, or outside their band, are left out before they are dealt to cells.
    ends = one.agg(*[f(v).alias(f"{n}_{v}") for v in "xyzw" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for a in "xyz":
        corners = corners.where((_high(a) >= F.lit(ends[f"lo_{a}"]) - (reach + cell)) & (_low(a) <= F.lit(ends[f"hi_{a}"]) + (reach + cell)))
    corners = corners.where((F.col("c0_w") > F.lit(ends["lo_w"]) - band) & (F.col("c0_w") < F.lit(ends["hi_w"]) + band))
    pieces = -int(-2 * reach // cell)

    def cells(piece: Column) -> Column:
        span = {}
        for a in "xyz":
            ends = [F.col(f"p_{a}") + (F.lit(-reach) + s * cell) * F.col(f"d{a}") for s in (piece, piece + 1)]
            span[a] = F.sequence(F.floor(F.least(*ends) / cell), F.floor(F.greatest(*ends) / cell))
        return F.flatten(F.transform(span["x"], lambda x: F.flatten(F.transform(span["y"], lambda y: F.transform(span["z"], lambda z: F.struct(x.alias("__x"), y.alias("__y"), z.alias("__z")))))))

    p = one.select("__ray", "w", *[F.col(a).alias(f"p_{a}") for a in "xyz"], "dx", "dy", "dz")
    p = p.withColumn("__c", F.explode(F.array_distinct(F.flatten(F.array(*[cells(F.lit(i)) for i in range(pieces)]))))).select("*", "__c.*").drop("__c")
    pairs = p.join(_in_cells(corners, 1e-6, cell), [f"__{a}" for a in "xyz"]).where(F.abs(F.col("w") - F.col("c0_w")) < band)
    d = [F.col(f"d{a}") for a in "xyz"]
    first, second, off = _minus(_corner(1), _corner(0)), _minus(_corner(2), _corner(0)), _minus([F.col(f"p_{a}") for a in "xyz"], _corner(0))
    h, q = cross(d, second), cross(off, first)
    det = dot(first, h)
    pairs = pairs.withColumns({"__det": F.when(F.abs(det) > 1e-12, det), "__u": dot(off, h), "__v": dot(d, q), "__t": dot(second, q)})
    pairs = pairs.withColumns({"__u": F.col("__u") / F.col("__det"), "__v": F.col("__v") / F.col("__det"), "__t": F.round(F.col("__t") / F.col("__det"), DIGITS)})
    pairs = pairs.where("__u >= -1e-9 AND __v >= -1e-9 AND __u + __v <= 1 + 1e-9").where(F.abs("__t") <= reach)
    hits = materialize(pairs.groupBy("__ray").agg(F.min(F.struct(F.abs("__t").alias("d"), (F.col("__t") < 0).alias("back"), "tid")).alias("best")))
    best = rays.join(small(one.join(hits, "__ray").select(*shape, "best")), shape).groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, "best.tid", "best.d", F.when(F.col("best.back"), -1).otherwise(1).alias("way"))


def _apart(axis: list[Column], a: list[list[Column]], b: list[list[Column]]) -> Column:
    """Whether the axis, unless it is nearly zero, separates two triangles."""
    one, two = [dot(v, axis) for v in a], [dot(v, axis) for v in b]
    return (dot(axis, axis) >= 1e-6) & ((F.greatest(*one) < F.least(*two)) | (F.greatest(*two) < F.least(*one)))


def triangles_meet(a: list[list[Column]], b: list[list[Column]]) -> Column:
    """Whether two triangles touch: none of their normals and of the cross products of their sides separates them.

    No such axis separates triangles in one plane: these count as touching, so callers bound how far apart they may be.
    """
    sides = lambda t: [_minus(t[(i + 1) % 3], t[i]) for i in range(3)]
    ea, eb = sides(a), sides(b)
    axes = [cross(ea[0], ea[1]), cross(eb[0], eb[1]), *[cross(x, y) for x in ea for y in eb]]
    return ~F.exists(F.array(*[F.array(*axis) for axis in axes]), lambda x: _apart([x[0], x[1], x[2]], a, b))


def crossing_triangles(corners: DataFrame, radius: float, least: float) -> DataFrame:
    """(tid): triangles that meet another one whose middle is within radius and whose w differs by `least` or more."""
    middle = corners.withColumns({a: sum((F.col(f"c{i}_{a}") for i in (1, 2)), F.col(f"c0_{a}")) / 3.0 for a in "xyz"})
    pairs = spatial.radius_join(middle, middle, radius).where("a_tid < b_tid").where(F.abs(F.col("a_w") - F.col("b_w")) >= least)
    met = pairs.where(triangles_meet([_corner(i, "a_") for i in range(3)], [_corner(i, "b_") for i in range(3)]))
    return met.select(F.explode(F.array("a_tid", "b_tid")).alias("tid")).distinct()
