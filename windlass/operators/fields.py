"""Vector fields, blocks and rotations: orientation, block neighbourhoods, sampling and splatting of voxels, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windlass.functions.scalars import cross, dot, norm, undirected_angle, unit
from windlass.sources.shared import materialize


def one_turn_degrees(radians: Column) -> Column:
    """A difference of two angles in (-2 pi, 2 pi) brought to [-pi, pi], in degrees."""
    return F.degrees(F.when(radians > math.pi, radians - 2 * math.pi).when(radians < -math.pi, radians + 2 * math.pi).otherwise(radians))


def alignment(v: list[Column]) -> list[list[Column]]:
    """The rows of the matrix that takes v to (0, 0, -1) when a point multiplies it from the left; the unit matrix for +-z."""
    vx, vy, vz = unit(*v)
    flat = F.sqrt(vx * vx + vy * vy)
    kx, ky = (F.coalesce(a / F.nullif(flat, F.lit(0.0)), F.lit(0.0)) for a in (vy, -vx))
    s, rest = F.sin(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -vz)))), F.lit(1.0) + vz
    return [
        [1.0 - rest * ky * ky, rest * kx * ky, s * ky],
        [rest * kx * ky, 1.0 - rest * kx * kx, -s * kx],
        [-s * ky, s * kx, 1.0 - rest * (kx * kx + ky * ky)],
    ]


def times(p: list[Column], rows: list[list[Column]]) -> list[Column]:
    """The row vector p times a matrix."""
    return [sum((p[i] * rows[i][j] for i in (1, 2)), p[0] * rows[0][j]) for j in range(3)]


def turned(v: list[Column], axis: list[Column], radians: Column) -> list[Column]:
    """v turned about a unit axis."""
    c, s, along, side = F.cos(radians), F.sin(radians), dot(axis, v), cross(axis, v)
    return [c * v[i] + s * side[i] + (1.0 - c) * along * axis[i] for i in range(3)]


def affine(p: list[Column], matrix: list[list[float]]) -> list[Column]:
    """The first three rows of a 4 x 4 transform applied to p."""
    return [F.lit(r[0]) * p[0] + F.lit(r[1]) * p[1] + F.lit(r[2]) * p[2] + F.lit(r[3]) for r in matrix[:3]]


def scaled_to_one(rows: DataFrame, columns: list[str], most: float = 1000.0) -> DataFrame:
    """Columns kept within +-most and divided by their common greatest magnitude, 1e-8 at least. One row is broadcast."""
    kept = {c: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c))) for c in columns}
    top = rows.agg(F.greatest(F.lit(1e-8), *[F.max(F.abs(x)) for x in kept.values()]).alias("__top"))
    return rows.join(F.broadcast(top)).withColumns({c: x / F.col("__top") for c, x in kept.items()}).drop("__top")


def scaled_to_range(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every column brought to [0, 1] by its own least and greatest value; 0 where these are equal. One row is broadcast."""
    ends = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0.0)), F.lit(0.0))
    return rows.join(F.broadcast(ends)).withColumns({c: part(c) for c in columns}).select(*rows.columns)


def facing(v: list[Column], reference: list[Column]) -> list[Column]:
    """v, turned round where it points away from the reference."""
    away = dot(v, reference) < 0
    return [F.when(away, -x).otherwise(x) for x in v]


def forward_blocks(blocks: DataFrame, names: tuple[str, str, str], size: int = 50) -> DataFrame:
    """Every block with its three neighbours half a block ahead: (names, nx, ny, nz)."""
    half = size // 2
    ahead = [F.struct(*[(F.col(n) + (half if i == k else 0)).alias(f"n{a}") for i, (n, a) in enumerate(zip(names, "xyz", strict=True))]) for k in range(3)]
    return blocks.select(*names, F.explode(F.array(*ahead)).alias("n")).select(*names, "n.nx", "n.ny", "n.nz")


def cells_around(points: DataFrame, size: int = 50, reach: int = 1) -> DataFrame:
    """Every point once for each of the (2 * reach + 1)**3 half-block cells about its own, as cx, cy, cz."""
    half = size // 2
    steps = F.array(*[F.lit(d * half) for d in range(-reach, reach + 1)])
    own = lambda c: lambda d: F.floor(F.col(c) / half) * half + d
    for c in "xyz":
        points = points.withColumn(f"c{c}", F.explode(F.transform(steps, own(c))))
    return points


def neighbour_counts(blocks: DataFrame, names: tuple[str, str, str], size: int, reach: int) -> DataFrame:
    """For every block the number of given blocks within `reach` steps of `size` in each axis, itself included."""
    steps = F.array(*[F.lit(d * size) for d in range(-reach, reach + 1)])
    sent = blocks.select(*names).distinct()
    own = sent.withColumn("own", F.lit(1))
    moved = lambda n: lambda d: F.col(n) + d
    for n in names:
        sent = sent.withColumn(n, F.explode(F.transform(steps, moved(n))))
    counts = sent.groupBy(*names).agg(F.count("*").alias("n"))
    return own.join(counts, list(names)).drop("own")


def _corners(coords: tuple[str, str, str]) -> Column:
    """The eight voxels about a position, each with its trilinear weight."""
    base = [F.floor(F.col(c)) for c in coords]
    part = [F.col(c) - b for c, b in zip(coords, base, strict=True)]
    out = []
    for k in range(8):
        bits = [(k >> a) & 1 for a in range(3)]
        weight = F.lit(1.0)
        for p, b in zip(part, bits, strict=True):
            weight = weight * (p if b else 1.0 - p)
        out.append(F.struct(*[(x + b).alias(n) for x, b, n in zip(base, bits, "xyz", strict=True)], weight.alias("w")))
    return F.explode(F.array(*out))


def sample(positions: DataFrame, voxels: DataFrame, key: str, coords: tuple[str, str, str]) -> DataFrame:
    """(key, v): trilinear value at fractional positions; voxels that are not there count as 0. Eight equi-joins in one."""
    asked = positions.select(key, _corners(coords).alias("c")).where("c.w > 0").select(key, "c.x", "c.y", "c.z", "c.w")
    return asked.join(voxels.select("x", "y", "z", "v"), ["x", "y", "z"], "left").groupBy(key).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))


def splat(positions: DataFrame, value: str, coords: tuple[str, str, str]) -> DataFrame:
    """(x, y, z, v): every value dealt to the eight voxels about its position, by the weights that sample() reads with."""
    sent = positions.select(F.col(value).alias("__v"), _corners(coords).alias("c")).where("c.w > 0")
    return sent.groupBy("c.x", "c.y", "c.z").agg(F.sum(F.col("__v") * F.col("c.w")).alias("v"))


def mean_line(rows: DataFrame, part: str, v: list[Column], candidates: int = 200) -> DataFrame:
    """(part, number, cost): of evenly spread unit vectors that with the least sum of undirected angles; ties to the first.

    The candidates stand on a spiral over the sphere and are the same in every run; a row meets them beside itself.
    """
    t = lambda i: F.lit(1.0) - (2.0 * i + 1.0) / candidates
    turn = math.pi * (3.0 - math.sqrt(5.0))
    line = lambda i: [F.sqrt(1.0 - t(i) * t(i)) * F.cos(turn * i), F.sqrt(1.0 - t(i) * t(i)) * F.sin(turn * i), t(i)]
    costs = rows.select(part, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(candidates - 1)), lambda i: undirected_angle(v, line(i)))).alias("number", "angle"))
    sums = costs.groupBy(part, "number").agg(F.sum("angle").alias("cost"))
    return sums.groupBy(part).agg(F.min_by(F.struct("number", "cost"), F.struct(F.round("cost", 6), F.col("number"))).alias("b")).select(part, "b.number", "b.cost")


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the position of every row in the given order, from 0, without putting all rows into one task.

    The engine sorts by ranges; a row's number in its range is added to the number of rows in the ranges before it, of which
    there are as many as tasks.
    """
    placed = materialize(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per task
    starts = sizes.select("__part", "__first", before.alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__id") - F.col("__first") + F.col("__before")).drop("__id", "__part", "__first", "__before")


def drawn(rows: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """`count` rows, drawn without replacement by the MD5 of "key:seed"; reruns draw the same."""
    return rows.withColumn("__d", F.md5(F.concat_ws(":", key, F.lit(seed)).cast("binary"))).orderBy("__d", key).limit(count).drop("__d")


def sides(a: list[Column], b: list[Column], c: list[Column]) -> list[Column]:
    """The three side lengths of a triangle."""
    return [norm(*[y - x for x, y in zip(p, q, strict=True)]) for p, q in ((a, b), (b, c), (c, a))]
