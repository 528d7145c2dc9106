"""Column expressions for angles, vectors and coordinates. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Rounded for comparison between engines; never a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def wrap_half_open(a: Column) -> Column:
    """Degrees to [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def wrap_closed(a: Column) -> Column:
    """Degrees to [-180, 180], where both ends stay as they are."""
    return F.when((a >= -180.0) & (a <= 180.0), a).otherwise(wrap_half_open(a))


def module_angle(a: Column) -> Column:
    w = wrap_half_open(a)
    return F.when(F.abs(w) < 1e-9, 0.0).otherwise(w)


def norm(*v: Column) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def unit(*v: Column) -> list[Column]:
    """Unit vector; null for a zero vector."""
    n = F.nullif(norm(*v), F.lit(0.0))
    return [x / n for x in v]


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def undirected_angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two lines in radians, 0 to pi / 2."""
    return F.acos(F.least(F.lit(1.0), F.abs(dot(unit(*a), unit(*b)))))


def directed_angle(a: list[Column], b: list[Column]) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit(*a), unit(*b)))))


def signed_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """atan2(b) - atan2(a) in radians, not wrapped."""
    return F.atan2(by, bx) - F.atan2(ay, ax)


def residue_offset(a: Column, offset: Column) -> Column:
    """Adds offset to what is left of a beyond its whole turns, wraps that once and keeps the turns."""
    turns = (a / 360.0).cast("int") * 360
    rest = a - turns + offset
    return turns + F.when(rest > 180.0, rest - 360.0).when(rest < -180.0, rest + 360.0).otherwise(rest)


def winding_steps(f1: Column, f2: Column, k: Column) -> Column:
    """Whole turns between two nodes, ties to even."""
    return F.rint((f1 - f2 + k) / 360.0 + 1e-9)


def closest_winding(f_init: Column, target: Column) -> Column:
    """f_init plus the whole turns that bring it nearest to target, ties away from zero."""
    return f_init + 360.0 * F.round((target - f_init) / 360.0)


def certainty_factor(error: Column) -> Column:
    return F.greatest(F.lit(0.4), F.exp(error * (-F.log(F.lit(2.5)) / 360.0)))


def overlap_score(share: Column, n: Column, threshold: float, least: float = 20.0, most: float = 500.0, sample: float = 1.0) -> Column:
    """Squared share beyond the threshold, growing slowly with the points behind it; -1 below the threshold or `least` points.

    n points were found in a sample of all; their number counts from `least` to `most`, in multiples of `least`.
    """
    points = n.cast("double") / sample
    gained = F.pow((share - threshold) / (1.0 - threshold), F.lit(2.0))
    times = F.greatest(F.lit(1.0), F.least(points, F.lit(most)) / least)
    return F.when((share >= threshold) & (points >= least), gained * (F.log(F.log(times) + 1.0) + 1.0)).otherwise(-1.0)


def tent(x: Column, centre: Column, half: float) -> Column:
    """Weight that falls from the middle of a block to its border, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.01 + half - F.abs(x - centre)) / half))


def polynomial(x: Column, y: Column, coefficients: list[float], degree: int) -> Column:
    """Sum of c * x**i * y**j over i + j <= degree, i outside, j inside."""
    terms = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]
    power = lambda v, n: F.lit(1.0) if n == 0 else F.pow(v, F.lit(float(n)))
    return sum((F.lit(c) * power(x, i) * power(y, j) for c, (i, j) in zip(coefficients, terms, strict=True)), F.lit(0.0))


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    ab, ac = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    return 0.5 * norm(*cross(ab, ac))


def rotate_about_y(x: Column, y: Column, z: Column, radians: Column) -> list[Column]:
    c, s = F.cos(radians), F.sin(radians)
    return [c * x + s * z, y, c * z - s * x]


def rotate_about_z(x: Column, y: Column, z: Column, radians: Column) -> list[Column]:
    c, s = F.cos(radians), F.sin(radians)
    return [c * x - s * y, s * x + c * y, z]


def beside(x: Column, z: Column, a: Column, b: Column) -> Column:
    """Signed distance of (x, z) from the line through the origin along the unit direction (a, b)."""
    return b * x - a * z


def angle_steps(step: float) -> int:
    """Whole steps in a turn, rounded up to a multiple of four."""
    n = int(360.0 / step)
    return n + -n % 4


def turn_index(w: Column, first: Column, angle: Column) -> Column:
    """The turn that the winding angle w is in, seen from `angle`, the first at `first`; never below 0."""
    return F.greatest(F.lit(0), ((w - first - angle + 180.0) / 360.0).cast("int"))


def inverse_transform(matrix: list[list[float]]) -> list[list[float]]:
    """The inverse of a 4 x 4 transform."""
    return np.linalg.inv(np.array(matrix, float)).tolist()


def combined_transform(first: list[list[float]], second: list[list[float]]) -> list[list[float]]:
    """The transform that applies `first` and then `second`."""
    return (np.array(second, float) @ np.array(first, float)).tolist()
