"""Stencils over sparse voxels (x, y, z, v): a voxel is sent to the cells that need it and summed there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smoothing and derivative weights of a Sobel filter.
SMOOTH, SLOPE = {-1: 1, 0: 2, 1: 1}, {-1: -1, 0: 0, 1: 1}


def _stencil(voxels: DataFrame, weights: list[tuple[tuple[int, int, int], list[float]]], names: list[str]) -> DataFrame:
    sent = F.explode(F.array(*[F.struct((F.col("x") - a).alias("x"), (F.col("y") - b).alias("y"), (F.col("z") - c).alias("z"), *[(F.col("v") * w).alias(n) for n, w in zip(names, ws, strict=True)]) for (a, b, c), ws in weights]))
    return voxels.select(sent.alias("s")).groupBy("s.x", "s.y", "s.z").agg(*[F.sum(f"s.{n}").alias(n) for n in names])


def box_mean(voxels: DataFrame, half: int = 1) -> DataFrame:
    """Mean over a cube with zero padding, at every cell that a voxel touches."""
    r = range(-half, half + 1)
    n = float((2 * half + 1) ** 3)
    return _stencil(voxels, [((a, b, c), [1.0 / n]) for a in r for b in r for c in r], ["mean"])


def _along(cells: DataFrame, axis: str, sums: dict[str, tuple[str, dict[int, int]]]) -> DataFrame:
    """One pass of a separable stencil: every cell is sent to its neighbours along one axis; name -> (column, weights)."""
    sent = F.explode(F.array(*[F.struct((F.col(axis) - d).alias(axis), *[(F.col(source) * float(w[d])).alias(name) for name, (source, w) in sums.items()]) for d in (-1, 0, 1)]))
    rest = [x for x in "xyz" if x != axis]
    return cells.select(*rest, sent.alias("s")).groupBy(*rest, F.col(f"s.{axis}").alias(axis)).agg(*[F.sum(f"s.{name}").alias(name) for name in sums])


def sobel(voxels: DataFrame) -> DataFrame:
    """Gradients gx, gy, gz by 3 x 3 x 3 Sobel kernels with zero padding, as three passes of three sends instead of 27 at once."""
    z = _along(voxels, "z", {"sm": ("v", SMOOTH), "sl": ("v", SLOPE)})
    y = _along(z, "y", {"gx": ("sm", SMOOTH), "gy": ("sm", SLOPE), "gz": ("sl", SMOOTH)})
    return _along(y, "x", {"gx": ("gx", SLOPE), "gy": ("gy", SMOOTH), "gz": ("gz", SMOOTH)})
