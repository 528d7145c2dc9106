"""Relaxation of an ordered point grid: cells (i, j, t, fixed), t <= 0, whose sheets repeat every `turn` steps of i.

A cell's neighbours on its sheet are one step away in i or j; those beside it, on the next sheets, `turn` steps in i. Both
kinds learn of each other by sending rows and aggregating by cell: no window, no pairs. Cells are unique by (i, j).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.sources.shared import materialize


def _beside(grid: DataFrame, turn: int) -> DataFrame:
    """Adds l and r, the values a turn before and after; null where there is none."""
    to = F.explode(F.array(F.struct(F.col("i"), F.lit(0).alias("w")), F.struct((F.col("i") + turn).alias("i"), F.lit(-1).alias("w")), F.struct((F.col("i") - turn).alias("i"), F.lit(1).alias("w"))))
    sent = grid.select(to.alias("to"), "j", "t", "fixed").select("to.i", "j", "to.w", "t", "fixed")
    pick = lambda w, x: F.max(F.when(F.col("w") == w, F.col(x)))
    return sent.groupBy("i", "j").agg(pick(0, "t").alias("t"), pick(0, "fixed").alias("fixed"), pick(-1, "t").alias("l"), pick(1, "t").alias("r")).where("t IS NOT NULL")


def _not_across(t: Column, d: Column, other: Column) -> Column:
    """d, or half the way to the other value if t + d is on another side of it than t."""
    return F.when(other.isNotNull() & ((t > other) != (t + d > other)), (other - t) * 0.5).otherwise(d)


def steps(grid: DataFrame, turn: int) -> DataFrame:
    """(i, j, t, fixed, d): the step that each cell, fixed ones too, wants to take; |d| is its error.

    It aims at the mean of its sheet's neighbours, and of where these see the sheets beside them; it stops half-way before a
    neighbour beside it, whose value before the sweep counts.
    """
    own = _beside(grid, turn)
    ways = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(w).alias("w")) for w, (a, b) in enumerate(((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))])
    sent = own.select(F.explode(ways).alias("to"), "t", "fixed", "l", "r").select("to.i", "to.j", "to.w", "t", "fixed", "l", "r")
    mine = lambda x: F.max(F.when(F.col("w") == 0, F.col(x)))
    mean = lambda x: F.avg(F.when(F.col("w") > 0, x))
    cells = sent.groupBy("i", "j").agg(*[mine(x).alias(x) for x in ("t", "fixed", "l", "r")], mean(F.col("t")).alias("m"), mean(F.col("r") - F.col("t")).alias("mr"), mean(F.col("l") - F.col("t")).alias("ml")).where("t IS NOT NULL")
    right, left = F.col("r") - F.col("mr"), F.col("l") - F.col("ml")
    count = 1 + right.isNotNull().cast("int") + left.isNotNull().cast("int")
    aim = F.least(F.lit(0.0), (F.coalesce("m", F.lit(0.0)) + F.coalesce(right, F.lit(0.0)) + F.coalesce(left, F.lit(0.0))) / count)
    d = _not_across(F.col("t"), aim - F.col("t"), F.col("l"))
    return cells.withColumn("d", d).select("i", "j", "t", "fixed", _not_across(F.col("t"), F.col("d"), F.col("r")).alias("d"))


def sweep(grid: DataFrame, turn: int, rate: float = 0.1) -> DataFrame:
    """(i, j, t, fixed, d): the grid after one step of all cells that are not fixed; d is 0 for fixed ones."""
    d = F.when(F.col("fixed"), 0.0).otherwise(F.col("d"))
    return steps(grid, turn).select("i", "j", (F.col("t") + rate * d).alias("t"), "fixed", d.alias("d"))


def refixed(grid: DataFrame, turn: int, unfix: float = 3.0, fix: float = 0.2) -> DataFrame:
    """The grid, where fixed cells with an error above `unfix` times the fixed ones' mean come loose, and loose ones below `fix`
    times the loose ones' mean are fixed. A mean over no cells is 0."""
    rows = materialize(steps(grid, turn).withColumn("error", F.abs("d")))
    mean = lambda flag: F.coalesce(F.avg(F.when(F.col("fixed") == flag, F.col("error"))), F.lit(0.0))
    limits = rows.agg((unfix * mean(True)).alias("__over"), (fix * mean(False)).alias("__under"))
    held = F.col("fixed") & (F.col("error") <= F.col("__over"))
    return rows.join(F.broadcast(limits)).select("i", "j", "t", (held | (F.col("error") < F.col("__under"))).alias("fixed"))


def relax(grid: DataFrame, turn: int, rounds: int = 3, sweeps: int = 10_000, least: float = 1e-3, rate: float = 0.1, unfix: float = 3.0) -> DataFrame:
    """The grid after `rounds` rounds of sweeps, each until the sum of steps changes by less than `least`, and of refixed."""
    for _ in range(rounds):
        before = None
        for _ in range(sweeps):
            rows = materialize(sweep(grid, turn, rate))
            total = rows.agg(F.sum(F.abs("d"))).first()[0] or 0.0
            grid = rows.drop("d")
            if before is not None and abs(before - total) < least:
                break
            before = total
        grid = materialize(refixed(grid, turn, unfix))
    return grid
