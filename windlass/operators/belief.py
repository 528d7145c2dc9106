"""Belief propagation over whole turns: each node picks a shift of -reach .. reach turns, edges price what disagrees.

A row is an undirected edge (src, dst, certainty, k) and carries the messages both ways as arrays of 2 * reach + 1 numbers, so
that parallel edges are factors of their own. A round is one aggregation by node and a join of its sums to either end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.sources.shared import materialize

#: Beliefs are compared to this many decimals; ties go to the lowest shift.
DIGITS = 9


def with_turns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with ell, the whole turns by which their ends disagree. Edges whose ends are not both nodes are left out."""
    f = nodes.select("id", "f")
    rows = edges.join(f.toDF("src", "__f1"), "src").join(f.toDF("dst", "__f2"), "dst")
    return rows.withColumn("ell", F.rint((F.col("__f1") - F.col("__f2") + F.col("k")) / 360.0 + 1e-9)).drop("__f1", "__f2")


def potentials(rows: DataFrame, reach: int, off: float | None = None) -> DataFrame:
    """(src, dst, s1, s2, potential) of rows of with_turns for all pairs of shifts.

    With `off`, deviations cost exponentially, and each end has a further state, reach + 1, that switches it off at that cost;
    a column `plain` then has what the potential is without `off`, null where an end is switched off.
    """
    states = F.sequence(F.lit(-reach), F.lit(reach if off is None else reach + 1))
    rows = rows.withColumn("s1", F.explode(states)).withColumn("s2", F.explode(states))
    away = F.abs(F.col("ell") + F.col("s1") - F.col("s2"))
    plain = -F.col("certainty") * away
    if off is None:
        return rows.select("src", "dst", "s1", "s2", plain.alias("potential"))
    out = (F.col("s1") > reach).cast("int") + (F.col("s2") > reach).cast("int")
    value = F.when(out > 0, -off * out).otherwise(-F.col("certainty") * F.exp(away))
    return rows.select("src", "dst", "s1", "s2", value.alias("potential"), F.when(out == 0, plain).alias("plain"))


def loss(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the number of edges, and their mean disagreement in turns times certainty."""
    return with_turns(nodes, edges).agg(F.count("*").alias("n"), F.avg(F.col("certainty") * F.abs("ell")).alias("loss"))


def _sums(rows: DataFrame, reach: int) -> DataFrame:
    """(id, total): the sum of the messages that a node gets, per state."""
    got = F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("to_dst").alias("m")), F.struct(F.col("src").alias("id"), F.col("to_src").alias("m"))))
    states = range(2 * reach + 1)
    sums = rows.select(got.alias("g")).groupBy("g.id").agg(*[F.sum(F.col("g.m")[i]).alias(f"s{i}") for i in states])
    return sums.select("id", F.array(*[f"s{i}" for i in states]).alias("total"))


def _sent(total: str, back: str, ell: Column, reach: int) -> Column:
    """A message as an array: for each state of the other end the best of this end's, whose other messages are total less back."""
    n = 2 * reach + 1
    given = [F.get(total, F.lit(s)) - F.get(back, F.lit(s)) for s in range(n)]
    return F.array(*[F.greatest(*[given[s] - F.col("certainty") * F.abs(ell + float(s - t)) for s in range(n)]) for t in range(n)])


def _damped(new: str, old: str, damping: float) -> Column:
    """The message with its greatest number taken off, so that numbers stay small, and mixed with the one before."""
    return F.zip_with(new, old, lambda x, was: (1.0 - damping) * (x - F.col(f"{new}_top")) + damping * was)


def decode(rows: DataFrame, reach: int, rounds: int, damping: float = 0.5) -> DataFrame:
    """(id, shift): the best shift of every node with an edge after `rounds` rounds of max-product messages from zero."""
    zero = F.array(*[F.lit(0.0)] * (2 * reach + 1))
    rows = rows.select("src", "dst", "certainty", "ell", zero.alias("to_dst"), zero.alias("to_src"))
    for _ in range(rounds):
        total = materialize(_sums(rows, reach))
        both = rows.join(total.toDF("src", "__s"), "src").join(total.toDF("dst", "__d"), "dst")
        both = both.withColumns({"__there": _sent("__s", "to_src", F.col("ell"), reach), "__back": _sent("__d", "to_dst", -F.col("ell"), reach)})
        both = both.withColumns({"__there_top": F.array_max("__there"), "__back_top": F.array_max("__back")})
        rows = materialize(both.select("src", "dst", "certainty", "ell", _damped("__there", "to_dst", damping).alias("to_dst"), _damped("__back", "to_src", damping).alias("to_src")))
    belief = _sums(rows, reach).withColumn("total", F.transform("total", lambda x: F.round(x, DIGITS)))
    return belief.select("id", (F.array_position("total", F.array_max("total")) - 1 - reach).cast("int").alias("shift"))


def shifted(nodes: DataFrame, shifts: DataFrame) -> DataFrame:
    """nodes with f moved by their shifts' turns; nodes without a shift stay."""
    return nodes.join(shifts, "id", "left").withColumn("f", F.col("f") + 360.0 * F.coalesce(F.col("shift"), F.lit(0))).drop("shift")


def solve(nodes: DataFrame, edges: DataFrame, reach: int, rounds: int, patience: int = 10, damping: float = 0.5) -> DataFrame:
    """nodes (id, f) after decoding again and again, until the greatest disagreement has not fallen for `patience` times; the f
    with the least loss are returned. Only one row a time comes to the driver."""
    best, worst, waited = None, None, 0
    while True:
        rows = materialize(with_turns(nodes, edges))
        state = rows.agg(F.avg(F.col("certainty") * F.abs("ell")).alias("loss"), F.max(F.abs("ell")).alias("worst")).first()
        if state["loss"] is None:
            return nodes
        if best is None or state["loss"] < best[0]:
            best = (state["loss"], nodes)
        waited = waited + 1 if worst is not None and state["worst"] >= worst else 0
        worst = state["worst"] if worst is None else min(worst, state["worst"])
        if state["loss"] == 0 or waited >= patience:
            return best[1]
        nodes = materialize(shifted(nodes, decode(rows, reach, rounds, damping)))
