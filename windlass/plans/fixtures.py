"""Logical inputs derived from the driver's tables, in Spark and in the SQL of the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.functions.scalars import wrap_half_open
from windlass.sources.shared import table


def points(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pid"), *[(100.0 * e(i)).alias(n) for i, n in enumerate("xyz")], *[e(i + 3).alias(n) for i, n in enumerate(("nx", "ny", "nz"))], F.abs(e(6)).alias("conf"), F.col("label").alias("lab")
    )


def dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), F.col("l_quantity").cast("int").alias("x"), (F.col("l_partkey") % 50).alias("y"), (F.col("l_suppkey") % 50).alias("z"),
        (360.0 * F.col("l_linenumber") + F.col("l_partkey") % 360).alias("w"), F.col("l_linenumber").alias("patch"), F.col("l_discount").alias("disc"), (F.col("l_quantity") + F.col("l_discount")).alias("q"),
    )


def _f(i):
    return ((i * 37) % 360 - 180).cast("double")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id")).union(table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id")))
    return ids.select("id", (F.col("id") % 200).alias("z"), _f(F.col("id")).alias("f"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg((0.01 + F.avg("l_discount")).alias("certainty"), (F.count("*") > 1).alias("same_block"))
    return pairs.withColumn("k", wrap_half_open(_f(F.col("dst")) - _f(F.col("src"))))


def axis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("y")).agg((F.avg("p_retailprice") / 100).alias("x"), F.count("*").cast("double").alias("z"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, t): users by hours; t is null where a user has no event in an hour."""
    e = table(spark, d, "events").select(F.col("user_id").alias("i"), (F.unix_timestamp("ts") / 3600).cast("long").alias("j"), "value")
    filled = e.groupBy("i", "j").agg((-F.avg("value")).alias("t"))
    span = filled.groupBy("i").agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
    every = span.select("i", F.explode(F.sequence("lo", "hi")).alias("j"))
    return every.join(filled, ["i", "j"], "left")


#: Vertices in a row of the lattice.
LATTICE = 64


def lattice(spark: SparkSession, d: str) -> DataFrame:
    """A vertex for every user and day with an event (days by number, 64 at most); its height is their number of events."""
    day = (F.floor(F.unix_timestamp("ts") / 86400) % LATTICE).cast("long")
    cells = table(spark, d, "events").groupBy(F.col("user_id").alias("i"), day.alias("j")).agg(F.count("*").alias("n"))
    return cells.select((F.col("i") * LATTICE + F.col("j")).alias("vid"), "i", "j", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.col("n") / 2.0).alias("z"), (F.col("i") / 20.0).alias("u"), (F.col("j") / 20.0).alias("v"))


SQL = {
    "points": "points AS (SELECT vec_id AS pid, 100.0::DOUBLE * CAST(embedding[1] AS DOUBLE) AS x, 100.0::DOUBLE * CAST(embedding[2] AS DOUBLE) AS y, 100.0::DOUBLE * CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz, abs(CAST(embedding[7] AS DOUBLE)) AS conf, label AS lab FROM embeddings)",
    "dense": "dense AS (SELECT l_orderkey * 10 + l_linenumber AS pid, CAST(trunc(l_quantity) AS INT) AS x, l_partkey % 50 AS y, l_suppkey % 50 AS z, 360.0::DOUBLE * l_linenumber + l_partkey % 360 AS w, l_linenumber AS patch, l_discount AS disc, l_quantity + l_discount AS q FROM lineitem)",
    "nodes": "nodes AS (SELECT id, id % 200 AS z, CAST((id * 37) % 360 - 180 AS DOUBLE) AS f FROM (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + 1000000 FROM supplier))",
    "edges": "edges AS (SELECT src, dst, certainty, same_block, ((((dst * 37) % 360 - (src * 37) % 360 + 180) % 360 + 360) % 360 - 180)::DOUBLE AS k FROM (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, 0.01::DOUBLE + avg(l_discount) AS certainty, count(*) > 1 AS same_block FROM lineitem GROUP BY ALL))",
    "axis": "axis AS (SELECT CAST(p_size AS DOUBLE) AS y, avg(p_retailprice) / 100 AS x, CAST(count(*) AS DOUBLE) AS z FROM part GROUP BY p_size)",
    "iv": "iv AS (SELECT y AS y0, x AS x0, z AS z0, lead(y) OVER w AS y1, lead(x) OVER w AS x1, lead(z) OVER w AS z1, row_number() OVER w = 1 AS first, row_number() OVER w = count(*) OVER () - 1 AS last FROM axis WINDOW w AS (ORDER BY y) QUALIFY lead(y) OVER w IS NOT NULL)",
    "grid": "filled AS (SELECT user_id AS i, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS j, -avg(value) AS t FROM events GROUP BY ALL), grid AS (SELECT s.i, s.j, f.t FROM (SELECT i, unnest(range(min(j), max(j) + 1)) AS j FROM filled GROUP BY i) s LEFT JOIN filled f USING (i, j))",
    "lattice": "lattice AS (SELECT i * 64 + j AS vid, i, j, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, n / 2.0::DOUBLE AS z, i / 20.0::DOUBLE AS u, j / 20.0::DOUBLE AS v FROM (SELECT user_id AS i, CAST(floor(epoch(ts) / 86400) AS BIGINT) % 64 AS j, count(*) AS n FROM events GROUP BY ALL))",
    "tri": "tri AS (SELECT a.vid * 2 + h AS tid, CASE h WHEN 0 THEN a.vid ELSE b.vid END AS v0, CASE h WHEN 0 THEN b.vid ELSE e.vid END AS v1, c.vid AS v2 FROM lattice a JOIN lattice b ON b.i = a.i + 1 AND b.j = a.j JOIN lattice c ON c.i = a.i AND c.j = a.j + 1 JOIN lattice e ON e.i = a.i + 1 AND e.j = a.j + 1, range(2) t(h))",
}


def sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
