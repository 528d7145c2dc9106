"""File formats of point clouds, meshes, axes, graphs and per-pixel maps, read through Spark's own file sources."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# PLY scalar types.
PLY_TYPES = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "i2", "ushort": "u2", "int16": "i2", "uint16": "u2", "int": "i4", "uint": "u4", "int32": "i4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(raw: bytes) -> dict[str, np.ndarray]:
    """Vertex properties of an ascii or binary PLY file; elements behind the vertices are not read."""
    head, _, body = raw.partition(b"end_header\n")
    kind, count, props, here = "", 0, [], False
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            here = w[1] == "vertex"
            count = int(w[2]) if here else count
        elif w[0] == "property" and here:
            props.append((w[2], PLY_TYPES[w[1]]))
    if kind == "ascii":
        cells = np.array(body.split()[: count * len(props)], float).reshape(count, len(props))
        return {n: cells[:, i] for i, (n, _) in enumerate(props)}
    order = "<" if kind == "binary_little_endian" else ">"
    rows = np.frombuffer(body, np.dtype([(n, order + t) for n, t in props]), count)
    return {n: rows[n] for n, _ in props}


def ply_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A binary PLY file of float64 vertex properties."""
    n = len(next(iter(columns.values()))) if columns else 0
    head = "".join(f"property double {c}\n" for c in columns)
    rows = np.empty(n, np.dtype([(c, "<f8") for c in columns]))
    for c, v in columns.items():
        rows[c] = v
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{head}end_header\n".encode() + rows.tobytes()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_ply(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z", "nx", "ny", "nz")) -> DataFrame:
    """Points of all PLY files below path, a file per task; a property that a file lacks is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                found = parse_ply(raw)
                n = len(next(iter(found.values()))) if found else 0
                yield pd.DataFrame({"path": [name] * n} | {c: found[c].astype(float) if c in found else np.full(n, np.nan) for c in columns})

    return _files(spark, path).mapInPandas(run, "path string, " + ", ".join(f"{c} double" for c in columns))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of OBJ text: line order numbers vertices from 0 per file; polygons become fans."""
    lines = _files(spark, path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "line"))
    words = lines.select("path", "at", F.split(F.trim("line"), r"\s+").alias("w"))
    v = words.where("w[0] = 'v'").select("path", "at", *[F.col("w")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    from pyspark.sql import Window as W

    v = v.withColumn("vid", F.row_number().over(W.partitionBy("path").orderBy("at")) - 1).drop("at")
    corner = F.transform(F.slice("w", 2, F.size("w") - 1), lambda t: F.split(t, "/")[0].cast("long") - 1)
    fan = F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.struct(F.col("c")[0].alias("v0"), F.get("c", i).alias("v1"), F.get("c", i + 1).alias("v2"))))
    t = words.where("w[0] = 'f' AND size(w) > 3").select("path", corner.alias("c")).select("path", fan.alias("t")).select("path", "t.*")
    return v, t


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """Control points from text lines `x, y, z`."""
    cells = F.split("value", ",")
    return spark.read.text(path).where("value LIKE '%,%'").select(*[F.trim(cells[i]).cast("double").alias(c) for i, c in enumerate("xyz")])


def parse_graph(raw: bytes) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Nodes and directed edges of a binary winding graph: u32 count; per node f32 z, f32 f, bool gt, f32 gt_f; then per
    node u32 id, u32 degree and per edge u32 target, f32 certainty, f32 k, bool same_block."""
    (n,) = struct.unpack_from("<I", raw)
    node = np.dtype([("z", "<f4"), ("f", "<f4"), ("gt", "?"), ("gt_f", "<f4")])
    rows, at = np.frombuffer(raw, node, n, 4), 4 + n * node.itemsize
    edge = np.dtype([("dst", "<u4"), ("certainty", "<f4"), ("k", "<f4"), ("same_block", "?")])
    parts = []
    for _ in range(n):
        i, degree = struct.unpack_from("<II", raw, at)
        parts.append((i, np.frombuffer(raw, edge, degree, at + 8)))
        at += 8 + degree * edge.itemsize
    nodes = pd.DataFrame({"id": np.arange(n), "z": rows["z"].astype(float), "f": rows["f"].astype(float), "gt": rows["gt"], "gt_f": rows["gt_f"].astype(float)})
    src = np.concatenate([np.full(len(e), i) for i, e in parts]) if parts else np.empty(0, int)
    every = np.concatenate([e for _, e in parts]) if parts else np.empty(0, edge)
    edges = pd.DataFrame({"src": src.astype("int64"), "dst": every["dst"].astype("int64"), "certainty": every["certainty"].astype(float), "k": every["k"].astype(float), "same_block": every["same_block"]})
    return nodes, edges


def graph_bytes(nodes: pd.DataFrame, edges: pd.DataFrame) -> bytes:
    """The binary form of nodes numbered 0.. and undirected edges: every edge stands at both ends, with k and -k."""
    node = np.empty(len(nodes), np.dtype([("z", "<f4"), ("f", "<f4"), ("gt", "?"), ("gt_f", "<f4")]))
    for c in node.dtype.names:
        node[c] = nodes.sort_values("id")[c]
    back = edges.rename(columns={"src": "dst", "dst": "src"}).assign(k=-edges["k"])
    groups = dict(iter(pd.concat([edges, back]).groupby("src")))
    out = [struct.pack("<I", len(nodes)), node.tobytes()]
    for i in range(len(nodes)):
        g = groups.get(i)
        row = np.empty(0 if g is None else len(g), np.dtype([("dst", "<u4"), ("certainty", "<f4"), ("k", "<f4"), ("same_block", "?")]))
        for c in row.dtype.names if g is not None else ():
            row[c] = g[c]
        out += [struct.pack("<II", i, len(row)), row.tobytes()]
    return b"".join(out)


def parse_ppm(raw: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and (height, width, 6) values of a per-pixel map: `key: value` lines up to `<>`, then little-endian f64."""
    head, _, body = raw.partition(b"<>\n")
    keys = dict(line.split(": ", 1) for line in head.decode().splitlines() if ": " in line)
    return keys, np.frombuffer(body, "<f8").reshape(int(keys["height"]), int(keys["width"]), 6)


def read_ppm(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """(path, imx, imy, x, y, z, nx, ny, nz) of every step-th pixel that holds a point."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                _, v = parse_ppm(raw)
                v = v[::step, ::step]
                y, x = np.nonzero(np.trunc(v[:, :, 0]) != 0)
                yield pd.DataFrame({"path": name, "imx": x * step, "imy": y * step} | {c: v[y, x, i] for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))})

    return _files(spark, path).mapInPandas(run, "path string, imx long, imy long, x double, y double, z double, nx double, ny double, nz double")
