"""Stores of patches, graphs, meshes and volumes: archives of point files, binary graphs as tables, sinks, chunked arrays.

Readers go through Spark's binary file source, a file per task; sinks write a file per group from the executors, under a
temporary name first, so that a repeated task replaces its own file.
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

POINT = ("x", "y", "z", "nx", "ny", "nz")


def put(folder: str, name: str, raw: bytes) -> str:
    """Writes a file of the folder in one step, as a move of a finished one."""
    where, path = pafs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    temporary = f"{path}/_{uuid.uuid4().hex}"
    with where.open_output_stream(temporary) as sink:
        sink.write(raw)
    where.move(temporary, f"{path}/{name}")
    return f"{folder}/{name}"


def get(folder: str, name: str) -> bytes:
    """A small file of the folder, hidden ones too, which Spark's sources pass over."""
    where, path = pafs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{path}/{name}") as f:
        return f.read()


# --- patches ------------------------------------------------------------------------------------------------------


def write_patches(points: DataFrame, folder: str, block: str = "block", patch: str = "patch", least: int = 10) -> DataFrame:
    """(block, path, patches, points): a tar per block with a PLY file and a JSON record of every patch of `least` points or more.

    points has block, patch, score, distance and the columns of POINT. A block is one task's group, as it is one file.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        patches = n = 0
        with tarfile.open(fileobj=raw, mode="w") as tar:
            for number, rows in frame.groupby(patch):
                if len(rows) < least:
                    continue
                rows = rows.sort_values(list(POINT))
                record = {"score": float(rows["score"].iloc[0]), "distance": float(rows["distance"].iloc[0]), "n": len(rows)}
                for name, data in ((f"surface_{number}.ply", formats.ply_bytes({c: rows[c].to_numpy(float) for c in POINT})), (f"metadata_{number}.json", json.dumps(record).encode())):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                patches, n = patches + 1, n + len(rows)
        name = str(frame[block].iloc[0])
        path = put(folder, f"{name}.tar", raw.getvalue()) if patches else None
        return pd.DataFrame({"block": [name], "path": [path], "patches": [patches], "points": [n]})

    return points.groupBy(block).applyInPandas(run, "block string, path string, patches long, points long")


def read_patches(spark: SparkSession, path: str, ratio: float = 1.0, least: int = 1) -> DataFrame:
    """(block, patch, score, distance, POINT) of all patches in archives below path, with `least` points or more.

    With a ratio below 1 evenly spaced points stand for a patch, one at least.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    members = {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
                for member, data in sorted(members.items()):
                    if not member.endswith(".ply"):
                        continue
                    number = member[: -len(".ply")].rpartition("_")[2]
                    record = json.loads(members.get(f"metadata_{number}.json", b"{}"))
                    found = formats.parse_ply(data)
                    n = len(found["x"])
                    if n < least:
                        continue
                    pick = np.unique(np.linspace(0, n - 1, max(1, int(n * ratio))).astype(int))
                    rows = pd.DataFrame({c: found[c][pick].astype(float) if c in found else np.nan for c in POINT})
                    yield rows.assign(block=name.rpartition("/")[2].removesuffix(".tar"), patch=int(number), score=float(record.get("score", np.nan)), distance=float(record.get("distance", np.nan)))[["block", "patch", "score", "distance", *POINT]]

    schema = "block string, patch long, score double, distance double, " + ", ".join(f"{c} double" for c in POINT)
    return formats._files(spark, path).mapInPandas(run, schema)


def blocks_in_range(rows: DataFrame, column: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose block name `x_y_z` lies in the given closed ranges, with its numbers as bx, by, bz."""
    parts = F.split(column, "_")
    rows = rows.withColumns({n: F.try_element_at(parts, F.lit(i + 1)).try_cast("long") for i, n in enumerate(("bx", "by", "bz"))})
    for n, (low, high) in zip(("bx", "by", "bz"), ranges, strict=True):
        rows = rows.where(F.col(n).between(low, high))
    return rows


# --- graphs -------------------------------------------------------------------------------------------------------


def read_graph(spark: SparkSession, path: str, z_range: tuple[float, float] | None = None, same_winding: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a binary graph; each undirected edge once, from its smaller end.

    With z_range only nodes inside and the edges between them; certainties of edges within one winding (|k| < 180 across
    blocks) are multiplied by same_winding.
    """

    def nodes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                yield formats.parse_graph(raw)[0]

    def edges_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                edges = formats.parse_graph(raw)[1]
                yield edges[edges["src"] < edges["dst"]]

    files = formats._files(spark, path)
    nodes = files.mapInPandas(nodes_of, "id long, z double, f double, gt boolean, gt_f double")
    edges = files.mapInPandas(edges_of, "src long, dst long, certainty double, k double, same_block boolean")
    near = (F.abs("k") < 180.0) & ~F.col("same_block")
    edges = edges.withColumn("certainty", F.when(near, F.col("certainty") * same_winding).otherwise(F.col("certainty")))
    if z_range:
        nodes = nodes.where(F.col("z").between(*z_range))
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst", "k", "certainty", "same_block")


def result_bytes(f: np.ndarray, deleted: np.ndarray) -> bytes:
    """A solver's result: u32 count, then per node f32 f and a flag that it was deleted."""
    rows = np.empty(len(f), np.dtype([("f", "<f4"), ("deleted", "?")]))
    rows["f"], rows["deleted"] = f, deleted
    return struct.pack("<I", len(f)) + rows.tobytes()


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """(id, f, deleted) of a solver's result file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                (n,) = struct.unpack_from("<I", raw)
                rows = np.frombuffer(raw, np.dtype([("f", "<f4"), ("deleted", "?")]), n, 4)
                yield pd.DataFrame({"id": np.arange(n), "f": rows["f"].astype(float), "deleted": rows["deleted"]})

    return formats._files(spark, path).mapInPandas(run, "id long, f double, deleted boolean")


def with_result(nodes: DataFrame, result: DataFrame) -> DataFrame:
    """Nodes that were not deleted, with the solver's f and the whole turns between it and their own angle, floored."""
    rows = nodes.withColumnRenamed("f", "angle").join(result.where("NOT deleted").select("id", "f"), "id")
    return rows.withColumn("k", F.floor((F.col("angle") - F.col("f")) / 360.0))


# --- meshes -------------------------------------------------------------------------------------------------------


def write_obj(vertices: pd.DataFrame, triangles: pd.DataFrame, folder: str, name: str, texture: str | None = None) -> str:
    """An OBJ file, with texture coordinates where vertices have u and v, and with a texture an MTL file beside it."""
    uv = {"u", "v"} <= set(vertices.columns)
    at = {v: i + 1 for i, v in enumerate(vertices["vid"].tolist())}
    lines = [f"mtllib {name}.mtl", "usemtl default"] if texture else []
    lines += [f"v {x!r} {y!r} {z!r}" for x, y, z in vertices[["x", "y", "z"]].astype(float).itertuples(index=False)]
    lines += [f"vt {u!r} {v!r}" for u, v in vertices[["u", "v"]].astype(float).itertuples(index=False)] if uv else []
    corner = (lambda i: f"{i}/{i}") if uv else str
    lines += ["f " + " ".join(corner(at[v]) for v in t) for t in triangles[["v0", "v1", "v2"]].itertuples(index=False)]
    if texture:
        put(folder, f"{name}.mtl", f"newmtl default\nKa 1.0 1.0 1.0\nKd 1.0 1.0 1.0\nKs 0.0 0.0 0.0\nillum 2\nd 1.0\nmap_Kd {texture}\n".encode())
    return put(folder, f"{name}.obj", ("\n".join(lines) + "\n").encode())


def read_transform(spark: SparkSession, path: str) -> list[list[float]]:
    """The 4 x 4 matrix of a JSON file {"transformation_matrix": rows}; three rows are completed."""
    rows = json.loads(bytes(formats._files(spark, path).first()["content"]))["transformation_matrix"]
    return [list(map(float, r)) for r in rows] + [[0.0, 0.0, 0.0, 1.0]] * (4 - len(rows))


def ppm_bytes(pixels: np.ndarray) -> bytes:
    """A per-pixel map of (height, width, 6) positions and normals, as formats.parse_ppm reads it."""
    head = {"width": pixels.shape[1], "height": pixels.shape[0], "dim": 6, "ordered": "true", "type": "double", "version": 1}
    return "".join(f"{k}: {v}\n" for k, v in head.items()).encode() + b"<>\n" + np.ascontiguousarray(pixels, "<f8").tobytes()


# --- volumes ------------------------------------------------------------------------------------------------------


def write_chunks(voxels: DataFrame, folder: str, shape: tuple[int, int, int], chunk: int = 16) -> DataFrame:
    """A chunked array (zarr version 2, uint16, zstandard) of sparse voxels (x, y, z, v): (name, voxels) of the chunks that hold any.

    Voxels of a chunk meet in one task, a file each; empty chunks have no file and read as zeros.
    """
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": [chunk] * 3, "dtype": "<u2", "compressor": {"id": "zstd", "level": 3}, "fill_value": 0, "order": "C", "filters": None}
    put(folder, ".zarray", json.dumps(meta).encode())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        name = ".".join(str(int(frame[f"c{a}"].iloc[0])) for a in "xyz")
        data = np.zeros((chunk,) * 3, "<u2")
        data[tuple((frame[a] % chunk).to_numpy(int) for a in "xyz")] = frame["v"].clip(0, 65535).to_numpy()
        put(folder, name, zstandard.ZstdCompressor(level=3).compress(data.tobytes()))
        return pd.DataFrame({"name": [name], "voxels": [len(frame)]})

    rows = voxels.select("x", "y", "z", "v", *[F.floor(F.col(a) / chunk).alias(f"c{a}") for a in "xyz"])
    return rows.groupBy("cx", "cy", "cz").applyInPandas(run, "name string, voxels long")


def read_chunks(spark: SparkSession, folder: str, box: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """(x, y, z, v) of the voxels above zero, in a half-open box of the array if given; only the box's chunks are opened."""
    meta = json.loads(get(folder, ".zarray"))
    chunk, kind = meta["chunks"], np.dtype(meta["dtype"])
    names = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.[0-9]*.[0-9]*").load(folder)
    parts = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    for i, (low, high) in enumerate(box or ()):
        names = names.where(parts[i].cast("long").between(low // chunk[i], (high - 1) // chunk[i]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind).reshape(chunk)
                at = np.nonzero(data)
                first = [int(n) * c for n, c in zip(path.rpartition("/")[2].split("."), chunk, strict=True)]
                yield pd.DataFrame({a: i + f for a, i, f in zip("xyz", at, first, strict=True)} | {"v": data[at].astype("int64")})

    rows = names.select("path", "content").mapInPandas(run, "x long, y long, z long, v long")
    for a, (low, high) in zip("xyz", box or (), strict=False):
        rows = rows.where((F.col(a) >= low) & (F.col(a) < high))
    return rows


def chunk_means(spark: SparkSession, folder: str) -> DataFrame:
    """(name, mean) of every chunk of an array."""
    meta = json.loads(get(folder, ".zarray"))
    size = int(np.prod(meta["chunks"]))
    cell = [F.floor(F.col(a) / c).cast("string") for a, c in zip("xyz", meta["chunks"], strict=True)]
    return read_chunks(spark, folder).groupBy(F.concat_ws(".", *cell).alias("name")).agg((F.sum("v") / size).alias("mean"))


def tiff_bytes(image: np.ndarray) -> bytes:
    """A grey TIFF image of one uncompressed strip, 8 or 16 bits a pixel."""
    bits, (height, width) = image.dtype.itemsize * 8, image.shape
    data = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()
    # The tags of a baseline grey image.
    tags = [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(data))]
    table = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + len(data) % 2) + data + bytes(len(data) % 2) + table


def parse_tiff(raw: bytes) -> np.ndarray:
    """(pages, height, width) of a grey TIFF file with uncompressed strips; other kinds are refused."""
    order = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", raw, 4)
    pages = []
    while at:
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            form = {1: "B", 3: "H", 4: "I"}.get(kind)
            if form:
                size = struct.calcsize(form) * count
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{form}", raw, place)
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only uncompressed grey images are read")
        data = b"".join(raw[a : a + s] for a, s in zip(tags[273], tags[279], strict=True))
        pages.append(np.frombuffer(data, f"{order}u{tags[258][0] // 8}").reshape(tags[257][0], tags[256][0]))
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    return np.stack(pages)


def read_cells(spark: SparkSession, path: str, size: int, box: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """(x, y, z, v) of the voxels above zero in TIFF cells named `x_y_z.tif` by 1-based cell numbers, pages along z.

    A box is half-open and may reach beyond the cells: what has no cell reads as zeros, which are no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path)
    parts = F.split(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tif$", ""), "_")
    for i, (low, high) in enumerate(box or ()):
        files = files.where(((parts[i].cast("long") - 1) * size < high) & (parts[i].cast("long") * size > low))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                cell = [(int(n) - 1) * size for n in name.rpartition("/")[2].removesuffix(".tif").split("_")]
                data = parse_tiff(raw)
                z, y, x = np.nonzero(data)
                yield pd.DataFrame({"x": x + cell[0], "y": y + cell[1], "z": z + cell[2], "v": data[z, y, x].astype("int64")})

    rows = files.select("path", "content").mapInPandas(run, "x long, y long, z long, v long")
    for a, (low, high) in zip("xyz", box or (), strict=False):
        rows = rows.where((F.col(a) >= low) & (F.col(a) < high))
    return rows


def no_cells(spark: SparkSession, path: str, size: int, box: tuple[tuple[int, int], ...]) -> bool:
    """Whether a box touches no cell file at all; only names are listed."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path")
    parts = F.split(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tif$", ""), "_")
    for i, (low, high) in enumerate(box):
        names = names.where(((parts[i].cast("long") - 1) * size < high) & (parts[i].cast("long") * size > low))
    return not names.limit(1).count()


def line_points(spark: SparkSession, start: tuple[float, float, float], direction: tuple[float, float, float], length: float, step: float) -> DataFrame:
    """Points every `step` along a line of the given length."""
    norm = float(np.linalg.norm(direction))
    n = int(length / step)
    return spark.range(n).select(*[(F.lit(s) + F.col("id") * (step * d / norm)).alias(a) for a, s, d in zip("xyz", map(float, start), direction, strict=True)])
