"""Round trips of archives, graphs, meshes, per-pixel maps and volumes."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from windlass.sources import formats, shared, stores


def test_patches_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(f"{b}_0_25", p, 0.5 + p, 2.0, *map(float, r.normal(size=6))) for b in (0, 50) for p in range(3) for _ in range(5 + 10 * p)]
    schema = "block string, patch long, score double, distance double, x double, y double, z double, nx double, ny double, nz double"
    told = stores.write_patches(spark.createDataFrame(rows, schema), f"file://{tmp_path}/patches").collect()
    assert {(x.block, x.patches, x.points) for x in told} == {("0_0_25", 2, 40), ("50_0_25", 2, 40)}
    got = stores.read_patches(spark, f"{tmp_path}/patches")
    assert sorted(tuple(x) for x in got.collect()) == sorted(x for x in rows if x[1] > 0)
    assert stores.read_patches(spark, f"{tmp_path}/patches", ratio=0.2, least=20).count() == 2 * 5
    assert {x.bx for x in stores.blocks_in_range(got, "block", [(10, 60), (0, 0), (0, 30)]).collect()} == {50}
    assert not [p for p in (tmp_path / "patches").iterdir() if p.name.startswith("_")]


def test_graph_round_trip(spark, tmp_path):
    nodes = pd.DataFrame({"id": range(4), "z": [0.0, 10.0, 20.0, 30.0], "f": [1.0, 2.0, 3.0, 4.0], "gt": [True, False, True, False], "gt_f": [0.0, 0.5, 1.0, 1.5]})
    edges = pd.DataFrame({"src": [0, 2, 1], "dst": [1, 1, 3], "certainty": [0.5, 0.25, 1.0], "k": [90.0, -270.0, 10.0], "same_block": [False, True, False]})
    path = stores.put(f"file://{tmp_path}/g", "graph.bin", formats.graph_bytes(nodes, edges))
    n, e = stores.read_graph(spark, path, same_winding=2.0)
    assert [tuple(x) for x in n.orderBy("id").collect()] == [tuple(x) for x in nodes.itertuples(index=False)]
    assert sorted(map(tuple, e.collect())) == [(0, 1, 90.0, 1.0, False), (1, 2, 270.0, 0.25, True), (1, 3, 10.0, 2.0, False)]
    n, e = stores.read_graph(spark, path, z_range=(0.0, 20.0))
    assert n.count() == 3 and sorted((x.src, x.dst) for x in e.collect()) == [(0, 1), (1, 2)]
    path = stores.put(f"file://{tmp_path}/g", "result.bin", stores.result_bytes(np.array([0.0, 362.5, -719.0, 5.0]), np.array([False, False, False, True])))
    got = {x.id: (x.f, x.k) for x in stores.with_result(stores.read_graph(spark, f"file://{tmp_path}/g/graph.bin")[0], stores.read_result(spark, path)).collect()}
    assert got == {0: (0.0, 0), 1: (362.5, -2), 2: (-719.0, 2)}


@pytest.mark.parametrize("texture", [None, "image.png"])
def test_obj_round_trip(spark, tmp_path, texture):
    v = pd.DataFrame({"vid": [7, 3, 5, 9], "x": [0.0, 1.5, 0.1, 2.0], "y": [0.0, 0.0, 1.0, 1.0], "z": [0.0, 1e-9, 3.0, 4.0], "u": [0.0, 0.5, 0.0, 1.0], "v": [0.0, 0.0, 1.0, 1.0]})
    t = pd.DataFrame({"v0": [7, 3], "v1": [3, 9], "v2": [5, 5]})
    path = stores.write_obj(v if texture else v.drop(columns=["u", "v"]), t, f"file://{tmp_path}/m", "mesh", texture)
    points, triangles = formats.read_obj(spark, path)
    assert [(x.x, x.y, x.z) for x in points.orderBy("vid").collect()] == list(v[["x", "y", "z"]].itertuples(index=False, name=None))
    assert [(x.v0, x.v1, x.v2) for x in triangles.collect()] == [(0, 1, 2), (1, 3, 2)]
    assert (tmp_path / "m" / "mesh.mtl").exists() == bool(texture)


def test_transforms_maps_and_lines(spark, tmp_path):
    path = stores.put(f"file://{tmp_path}/t", "transform.json", json.dumps({"transformation_matrix": [[1, 0, 0, 5], [0, 2, 0, 0], [0, 0, 1, 0]]}).encode())
    assert stores.read_transform(spark, path) == [[1.0, 0.0, 0.0, 5.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    pixels = np.arange(2 * 3 * 6, dtype=float).reshape(2, 3, 6)
    head, got = formats.parse_ppm(stores.ppm_bytes(pixels))
    assert (got == pixels).all() and head["width"] == "3"
    path = stores.put(f"file://{tmp_path}/t", "map.ppm", stores.ppm_bytes(pixels))
    assert formats.read_ppm(spark, path).count() == 5  # the first pixel holds no point
    assert [(x.x, x.y, x.z) for x in stores.line_points(spark, (1, 2, 3), (0, 0, 2), 3.0, 1.0).orderBy("z").collect()] == [(1.0, 2.0, 3.0), (1.0, 2.0, 4.0), (1.0, 2.0, 5.0)]


def test_chunked_arrays(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = sorted({tuple(map(int, p)) for p in r.integers(0, 40, (200, 3))})
    voxels = [(x, y, z, 1 + (x * y + z) % 900) for x, y, z in rows]
    folder = f"file://{tmp_path}/array"
    told = stores.write_chunks(spark.createDataFrame(voxels, "x long, y long, z long, v long"), folder, (40, 40, 40)).collect()
    assert sum(t.voxels for t in told) == len(voxels)
    assert sorted(tuple(x) for x in stores.read_chunks(spark, folder).collect()) == voxels
    box = ((5, 20), (0, 33), (16, 17))
    assert sorted(tuple(x) for x in stores.read_chunks(spark, folder, box).collect()) == [v for v in voxels if all(a <= c < b for c, (a, b) in zip(v, box, strict=False))]
    means = {x.name: x.mean for x in stores.chunk_means(spark, folder).collect()}
    assert means["0.0.0"] == pytest.approx(sum(v for x, y, z, v in voxels if max(x, y, z) < 16) / 16**3)


@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_volume_cells(spark, tmp_path, kind):
    r = np.random.default_rng(3)
    image = r.integers(0, 3, (5, 7)).astype(kind)
    assert (stores.parse_tiff(stores.tiff_bytes(image))[0] == image).all()
    assert (stores.parse_tiff(stores.tiff_bytes(image.byteswap().view(image.dtype.newbyteorder())))[0] == image).all()
    folder = f"file://{tmp_path}/cells"
    cells = {(1, 1, 1): r.integers(0, 2, (8, 8)).astype(kind), (2, 1, 1): r.integers(0, 9, (8, 8)).astype(kind)}
    for (a, b, e), data in cells.items():
        stores.put(folder, f"{a}_{b}_{e}.tif", stores.tiff_bytes(data))
    want = {(x + 8 * (a - 1), y, 0, int(data[y, x])) for (a, _, _), data in cells.items() for y in range(8) for x in range(8) if data[y, x]}
    assert {tuple(x) for x in stores.read_cells(spark, folder, 8).collect()} == want
    box = ((6, 30), (2, 9), (-4, 8))
    assert {tuple(x) for x in stores.read_cells(spark, folder, 8, box).collect()} == {v for v in want if all(a <= c < b for c, (a, b) in zip(v, box, strict=False))}
    assert stores.no_cells(spark, folder, 8, ((16, 20), (0, 8), (0, 8))) and not stores.no_cells(spark, folder, 8, ((15, 20), (0, 8), (0, 8)))


def test_shared_folders_are_cleared(spark):
    kept = shared.materialize(spark.range(3))
    files = kept.inputFiles()
    assert files and shared.clear(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*exist|not found|FILE"):
        spark.read.parquet(files[0]).count()


def test_tables_between_steps_start_no_process_per_file(spark):
    """The file system that starts a chmod per file is the one that leaves checksum files beside them."""
    from windlass.llm.common import stored

    for write in (shared.materialize, stored):
        made = write(spark.range(9))
        folder = Path(shared._MADE[-1].removeprefix("file://"))
        assert sorted(r.id for r in made.collect()) == list(range(9))
        assert list(folder.glob("*.parquet")) and not list(folder.rglob("*.crc"))
