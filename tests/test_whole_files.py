"""Files larger than the driver: written and read a part at a time, with nothing left out."""

import math
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry
from gridloom.operators import mesh
from gridloom.operators.model import BlockModel, ModelError
from gridloom.sources import files


@pytest.fixture(scope="module")
def blocks(spark):
    g = Geometry(shape=(20, 20, 20))
    df = g.grid(spark).select("block_id", F.when(F.col("block_id") % 7 != 0, F.col("block_id") * 0.5).alias("grade"))
    return BlockModel(df.repartition(8).cache(), g)


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    for name, value in (("PART", 2000), ("CHUNK", 2000), ("BLOCK", 1 << 15)):
        monkeypatch.setattr(files, name, value, raising=False)


def peak(f):
    """What f returns, and the most megabytes that this process held for it."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def expected(m):
    """Positions in the order of ids, and faces' corners as places in it."""
    order = [r[0] for r in m.vertices.select("vertex_id").orderBy("vertex_id").collect()]
    place = {v: n for n, v in enumerate(order)}
    points = [tuple(r) for r in m.vertices.orderBy("vertex_id").select("x", "y", "z").collect()]
    return points, [tuple(place[v] for v in r) for r in m.faces.orderBy("face_id").select("v0", "v1", "v2").collect()]


def test_vtu_is_streamed(spark, blocks, tmp_path):
    path = f"{tmp_path}/m.vtu"
    _, most = peak(lambda: files.write_vtu(blocks, path, ["grade"]))
    assert most < 4
    _, held = files.read_vtk(path)
    corners = mesh.hexahedra(blocks).orderBy("block_id", "corner").select("x", "y", "z").collect()
    assert held["Points"] == [c for r in corners for c in r] and held["connectivity"] == [*map(float, range(64_000))]
    assert held["offsets"] == [*map(float, range(8, 64_001, 8))] and held["types"] == [11.0] * 8000
    assert [None if math.isnan(v) else v for v in held["grade"]] == [r[0] for r in blocks.df.orderBy("block_id").select("grade").collect()]
    count, most = peak(lambda: sum(len(part) for name, part in files.vtk_chunks(path) if name == "Points" and part is not None))
    assert count == 192_000 and most < 4


def test_written_ply_is_streamed(blocks, tmp_path):
    m, path = mesh.triangulate(blocks, ["grade"], surface_only=False), f"{tmp_path}/m.ply"
    _, most = peak(lambda: files.write_ply(m, path, binary=True))
    assert most < 4
    points, faces = expected(m)
    v, f, a, _ = files.read_ply(path)
    assert f == faces and list(zip(v["x"], v["y"], v["z"])) == points and len(a["grade"]) == 96_000
    grades = [r[0] for r in m.vertices.orderBy("vertex_id").select("grade").collect()]
    assert [None if math.isnan(x) else x for x in v["grade"]] == grades
    counts, most = peak(lambda: [len(c["x"]) for name, c, _ in files.ply_chunks(path)[2] if name == "vertex"])
    assert sum(counts) == 64_000 and most < 4


def test_ply_tables_are_streamed(spark, blocks, tmp_path):
    m, path = mesh.triangulate(blocks, ["grade"], surface_only=False), f"{tmp_path}/m.ply"
    files.write_ply(m, path)
    held, most = peak(lambda: files.ply_tables(spark, path))
    assert most < 4
    points, faces = expected(m)
    assert [tuple(r) for r in held.vertices.orderBy("vertex_id").select("x", "y", "z").collect()] == points
    assert [tuple(r) for r in held.faces.orderBy("face_id").select("v0", "v1", "v2").collect()] == faces
    assert held.faces.where("NOT isnan(grade)").agg(F.sum("grade")).first() == m.faces.agg(F.sum("grade")).first()


def test_ply_tables_are_read_by_executors(blocks, spark, tmp_path, monkeypatch):
    """The driver parses no chunk, whatever a chunk's size."""
    monkeypatch.setattr(files, "CHUNK", 1 << 16)
    m, path = mesh.triangulate(blocks, ["grade"], surface_only=False), f"{tmp_path}/m.ply"
    files.write_ply(m, path)
    held, most = peak(lambda: files.ply_tables(spark, path))
    assert most < 4
    assert held.vertices.count() == 64_000 and held.faces.count() == 96_000


def test_surfaces_for_files_are_not_broadcast(spark, sf):
    """No list of a model's blocks passes through the driver, however small the model is."""
    from gridloom.plans import queries

    m = queries._surface(spark, sf)
    for df in (m.vertices, m.faces):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_ply_tables_of_any_layout(spark, tmp_path, monkeypatch):
    """Words may stand in any lines, other elements between, chunks of any size; what is wrong is a ModelError."""
    head = "ply\nformat ascii 1.0\ncomment a=1\nelement vertex 5\nproperty float x\nproperty float y\nproperty int s\nproperty float z\nelement edge 2\nproperty int a\nelement face 3\nproperty list uchar int vertex_indices\nproperty int code\nend_header\n"
    body = "0 0 1 2 1 2\n3 0\t0.5 1 9\r\n nan 4 4 4 4\n\n 5 5 5 5 77 88 3 0 1\n2 41 3 1 2 3 42 3 2\x0b3 4 43"
    form = head.replace("ascii", "binary_big_endian").encode() + b"".join(struct.pack(">2fif", *r) for r in ((0, 0, 1, 2), (1, 2, 3, 0), (0.5, 1, 9, math.nan), (4, 4, 4, 4), (5, 5, 5, 5)))
    form += struct.pack(">2i", 77, 88) + b"".join(struct.pack(">B4i", 3, n, n + 1, n + 2, 41 + n) for n in range(3))
    path = f"{tmp_path}/m.ply"
    for chunk in (1, 2, 1000):
        monkeypatch.setattr(files, "CHUNK", chunk)
        monkeypatch.setattr(files, "BLOCK", 20 if chunk < 1000 else 1 << 15)
        for data in (head.encode() + body.encode(), form, head.encode() + body.encode() + b"\n9 9"):
            (tmp_path / "m.ply").write_bytes(data)
            held = files.ply_tables(spark, path)
            assert held.meta == {"a": 1} and held.vertices.columns == ["vertex_id", "x", "y", "s", "z"]
            assert [tuple(r) for r in held.vertices.na.fill(-1.0).orderBy("vertex_id").selectExpr("vertex_id", "x", "y", "s", "if(isnan(z), -1, z)").collect()] == [(0, 0, 0, 1, 2), (1, 1, 2, 3, 0), (2, 0.5, 1, 9, -1), (3, 4, 4, 4, 4), (4, 5, 5, 5, 5)]
            assert [tuple(r) for r in held.faces.orderBy("face_id").collect()] == [(n, n, n + 1, n + 2, 41 + n) for n in range(3)]
    for data in (head + body[:-2], head + body.replace("3 1 2 3 42", "4 1 2 3 3 42"), head + body.replace("42", "4.5")):
        (tmp_path / "m.ply").write_text(data)
        with pytest.raises(ModelError):
            files.ply_tables(spark, path)
    (tmp_path / "m.ply").write_bytes(form[:-1])
    with pytest.raises(ModelError):
        files.ply_tables(spark, path)
    monkeypatch.setattr(files.store, "_mounted", lambda *_: False)  # the driver's way
    (tmp_path / "m.ply").write_bytes(form)
    assert [tuple(r) for r in files.ply_tables(spark, path).faces.orderBy("face_id").collect()] == [(n, n, n + 1, n + 2, 41 + n) for n in range(3)]
    empty = head.replace("vertex 5", "vertex 0").replace("edge 2", "edge 0").replace("face 3", "face 0")
    (tmp_path / "m.ply").write_text(empty)
    for mounted in (True, False):
        monkeypatch.setattr(files.store, "_mounted", lambda *_, m=mounted: m)
        held = files.ply_tables(spark, path)
        assert held.vertices.count() == held.faces.count() == 0 and held.faces.columns == ["face_id", "v0", "v1", "v2", "code"]


def test_ply_of_odd_elements(spark, tmp_path):
    """Lists of any length are passed over in vertices and other elements; what is cut off or no number is an error."""
    head = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty list uchar int seen\nproperty float y\nproperty float z\nelement edge 1\nproperty list uchar int ends\nelement face 1\nproperty list uchar int vertex_indices\nproperty int code\nend_header\n"
    body = "0 0 1 2\n1 2 7 8 0 0\n0.5 1 9 1 nan\n4 1 2 3 4\n3 0 1 2 41\n"
    for text, ok in ((head + body, True), (head + body[:-4], False), (head + body.replace("41", "4.5"), False)):
        (tmp_path / "m.ply").write_text(text)
        if not ok:
            with pytest.raises(ModelError):
                files.read_ply(f"{tmp_path}/m.ply")
            continue
        v, f, a, _ = files.read_ply(f"{tmp_path}/m.ply")
        assert v["x"] == [0.0, 1.0, 0.5] and v["y"] == [1.0, 0.0, 1.0] and f == [(0, 1, 2)] and a == {"code": [41]}
    big = head.replace("ascii", "binary_big_endian").encode() + b"".join(struct.pack(">fB", x, len(s)) + struct.pack(f">{len(s)}i2f", *s, y, z) for x, s, y, z in ((0, [], 1, 2), (1, [7, 8], 0, 0), (0.5, [9], 1, 3)))
    (tmp_path / "b.ply").write_bytes(big + struct.pack(">B2i", 2, 0, 1) + struct.pack(">B4i", 3, 0, 1, 2, 41))
    assert files.read_ply(f"{tmp_path}/b.ply")[:3] == ({"x": [0.0, 1.0, 0.5], "y": [1.0, 0.0, 1.0], "z": [2.0, 0.0, 3.0]}, [(0, 1, 2)], {"code": [41]})


def test_written_glb_is_streamed(blocks, tmp_path):
    m, path = mesh.triangulate(blocks, ["grade"], surface_only=False), f"{tmp_path}/m.glb"
    shades = mesh.colours(m.vertices, "grade")
    _, most = peak(lambda: files.write_glb(m, path, shades))
    assert most < 4
    points, faces = expected(m)
    at, corners, colours, _ = files.read_glb(path)
    assert at == points and corners == faces
    assert colours == [tuple(r) for r in shades.orderBy("vertex_id").select("r", "g", "b", "a").collect()]
    counts, most = peak(lambda: [(part, len(rows)) for part, rows in files.glb_chunks(path)[1]])
    assert most < 4 and [sum(n for p, n in counts if p == part) for part in range(3)] == [64_000, 96_000, 64_000]
    scene, _ = files.glb_chunks(path)
    assert scene["accessors"][0]["min"] == [*np.min(points, 0)] and scene["accessors"][0]["max"] == [*np.max(points, 0)]


def test_geotiff_wider_than_65535_pixels(spark, tmp_path, monkeypatch):
    from gridloom.operators import spatial
    from gridloom.plans.metaqueries import write_geotiff

    xs, ys = [2.0 * n for n in range(70_001)], [4.0, 2.0, 0.0]
    write_geotiff(f"{tmp_path}/m.tif", xs, ys, [[x - y for x in xs] for y in ys], tiles=True)
    r = files.read_geotiff(f"{tmp_path}/m.tif")
    assert r.xs == tuple(xs) and r.values[-1] == tuple(x - 4.0 for x in xs)
    plain = {tuple(c) for c in spatial.Raster(r.xs[:40_000], r.ys, tuple(v[:40_000] for v in r.values)).cells(spark).collect()}
    monkeypatch.setattr(spatial, "CELLS", 30_000)
    held, most = peak(lambda: r.cells(spark))
    cells = [tuple(c) for c in held.collect()]
    assert most < 15 and len(cells) == len(set(cells)) == 140_000 and plain <= set(cells)
    assert (69_999, 1, 139_998.0, 140_000.0, 2.0, 4.0, 139_996.0, 139_998.0, 139_994.0, 139_996.0) in cells


def test_codecs_by_column_on_a_cluster(spark, blocks, tmp_path, monkeypatch):
    """Inside the folder that all share the executors write; elsewhere files pass through the driver."""
    from gridloom.plans.schema import BlockSchema, Rule
    from gridloom.sources import store

    m = BlockModel(blocks.df.repartition(8), blocks.geometry, BlockSchema((Rule("grade", compression="snappy"),)))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    real = type(spark.conf).get
    for shared in (None, f"file://{tmp_path}/shared"):
        monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *more: shared if key == "spark.checkpoint.dir" else real(self, key, *more))
        path = f"file:{tmp_path}/shared/m"
        held = store.compress(m, path)
        assert store.compress(m, path, level=6).meta["rows"] == held.meta["rows"] == 8000
        assert {(n, c) for n, c, _ in store.column_chunks(spark, path) if n in ("block_id", "grade")} == {("block_id", "ZSTD"), ("grade", "SNAPPY")}
        assert store._mounted(spark, f"file:{tmp_path}/shared/m") == bool(shared) and not store._mounted(spark, f"{tmp_path}/m")
        found = store.load(spark, path).df
        assert found.count() == 8000 and found.select("block_id", "grade").exceptAll(m.df).count() == 0
