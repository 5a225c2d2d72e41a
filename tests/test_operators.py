import itertools
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry
from gridloom.operators import mesh, profile, quality, reblock, spatial, temporal
from gridloom.operators.model import BlockModel, ModelError
from gridloom.operators.reblock import Agg
from gridloom.sources import files, generate


def rows(df):
    return [tuple(r) for r in df.collect()]


def grid(spark, shape, **columns):
    """A model with columns given in block order."""
    n = shape[0] * shape[1] * shape[2]
    kinds = {c: "string" if any(isinstance(x, str) for x in v) else "double" if any(isinstance(x, float) for x in v) else "int" for c, v in columns.items()}
    data = [(b, *(v[b] for v in columns.values())) for b in range(n)]
    return BlockModel(spark.createDataFrame(data, "block_id int, " + ", ".join(f"{c} {t}" for c, t in kinds.items())), Geometry(shape=shape))


def one(model, column):
    return [r[0] for r in rows(model.df.orderBy("block_id").select(column))]


# down


def test_mode_of_ties_is_the_first_seen(spark):
    m = grid(spark, (2, 2, 2), t=["b", "a", "a", "b", "c", "c", "d", "d"])
    assert one(reblock.downsample(m, (2, 2, 2), {"t": Agg("mode")}), "t") == ["b"]
    m = grid(spark, (2, 2, 2), t=[None, None, None, None, None, None, "z", "y"])
    assert one(reblock.downsample(m, (2, 2, 2), {"t": Agg("mode")}), "t") == ["z"]


@pytest.mark.parametrize("values, want", [([2, 3] * 4, 2), ([3, 4] * 4, 4), ([1] * 7 + [None], 1)])
def test_integer_means_round_half_to_even(spark, values, want):
    assert one(reblock.downsample(grid(spark, (2, 2, 2), v=values), (2, 2, 2), {"v": Agg("mean")}), "v") == [want]


def test_sums_and_fill(spark):
    nan = float("nan")
    m = grid(spark, (2, 2, 4), v=[1.0] * 8 + [nan] * 8, f=[1.0, 0.5] * 8)
    m = m.with_df(m.df.withColumn("v", F.when(F.col("block_id") % 4 >= 2, F.lit(nan)).otherwise(F.lit(1.0))))
    got = reblock.downsample(m, (2, 2, 2), {"v": Agg("sum", fill_ratio="f")})
    assert one(got, "v") == [8 / 0.75, None]
    with pytest.raises(ModelError, match="fill_ratio"):
        reblock.downsample(m, (2, 2, 2), {"v": Agg("sum", fill_ratio="f"), "f": Agg("sum", fill_ratio="v")})
    zero = grid(spark, (2, 2, 2), v=[0.0] * 8)
    assert one(reblock.downsample(zero, (2, 2, 2), {"v": Agg("sum", replace={0: "NaN"})}), "v") == [None]


def test_down_against_numpy(spark):
    rng = np.random.default_rng(3)
    v, w = rng.random(4 * 6 * 8), rng.random(4 * 6 * 8)
    v[rng.random(len(v)) < 0.2] = np.nan
    m = grid(spark, (4, 6, 8), v=[float(x) for x in v], w=[float(x) for x in w])
    got = reblock.downsample(m, (2, 3, 4), {"v": Agg("weighted_mean", basis="w"), "w": Agg("sum")})
    parts = lambda a: a.reshape(2, 2, 2, 3, 2, 4).transpose(0, 2, 4, 1, 3, 5).reshape(8, -1)
    pv, pw = parts(v), parts(w)
    ok = np.isfinite(pv)
    assert np.allclose(one(got, "v"), np.nansum(pv * pw, 1) / np.where(ok, pw, 0).sum(1))
    assert np.allclose(one(got, "w"), pw.sum(1))
    assert got.geometry.shape == (2, 2, 2) and got.geometry.block_size == (2, 3, 4)


def test_sparse_parents_are_null(spark):
    m = grid(spark, (4, 4, 4), fe=[float(n) for n in range(64)]).where("block_id = 0")
    got = reblock.downsample(m, (2, 2, 2), {"fe": Agg("sum")})
    assert one(got, "fe") == [0.0] + [None] * 7


def test_factors():
    g = Geometry(shape=(10, 10, 10))
    assert reblock.factors(g, (1, 1, 1))[0] == "same" and reblock.factors(g, (2, 5, 1)) == ("down", (2, 5, 1))
    assert reblock.factors(g, (0.1, 0.2, 1)) == ("up", (10, 5, 1))
    for bad in ((1.5, 1, 1), (2, 0.5, 1), (3, 3, 3), (0.3, 1, 1)):
        with pytest.raises(ModelError):
            reblock.factors(g, bad)


# up


def test_up_methods(spark):
    m = grid(spark, (2, 1, 1), v=[0, 2])
    fine = lambda method: one(reblock.upsample(m, (0.5, 1, 1), {"v": method}), "v")
    assert fine("nearest") == [0, 0, 2, 2] == fine("parent")
    assert fine("linear") == [0, 1, 1, 2] and fine("mode") == [0, 0, 0, 2]
    with pytest.raises(ModelError, match="every"):
        reblock.upsample(m, (0.5, 1, 1), {})
    with pytest.raises(ModelError, match="number"):
        reblock.upsample(grid(spark, (2, 1, 1), t=["a", "b"]), (0.5, 1, 1), {"t": "linear"})


def test_linear_against_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.random((4, 3, 5))
    got = one(reblock.upsample(grid(spark, (4, 3, 5), v=[float(x) for x in v.ravel()]), (0.5, 0.5, 0.5), {"v": "linear"}), "v")
    axes = [np.linspace(0, n - 1, 2 * n) for n in v.shape]
    want = []
    for at in itertools.product(*axes):
        low = [min(int(a), n - 2) for a, n in zip(at, v.shape)]
        t = [a - b for a, b in zip(at, low)]
        want.append(sum(v[tuple(b + e for b, e in zip(low, c))] * np.prod([x if e else 1 - x for x, e in zip(t, c)]) for c in itertools.product((0, 1), repeat=3)))
    assert np.allclose(got, want)
    held = grid(spark, (2, 2, 2), v=[float("nan")] + [1.0] * 7)
    assert one(reblock.upsample(held, (0.5, 0.5, 0.5), {"v": "linear"}), "v") == [None] * 64


def test_up_and_down_again(spark):
    m = grid(spark, (2, 2, 3), v=[float(n) for n in range(12)], t=[f"c{n % 3}" for n in range(12)])
    fine = reblock.upsample(m, (0.5, 0.5, 0.5), {"v": "parent", "t": "parent"})
    back = reblock.downsample(fine, (1, 1, 1), {"v": Agg("mean"), "t": Agg("mode")})
    assert one(back, "v") == one(m, "v") and one(back, "t") == one(m, "t")


def test_aggregate(spark):
    df = spark.createDataFrame([(1.0, 1.0, "A"), (2.0, 1.0, "B"), (3.0, 1.0, "A"), (4.0, 1.0, "A")], "value double, weight double, category string")
    assert rows(reblock.weighted_aggregate(df, {"value": "weight"}, ("category",))) == [(2.5, 4.0, "A")]
    assert rows(reblock.weighted_aggregate(df, {"value": "weight"}, ("category",), "proportions")) == [(2.5, 4.0, {"A": 0.75, "B": 0.25})]


def test_heatmap(spark):
    m = grid(spark, (2, 2, 3), v=[float(n) for n in range(12)])
    assert sorted(rows(reblock.heatmap(m, "v", 4.0))) == [(0, 0, 0), (0, 1, 1), (1, 0, 3), (1, 1, 3)]
    assert reblock.heatmap(m, "v", 4.0, "x").columns == ["j", "k", "n"]


# space


def test_polygons(spark):
    m = BlockModel(Geometry(shape=(3, 3, 1)).grid(spark), Geometry(shape=(3, 3, 1)))
    box = spatial.Polygon.box(0, 0, 2, 2)
    assert one(m.with_df(spatial.flag_polygon(m, box, outside=False)), "inside") == [True, True, False, True, True, False, False, False, False]
    edge = spatial.Polygon.box(0.5, 0.5, 1.5, 1.5, "pit")
    assert one(m.with_df(spatial.flag_polygon(m, edge, outside="out")), "inside") == ["pit", "pit", "out"] * 2 + ["out"] * 3
    hole = spatial.Polygon(((((0, 0), (3, 0), (3, 3), (0, 3)), ((1, 1), (2, 1), (2, 2), (1, 2))),))
    assert one(m.with_df(spatial.flag_polygon(m, hole, outside=False)), "inside") == [True] * 4 + [False] + [True] * 4
    rng = random.Random(1)
    star = [(np.cos(a) * r + 1.5, np.sin(a) * r + 1.5) for a, r in ((k / 50 * 2 * np.pi, rng.uniform(0.4, 2)) for k in range(50))]
    assert spatial.flag_polygon(m, spatial.Polygon(((star,),)), outside=False).count() == 9
    for bad in ([], [[[(0, 0), (1, 1)]]], [[[(0, 0), (1, 1), (2, 2)]]], [[[(0, 0), (1, 1), (1, 0), (0, 1)]]]):
        with pytest.raises(ModelError):
            spatial.Polygon(tuple(bad))


def test_surfaces(spark):
    m = BlockModel(Geometry(shape=(2, 2, 2)).grid(spark), Geometry(shape=(2, 2, 2)))
    raster = spatial.Raster((0, 1, 2), (0, 1, 2), ((1.5,) * 3,) * 3)
    plane = spatial.MeshSurface(spatial.Mesh(((0, 0, 1.5), (2, 0, 1.5), (2, 2, 1.5), (0, 2, 1.5)), ((0, 1, 2), (0, 2, 3))))
    for s in (raster, plane):
        assert one(m.with_df(s.fraction_below(m)), "fraction") == [1, 0.5] * 4
    with pytest.raises(Exception, match="outside the raster"):
        spatial.Raster((0, 1), (0, 1), ((0, 0), (0, 0))).fraction_below(m).collect()
    with pytest.raises(Exception, match="under no triangle"):
        spatial.MeshSurface(spatial.Mesh(((0, 0, 1), (1, 0, 1), (0, 1, 1)), ((0, 1, 2),))).fraction_below(m).collect()
    with pytest.raises(Exception, match="several heights"):
        spatial.MeshSurface(spatial.Mesh(((0, 0, 1), (9, 0, 1), (0, 9, 1), (0, 0, 2), (9, 0, 2), (0, 9, 2)), ((0, 1, 2), (3, 4, 5)))).fraction_below(m).collect()
    for bad in (((0, 0), (0, 1), ((0, 0), (0, 0))), ((0, 1), (0, 1), ((0, 0),)), ((0, 1), (0, 1), ((0, float("nan")), (0, 0)))):
        with pytest.raises(ModelError):
            spatial.Raster(*bad)
    with pytest.raises(ModelError):
        spatial.MeshSurface(spatial.Mesh(((0, 0, 0), (0, 0, 1), (1, 0, 0)), ((0, 1, 2),)))
    uneven = spatial.Raster((3, 1, 0), (0, 1, 4), ((0, 10, 20), (5, 15, 25), (30, 20, 10)))
    points = spark.createDataFrame([(0.5, 0.5), (2.0, 3.0)], "x double, y double")
    got = [round(r[2], 6) for r in rows(uneven.heights(points, F.col("x"), F.col("y")))]
    assert got == [17.5, 18.333333] or got == [17.5, round(0.5 * (15 / 3 + 20 * 2 / 3) + 0.5 * (5 / 3 + 30 * 2 / 3), 6)]


def cube(low=0.0, high=2.0):
    points = [tuple((low, high)[e] for e in c) for c in mesh.CORNERS]
    return spatial.Mesh(tuple(points), tuple(t for _, *ts in mesh.SIDES for t in ts), "ore")


def test_solids(spark):
    m = BlockModel(Geometry(shape=(3, 3, 3)).grid(spark), Geometry(shape=(3, 3, 3)))
    got = {r["block_id"]: r["inside"] for r in spatial.flag_solid(m, spatial.Solid(cube()), outside="out").collect()}
    assert all((got[(i * 3 + j) * 3 + k] == "ore") == (max(i, j, k) <= 1) for i in range(3) for j in range(3) for k in range(3))
    on = {r["block_id"] for r in spatial.Solid(cube(0.5, 1.5)).inside_ids(m).collect()}
    assert on == {(i * 3 + j) * 3 + k for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    with pytest.raises(ModelError, match="closed"):
        spatial.Solid(spatial.Mesh(cube().vertices, cube().faces[:-1]))


# meshes


def test_faces_of_blocks(spark):
    tables = lambda shape, keep: mesh.triangulate(BlockModel(Geometry(shape=shape).grid(spark).where(F.col("block_id").isin(keep)), Geometry(shape=shape)))
    for shape, keep, faces in (((1, 1, 1), [0], 12), ((1, 1, 2), [0, 1], 20), ((3, 3, 3), [0, 13], 24), ((3, 3, 3), list(range(27)), 108)):
        m = tables(shape, keep)
        assert m.faces.count() == faces
        assert mesh.validate(m).first()["dangling"] == 0
        welded = mesh.open_edges(mesh.welded(m))
        assert keep == [0, 13] or welded.count() == 0
    dense = mesh.triangulate(BlockModel(Geometry(shape=(2, 2, 2)).grid(spark), Geometry(shape=(2, 2, 2))), surface_only=False)
    assert dense.vertices.count() == 64 and dense.faces.count() == 96


def test_faces_point_outwards():
    for step, *triangles in mesh.SIDES:
        for t in triangles:
            a, b, c = (np.array(mesh.CORNERS[v], float) for v in t)
            assert np.dot(np.cross(b - a, c - a), step) > 0


def test_mesh_origin_and_attributes(spark):
    g = Geometry.create(shape=(1, 1, 2), origin=(10, 0, 0), azimuth=90)
    m = mesh.triangulate(BlockModel(g.grid(spark).withColumn("v", F.col("k") * 1.5), g), ["v"])
    xs = [round(r[0], 6) + 0.0 for r in rows(m.vertices.select("x"))]
    assert (min(xs), max(xs)) == (9.0, 10.0)
    assert {r[0] for r in rows(m.faces.where("k = 1").select("v"))} == {1.5}
    assert {tuple(r) for r in rows(mesh.colours(m.vertices, "v").select("r", "a"))} == {(0, 255), (255, 255)}


def test_mesh_files(spark, tmp_path):
    m = mesh.triangulate(generate.toy(spark, Geometry(shape=(3, 3, 2)), center=(1.5, 1.5, 1), radii=(2, 2, 2)), ["grade"])
    files.write_ply(m, f"{tmp_path}/m.ply")
    back = files.ply_tables(spark, f"{tmp_path}/m.ply")
    assert back.faces.count() == m.faces.count() and back.vertices.count() == m.vertices.count() and back.meta["shape"] == [3, 3, 2]
    assert back.vertices.agg(F.round(F.sum("grade"), 6)).first() == m.vertices.agg(F.round(F.sum("grade"), 6)).first()
    files.write_ply(m, f"{tmp_path}/b.ply", binary=True)
    a, b = files.read_ply(f"{tmp_path}/m.ply"), files.read_ply(f"{tmp_path}/b.ply")
    assert a[1] == b[1] and a[3] == b[3] and np.allclose(a[0]["grade"], b[0]["grade"])
    files.write_glb(m, f"{tmp_path}/m.glb", mesh.colours(m.vertices, "grade"))
    points, faces, colours, extras = files.read_glb(f"{tmp_path}/m.glb")
    assert len(points) == len(colours) == m.vertices.count() and len(faces) == m.faces.count() and extras["shape"] == [3, 3, 2]
    for text in ("nope", "ply\nformat ascii 1.0\n", "ply\nformat ascii 1.0\nelement vertex 0\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n4 0 1 2 3\n"):
        with open(f"{tmp_path}/bad.ply", "w") as f:
            f.write(text)
        with pytest.raises(ModelError):
            files.read_ply(f"{tmp_path}/bad.ply")


def test_wkb():
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    assert files.wkb_polygon(files.to_wkb([ring])) == [[ring]]
    with pytest.raises(ModelError):
        files.wkb_polygon(b"\x01\x01\x00\x00\x00" + b"\0" * 16)


def test_named_polygons(spark, tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    data = [(n, bytearray(files.to_wkb([ring]))) for n in ("one", "two", "two")]
    spark.createDataFrame(data, "name string, geometry binary").write.parquet(f"{tmp_path}/p")
    assert files.read_polygon(spark, f"{tmp_path}/p", "one").name == "one"
    for bad in ("two", "three"):
        with pytest.raises(ModelError):
            files.read_polygon(spark, f"{tmp_path}/p", bad)


# checks, profiles, time


def test_spacing(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 1.0), (2.0, 0.0, 3.0)], "x double, y double, z double")
    got = {r["column"]: r["regular"] for r in quality.spacing_report(df).collect()}
    assert got == {"x": True, "y": False, "z": False}
    with pytest.raises(ModelError, match="missing"):
        quality.spacing_report(df.drop("z"))
    with pytest.raises(ModelError, match="inferred"):
        quality.infer_geometry(df)


def test_id_checks(spark):
    g = Geometry(shape=(1, 1, 4))
    bad = BlockModel(spark.createDataFrame([(0,), (0,), (9,), (None,)], "block_id int"), g)
    said = quality.block_id_report(bad.df, 4).first()
    assert not said["valid"] and said["nulls"] == 1 and said["ids"] == 2
    with pytest.raises(ModelError):
        quality.assert_block_ids(bad)
    with pytest.raises(ModelError, match="missing"):
        quality.assert_block_ids(bad.with_df(bad.df.withColumnRenamed("block_id", "b")))
    moved = g.grid(spark).withColumn("z", F.when(F.col("block_id") == 2, 0.5).otherwise(F.col("z")))
    assert rows(quality.id_xyz_mismatches(moved, g)) == [(2, 0)]
    with pytest.raises(ModelError, match="block 2"):
        quality.first_mismatch(moved, g)


def test_deciles(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    edges = profile.decile_edges(df, "v").first()["edges"]
    assert np.allclose(edges, np.percentile(values, range(10, 100, 10)))
    got = rows(profile.bin_to_deciles(df, "v"))
    want = np.clip(np.digitize(values, edges), 0, 9)
    assert [r[1] for r in got][:101] == list(want) and [r[1] for r in got][101:] == [None, None]


def test_budgets():
    assert profile.parse_memory_budget("256MB") == 256_000_000 and profile.parse_memory_budget("2GiB") == 2**31
    for bad in ("", "x", "-1MB", "0", "5 parsecs"):
        with pytest.raises(ValueError):
            profile.parse_memory_budget(bad)
    sizes = {"a": 100, "b": 150, "c": 100}
    assert profile.columns_per_batch(["a", "b", "c"], sizes, 260) == 2 and profile.columns_per_batch(["a", "b", "c"], sizes, 1) == 1


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "<a>"), (float("nan"), "b")], "v double, t string")
    profile.save_report(profile.report_html(df, "R&D", {"v": "Value"}), f"{tmp_path}/r.html")
    text = open(f"{tmp_path}/r.html").read()
    assert "R&amp;D" in text and "&lt;a&gt;" in text and "Value" in text


def test_depletion(spark):
    times = [datetime(2024, m, 1) for m in (1, 2, 3)]
    df = temporal.depletion(spark, times, (-5, 5), (-5, 5), 5, 5, 5, 10)
    got = {tuple(r[:3]): r[3] for r in rows(df)}
    assert len(got) == 75 and np.isclose(got[times[2], 0.0, 0.0], -10) and got[times[0], 5.0, 5.0] == 0
    assert all(v > 0 for _, v in rows(temporal.volumes(df)))
    step = temporal.differences(df, ["x", "y"]).where("x = 0 AND y = 0").orderBy("time").select("difference")
    assert [r[0] is None for r in rows(step)] == [True, False, False]
    assert np.isclose(temporal.between(df, ["x", "y"], times[0], times[2]).where("x = 0 AND y = 0").first()[2], got[times[2], 0.0, 0.0] - got[times[0], 0.0, 0.0])
    near = temporal.at_nearest(df, ["x", "y"], F.lit(datetime(2024, 2, 3)))
    assert {r[0] for r in rows(near.select("time"))} == {times[1]}


def test_dump_volume():
    import math

    r, h, base = temporal.dump_shape(100)
    assert np.isclose(math.pi * r**2 * h + math.pi / 3 * (base**2 - r**2) * h, 100)


def test_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    assert sorted(rows(profile.category_codes(df, "t"))) == [("a", 0), ("b", 1)]
    assert Counter(rows(profile.categorical_profile(df, ["t"]).select("value", "n"))) == Counter([("b", 2), ("a", 1), (None, 1)])
