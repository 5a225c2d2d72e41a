"""What keeps tasks and the driver small gives the same results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry
from gridloom.operators import profile, spatial
from gridloom.operators.model import BlockModel, ModelError
from gridloom.sources import files, store


@pytest.mark.parametrize("kind", ["even", "ties", "two", "one", "skewed", "infinite", "few", "none"])
def test_quantiles_of_narrow_brackets(spark, monkeypatch, kind):
    """Columns that are larger than what one task may sort, with few and with many different values."""
    monkeypatch.setattr(profile, "NARROW", 20)
    monkeypatch.setattr(profile, "ACCURACY", 50)
    monkeypatch.setattr(profile, "MARGIN", 0.05)
    rng = random.Random(kind)
    values = {
        "even": [float(n) for n in range(3000)], "ties": [float(rng.randrange(12)) for _ in range(3000)], "two": [1.0] * 1500 + [2.0] * 1500, "one": [7.0] * 500,
        "skewed": [math.exp(rng.gauss(0, 3)) for _ in range(3000)] + [0.5] * 900, "infinite": [float("-inf")] * 40 + [float(n) for n in range(300)] + [float("inf")] * 40, "few": [3.0, 1.0, 2.0], "none": [],
    }[kind]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    got = profile.quantiles(df, {"v": F.col("v")}, at)["v"]
    if not values:
        assert got is None
    elif kind == "infinite":
        assert got[0] == float("-inf") and got[-1] == float("inf") and got[3] == pytest.approx(np.percentile(values, 50))
    else:
        assert got == pytest.approx(np.percentile(values, [100 * a for a in at]).tolist())


def test_a_rank_that_is_not_in_its_bracket_is_found(spark):
    df = spark.createDataFrame([(float(n),) for n in range(100)], "v double")
    assert profile._ranked(df, {"v": F.col("v")}, {("v", 90): (10.0, 20.0), ("v", 15): (10.0, 20.0), ("v", 3): (3.0, 3.0)}) == {("v", 90): 90.0, ("v", 15): 15.0, ("v", 3): 3.0}


def test_long_rings_and_their_expression_agree(spark, monkeypatch):
    rng = random.Random(1)
    ring = [(20 + (9 + rng.random()) * math.cos(t / 40 * math.pi), 20 + (9 + rng.random()) * math.sin(t / 40 * math.pi)) for t in range(80)]
    hole = [(18, 18), (22, 18), (22, 22), (18, 22)]
    polygon = spatial.Polygon(((ring, hole), ([(0, 0), (6, 0), (6, 6), (0, 6)],)), "pit")
    for turned in ({}, {"azimuth": 20.0, "dip": 10.0}):
        m = BlockModel.from_geometry(spark, Geometry.create(block_size=(1, 1, 1), shape=(40, 40, 2), **turned))
        want = spatial.flag_polygon(m, polygon, "a", outside="rim").select("block_id", "a")
        monkeypatch.setattr(spatial, "UNROLLED", 3)
        got = spatial.flag_polygon(m, polygon, "a", outside="rim").select("block_id", "a")
        monkeypatch.undo()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert want.where("a = 'pit'").count() > 100


def test_rings_that_cross_themselves():
    assert spatial._crosses_itself([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert not spatial._crosses_itself([(math.cos(t / 500 * math.pi), math.sin(t / 500 * math.pi)) for t in range(1000)])
    star = [(math.cos(t * 4 * math.pi / 5), math.sin(t * 4 * math.pi / 5)) for t in range(5)]
    assert spatial._crosses_itself(star)


def test_triangles_cover_few_tiles(spark):
    """A triangle a thousand times as large as the others is in as many tiles as they are."""
    points, faces = [(0.0, 0.0, 0.0), (1000.0, 0.0, 0.0), (0.0, 1000.0, 0.0)], [(0, 1, 2)]
    for n in range(50):
        points += [(n, -5.0, 0.0), (n + 1.0, -5.0, 0.0), (n, -4.0, 0.0)]
        faces.append((3 * n + 3, 3 * n + 4, 3 * n + 5))
    mesh = spatial.Mesh(tuple(points), tuple(faces))
    counts = [r["count"] for r in mesh.table(spark, (0, 1), mesh._tile((0, 1))).groupBy("f").count().collect()]
    assert len(counts) == 51 and max(counts) <= 9


def test_surfaces_by_columns_of_blocks(spark):
    """Only blocks that there are have to lie under the surface; upright and tilted frames agree with a plane."""
    plane = spatial.MeshSurface(spatial.Mesh(((0, 0, 1.5), (6, 0, 1.5), (6, 6, 1.5), (0, 6, 1.5)), ((0, 1, 2), (0, 2, 3))))
    m = BlockModel.from_geometry(spark, Geometry(shape=(12, 6, 3)))
    near = m.with_df(m.df.where("i < 6"))
    assert {(r["k"], round(r["fraction"], 9)) for r in plane.fraction_below(near).collect()} == {(0, 1.0), (1, 0.5), (2, 0.0)}
    with pytest.raises(Exception, match="no triangle"):
        plane.fraction_below(m).collect()


def test_columns_with_too_many_labels_are_no_categories(spark):
    df = spark.createDataFrame([(str(n),) for n in range(50)], "label string")
    assert len(store.category_lists(df, ["label"])["label"]) == 50
    with pytest.raises(ModelError, match="more than 10 labels"):
        store.category_lists(df, ["label"], most=10)


def test_dxf_meshes_and_grids_of_blocks(tmp_path):
    """A MESH entity, INSERT in rows and columns, a block within a block, and one within itself."""
    mesh = ["0", "MESH", "8", "m", "91", 0, "92", 4, "10", 0, "20", 0, "30", 0, "10", 1, "20", 0, "30", 0, "10", 1, "20", 1, "30", 0, "10", 0, "20", 1, "30", 0, "93", 5, "90", 4, "90", 0, "90", 1, "90", 2, "90", 3, "94", 1, "90", 0, "90", 1]

    def drawing(inner):
        block = lambda name, held: ["0", "BLOCK", "2", name, "10", 0, "20", 0, "30", 0, *held, "0", "ENDBLK"]
        blocks = [*block("one", mesh), *block("two", ["0", "INSERT", "8", "0", "2", inner, "10", 5, "20", 0, "30", 2])]
        text = ["0", "SECTION", "2", "BLOCKS", *blocks, "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "INSERT", "8", "top", "2", "two", "10", 0, "20", 0, "30", 0, "70", 3, "71", 2, "44", 10, "45", 20, "0", "ENDSEC", "0", "EOF"]
        path = tmp_path / f"{inner}.dxf"
        path.write_text("\n".join(map(str, [*text, ""])))
        return str(path)

    held = files.dxf_meshes(drawing("one"))["top"]
    assert len(held.faces) == 12 and len(held.vertices) == 24
    assert held.bounds() == ((5.0, 0.0, 2.0), (26.0, 21.0, 2.0))
    with pytest.raises(ModelError, match="holds itself"):
        files.dxf_meshes(drawing("two"))
    with pytest.raises(ModelError, match="no faces"):
        files.dxf_meshes(drawing("one").replace("one", "three") if (tmp_path / "three.dxf").write_text("0\nEOF\n") else "")
