"""Block models as triangle meshes: vertices and faces as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expressions import missing, present
from gridloom.functions.geometry import right_handed
from gridloom.operators.model import BlockModel, ModelError
from gridloom.plans.schema import POSITIONS, calculate

#: A cube's corners (i, j, k ends), numbered with i fastest, and its sides, each with the
#: step to the neighbour behind it and two triangles wound counter-clockwise from outside.
CORNERS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1))
SIDES = (
    ((0, 0, -1), (0, 2, 1), (1, 2, 3)),
    ((0, 0, 1), (4, 5, 6), (5, 7, 6)),
    ((0, -1, 0), (0, 1, 4), (1, 5, 4)),
    ((0, 1, 0), (2, 6, 3), (3, 6, 7)),
    ((-1, 0, 0), (0, 4, 2), (2, 4, 6)),
    ((1, 0, 0), (1, 3, 5), (3, 7, 5)),
)


@dataclass(frozen=True)
class MeshTables:
    vertices: DataFrame  # vertex_id, block_id, corner, x, y, z, i, j, k, attributes
    faces: DataFrame  # face_id, block_id, v0, v1, v2, i, j, k, attributes
    meta: dict = field(default_factory=dict)


def corner_points(model: BlockModel) -> Column:
    """The eight world corners of a block, as an array of structs."""
    g = model.geometry
    ijk = g.ijk()
    points = []
    for n, ends in enumerate(CORNERS):
        local = [F.lit(c) + (p + F.lit(float(e))) * F.lit(d) for c, p, e, d in zip(g.corner, ijk, ends, g.block_size)]
        points.append(F.struct(F.lit(n).alias("corner"), *(p.alias(a) for a, p in zip("xyz", g.to_world(*local)))))
    return F.array(*points)


def exterior_sides(model: BlockModel, merge: bool = False) -> DataFrame:
    """block_id, i, j, k and side (0 to 5) of the sides behind which the model has no block. With ``merge`` both sides
    of the join are sorted: no list of blocks passes through the driver, which takes longer on small models."""
    g = model.geometry
    ijk = dict(zip("ijk", g.ijk()))
    blocks = model.df.select("block_id", *(c.alias(n) for n, c in ijk.items()))
    steps = F.array(*(F.struct(F.lit(n).alias("side"), *(F.lit(s).alias(f"d{a}") for a, s in zip("ijk", step))) for n, (step, _, _) in enumerate(SIDES)))
    sides = blocks.select("*", F.explode(steps).alias("s"))
    sides = sides.withColumn("_behind", g.block_id(*(F.col(a) + F.col(f"s.d{a}") for a in "ijk"), strict=False))
    there = model.df.select(F.col("block_id").cast("int").alias("_behind"))
    return sides.join(there.hint("merge") if merge else there, "_behind", "left_anti").select("block_id", "i", "j", "k", F.col("s.side").alias("side"))


def triangulate(model: BlockModel, attributes: list[str] | None = None, surface_only: bool = True, merge: bool = False) -> MeshTables:
    """8 vertices for each block that shows a face, two triangles for each side; ``surface_only`` leaves
    out sides between two blocks, with joins as ``merge`` says for ``exterior_sides``. Attributes (numbers) ride along on vertices and faces."""
    if not right_handed(*model.geometry.axes):
        raise ModelError("the axes are not right-handed")
    attributes = list(attributes or [])
    bad = [a for a in attributes if a in POSITIONS]
    if bad:
        raise ModelError(f"positions are no attributes: {bad}")
    df = calculate(model.df, model.schema, model.geometry, attributes, model.engine)
    values = [F.col(a).cast("double").alias(a) for a in attributes]
    ijk = [c.alias(n) for n, c in zip("ijk", model.geometry.ijk())]
    blocks = df.select("block_id", *ijk, *values)
    if surface_only:
        sides = exterior_sides(model, merge).select("block_id", "side").join(blocks.hint("merge") if merge else blocks, "block_id")
    else:
        sides = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("side"))
    first = F.col("block_id").cast("long") * 8
    triangles = F.array(*(F.array(*(F.struct(*(F.lit(v).alias(f"v{n}") for n, v in enumerate(t))) for t in (a, b))) for _, a, b in SIDES))
    faces = sides.select("block_id", "i", "j", "k", *attributes, "side", F.posexplode(F.element_at(triangles, F.col("side") + 1)).alias("half", "t"))
    faces = faces.select((F.col("block_id").cast("long") * 12 + F.col("side") * 2 + F.col("half")).alias("face_id"), "block_id", *((first + F.col(f"t.v{n}")).alias(f"v{n}") for n in range(3)), "i", "j", "k", *attributes)
    showing = sides.select("block_id").distinct()
    shown = df.join(showing.hint("merge") if merge else showing, "block_id", "left_semi") if surface_only else df
    vertices = shown.select("block_id", *ijk, *values, F.explode(corner_points(model)).alias("c"))
    vertices = vertices.select((first + F.col("c.corner")).alias("vertex_id"), "block_id", "c.corner", "c.x", "c.y", "c.z", "i", "j", "k", *attributes)
    return MeshTables(vertices, faces, {"shape": list(model.geometry.shape), "surface_only": surface_only})


def validate(mesh: MeshTables) -> DataFrame:
    """One row: vertices, faces and how many face corners name no vertex."""
    used = mesh.faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    loose = used.join(mesh.vertices.select("vertex_id"), "vertex_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    return mesh.vertices.agg(F.count(F.lit(1)).alias("vertices")).join(F.broadcast(mesh.faces.agg(F.count(F.lit(1)).alias("faces")))).join(F.broadcast(loose))


def open_edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (a, b) that do not have exactly two faces, with their number n."""
    edges = faces.select(F.explode(F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("e"))
    return edges.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n <> 2")


def welded(mesh: MeshTables, decimals: int = 6) -> DataFrame:
    """Faces whose corners are vertex positions: blocks' vertices at one place become one."""
    at = mesh.vertices.select("vertex_id", F.xxhash64(*(F.round(c, decimals) for c in "xyz")).alias("p"))
    out = mesh.faces
    for n in range(3):
        out = out.join(at.select(F.col("vertex_id").alias(f"v{n}"), F.col("p").alias(f"p{n}")), f"v{n}").drop(f"v{n}").withColumnRenamed(f"p{n}", f"v{n}")
    return out


def colours(df: DataFrame, attribute: str) -> DataFrame:
    """df with r, g, b, a: the attribute from its least to its largest value as greys; missing ones are transparent."""
    v = missing(F.col(attribute).cast("double"))
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    share = F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.when(v.isNotNull(), 0.0))
    grey = F.coalesce(F.floor(share * 255).cast("int"), F.lit(0))
    joined = df.join(F.broadcast(ends))
    return joined.select(*df.columns, *(grey.alias(c) for c in "rgb"), F.when(present(F.col(attribute)), 255).otherwise(0).alias("a"))


def hexahedra(model: BlockModel) -> DataFrame:
    """block_id, corner and x, y, z of every block's eight nodes."""
    return model.df.select("block_id", F.explode(corner_points(model)).alias("c")).select("block_id", "c.corner", "c.x", "c.y", "c.z")


def grid_table(model: BlockModel, columns: list[str]) -> DataFrame:
    """The dense grid with x fastest: cell (its number in that order), i, j, k and the columns."""
    ni, nj, _ = model.geometry.shape
    cell = (F.col("k").cast("long") * nj + F.col("j")) * ni + F.col("i")
    return model.densified(columns=columns).select(cell.alias("cell"), "i", "j", "k", *columns)
