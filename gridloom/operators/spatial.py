"""Flags and fractions of blocks by polygons, surfaces and solids.

Rings, meshes and rasters are small tables of known size. A polygon of up to
``UNROLLED`` edges is one Column expression over literals. More edges, cells and
triangles are joined: edges are met through bands of y, triangles through tiles
as large as themselves, so a block sees only those near its own place. Where
the frame is upright this is done once for each column of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry, Vector
from gridloom.operators.model import BlockModel, ModelError

Ring = Sequence[tuple[float, float]]
UNROLLED = 500


def _area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


@dataclass(frozen=True)
class Polygon:
    """Parts of rings, the first of a part its outside, the rest holes. Points on an edge are inside."""

    parts: tuple[tuple[tuple[tuple[float, float], ...], ...], ...]
    name: str | None = None

    def __post_init__(self):
        clean = []
        for part in self.parts:
            rings = []
            for ring in part:
                ring = tuple((float(x), float(y)) for x, y in ring)
                ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
                if len(ring) < 3 or _area(ring) == 0 or not all(math.isfinite(c) for p in ring for c in p):
                    raise ModelError("a ring needs three points that are not on one line")
                if _crosses_itself(ring):
                    raise ModelError("a ring crosses itself")
                rings.append(ring)
            clean.append(tuple(rings))
        if not any(clean):
            raise ModelError("the polygon is empty")
        object.__setattr__(self, "parts", tuple(clean))

    @classmethod
    def box(cls, x0: float, y0: float, x1: float, y1: float, name: str | None = None) -> Polygon:
        return cls((((((x0, y0)), (x1, y0), (x1, y1), (x0, y1)),),), name)

    @property
    def edges(self) -> list[tuple[int, float, float, float, float]]:
        return [(n, *a, *b) for n, part in enumerate(self.parts) for ring in part for a, b in zip(ring, (*ring[1:], ring[0]))]

    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(p for part in self.parts for p in part[0]))
        return min(xs), min(ys), max(xs), max(ys)

    def contains(self, x: Column, y: Column) -> Column:
        """Crossing number by part, or on an edge; behind a bounding box test."""
        x0, y0, x1, y1 = self.bounds()
        box = x.between(x0, x1) & y.between(y0, y1)
        found = None
        for part in self.parts:
            odd, on = F.lit(0), F.lit(False)
            for ring in part:
                table = F.array(*(F.struct(F.lit(a[0]).alias("x0"), F.lit(a[1]).alias("y0"), F.lit(b[0]).alias("x1"), F.lit(b[1]).alias("y1")) for a, b in zip(ring, (*ring[1:], ring[0]))))
                if len(ring) <= 32:
                    for a, b in zip(ring, (*ring[1:], ring[0])):
                        odd = odd + self._crossing(x, y, *map(F.lit, (*a, *b))).cast("int")
                        on = on | self._on_edge(x, y, *map(F.lit, (*a, *b)))
                else:
                    odd = odd + F.size(F.filter(table, lambda e: self._crossing(x, y, e["x0"], e["y0"], e["x1"], e["y1"])))
                    on = on | F.exists(table, lambda e: self._on_edge(x, y, e["x0"], e["y0"], e["x1"], e["y1"]))
            one = (odd % 2 == 1) | on
            found = one if found is None else found | one
        return F.coalesce(box & found, F.lit(False))

    def inside_keys(self, points: DataFrame, key: str) -> DataFrame:
        """``key`` of the points (key, x, y) inside: each meets the edges in its band of y alone."""
        low, high = self.bounds()[1], self.bounds()[3]
        band = max((high - low) / max(1, len(self.edges)) * 4, 1e-9)
        edges = points.sparkSession.createDataFrame(self.edges, "part int, x0 double, y0 double, x1 double, y1 double")
        at = lambda y: F.floor((y - low) / band)
        edges = edges.select("*", F.explode(F.sequence(at(F.least("y0", "y1") - 1e-9), at(F.greatest("y0", "y1") + 1e-9))).alias("band"))
        x, y = F.col("x"), F.col("y")
        x0, _, x1, _ = self.bounds()
        met = points.where(x.between(x0, x1) & y.between(low, high)).withColumn("band", at(y)).join(edges, "band")
        line = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
        met = met.groupBy(key, "part").agg(F.count_if(self._crossing(x, y, *line)).alias("n"), F.max(self._on_edge(x, y, *line).cast("int")).alias("on"))
        return met.where("n % 2 = 1 OR on = 1").select(key).distinct()

    @staticmethod
    def _crossing(x, y, x0, y0, x1, y1) -> Column:
        return ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * F.try_divide(y - y0, y1 - y0) + x0)

    @staticmethod
    def _on_edge(x, y, x0, y0, x1, y1) -> Column:
        cross = (x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)
        return (F.abs(cross) <= 1e-9) & x.between(F.least(x0, x1), F.greatest(x0, x1)) & y.between(F.least(y0, y1), F.greatest(y0, y1))


def _crosses_itself(ring: Ring) -> bool:
    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    edges = list(zip(ring, (*ring[1:], ring[0])))
    order = sorted(range(len(edges)), key=lambda n: min(p[0] for p in edges[n]))
    for at, n in enumerate(order):
        a, b = edges[n]
        for m in order[at + 1 :]:
            c, d = edges[m]
            if min(c[0], d[0]) > max(a[0], b[0]):  # and so for all that follow
                break
            if (n - m) % len(edges) in (1, len(edges) - 1):
                continue
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


# surfaces


def _below(z: Column, surface: Column, geometry: Geometry) -> Column:
    """The fraction of a block's height below the surface."""
    h = geometry.half_height()
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (surface - (z - h)) / (2 * h)))


#: Cells of a raster that the driver turns into rows at a time.
CELLS = 100_000


@dataclass(frozen=True)
class Raster:
    """Heights on a rectangular grid of strictly monotonic axes; values[y][x]."""

    xs: tuple[float, ...]
    ys: tuple[float, ...]
    values: tuple[tuple[float, ...], ...]
    name: str | None = None

    def __post_init__(self):
        xs, ys, values = [*map(float, self.xs)], [*map(float, self.ys)], [[*map(float, r)] for r in self.values]
        if len(xs) < 2 or len(ys) < 2 or len(values) != len(ys) or any(len(r) != len(xs) for r in values):
            raise ModelError("a raster needs two coordinates on each axis and a value for each pair")
        if not all(map(math.isfinite, [*xs, *ys, *(v for r in values for v in r)])):
            raise ModelError("a raster must be finite")
        if xs[0] > xs[-1]:
            xs, values = xs[::-1], [r[::-1] for r in values]
        if ys[0] > ys[-1]:
            ys, values = ys[::-1], values[::-1]
        if any(a >= b for s in (xs, ys) for a, b in zip(s, s[1:])):
            raise ModelError("raster axes must be strictly monotonic")
        object.__setattr__(self, "xs", tuple(xs))
        object.__setattr__(self, "ys", tuple(ys))
        object.__setattr__(self, "values", tuple(map(tuple, values)))

    def cells(self, spark: SparkSession) -> DataFrame:
        """A row for each cell: its place, ends and corners. The driver makes CELLS at a time; more go through files."""
        import numpy as np
        import pyarrow as pa

        from gridloom.sources import store

        ddl = "cx int, cy int, x0 double, x1 double, y0 double, y1 double, z00 double, z10 double, z01 double, z11 double"
        names = [c.split()[0] for c in ddl.split(", ")]
        xs, ys, z, wide = np.array(self.xs), np.array(self.ys), np.array(self.values), len(self.xs) - 1
        total = wide * (len(ys) - 1)

        def made(start: int) -> list:
            cy, cx = np.divmod(np.arange(start, min(start + CELLS, total)), wide)
            return [cx.astype(np.int32), cy.astype(np.int32), xs[cx], xs[cx + 1], ys[cy], ys[cy + 1], z[cy, cx], z[cy, cx + 1], z[cy + 1, cx], z[cy + 1, cx + 1]]

        if total <= CELLS:
            return spark.createDataFrame(list(zip(*(c.tolist() for c in made(0)))), ddl)
        held = store.Upload(spark, ddl)
        for start in range(0, total, CELLS):
            held.add(pa.table(made(start), names=names))
        return held.table()

    @staticmethod
    def _cell(c: Column, axis: tuple[float, ...]) -> Column:
        """Which cell of the axis a coordinate falls in: by arithmetic on even axes, else by counting edges."""
        step = (axis[-1] - axis[0]) / (len(axis) - 1)
        if all(abs(a - (axis[0] + n * step)) <= 1e-9 * max(1.0, abs(a)) for n, a in enumerate(axis)):
            at = F.floor((c - axis[0]) / step + 1e-9)
        else:
            at = F.size(F.filter(F.array(*map(F.lit, axis)), lambda e: e <= c)) - 1
        return F.least(F.greatest(at, F.lit(0)), F.lit(len(axis) - 2)).cast("int")

    def heights(self, df: DataFrame, x: Column, y: Column, out: str = "surface_z") -> DataFrame:
        """df with the bilinear height at x, y; a point outside the raster is an error."""
        inside = x.between(self.xs[0], self.xs[-1]) & y.between(self.ys[0], self.ys[-1])
        cell = lambda c, axis: F.when(inside, self._cell(c, axis)).otherwise(F.raise_error(F.lit("point outside the raster")).cast("int"))
        met = df.withColumns({"_x": x, "_y": y, "cx": cell(x, self.xs), "cy": cell(y, self.ys)}).join(self.cells(df.sparkSession), ["cx", "cy"], "left")
        tx, ty = (F.col("_x") - F.col("x0")) / (F.col("x1") - F.col("x0")), (F.col("_y") - F.col("y0")) / (F.col("y1") - F.col("y0"))
        z = (1 - tx) * (1 - ty) * F.col("z00") + tx * (1 - ty) * F.col("z10") + (1 - tx) * ty * F.col("z01") + tx * ty * F.col("z11")
        return met.select(*df.columns, z.alias(out))

    def fraction_below(self, model: BlockModel, out: str = "fraction") -> DataFrame:
        x, y, z = model.geometry.xyz_of()
        met = self.heights(model.df.withColumn("_zc", z), x, y, "_surface")
        return met.withColumn(out, _below(F.col("_zc"), F.col("_surface"), model.geometry)).drop("_zc", "_surface")


@dataclass(frozen=True)
class Mesh:
    """Vertices and triangles."""

    vertices: tuple[Vector, ...]
    faces: tuple[tuple[int, int, int], ...]
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "vertices", tuple(tuple(map(float, v)) for v in self.vertices))
        object.__setattr__(self, "faces", tuple(tuple(map(int, f)) for f in self.faces))
        if not self.faces or any(len(f) != 3 or not all(0 <= v < len(self.vertices) for v in f) for f in self.faces):
            raise ModelError("a mesh needs triangles of its vertices")

    def triangles(self) -> list[tuple[Vector, Vector, Vector]]:
        return [tuple(self.vertices[v] for v in f) for f in self.faces]

    def bounds(self) -> tuple[Vector, Vector]:
        used = list(zip(*(self.vertices[v] for f in self.faces for v in f)))
        return tuple(map(min, used)), tuple(map(max, used))

    def open_edges(self) -> list[tuple[int, int]]:
        """Undirected edges that do not have exactly two faces."""
        from collections import Counter

        counts = Counter(tuple(sorted(e)) for f in self.faces for e in zip(f, (*f[1:], f[0])))
        return sorted(e for e, n in counts.items() if n != 2)

    def table(self, spark: SparkSession, axes: tuple[int, int], tile: float) -> DataFrame:
        """Each triangle once for each tile that its box covers on two axes, of the tiles of its level: twice as
        large from level to level, so a triangle covers nine tiles at most, whatever the others' size."""
        rows = [(n, self._level(t, axes, tile), *(c for p in t for c in p), *(min(p[a] for p in t) for a in axes), *(max(p[a] for p in t) for a in axes)) for n, t in enumerate(self.triangles())]
        names = "f int, level int, " + ", ".join(f"{c}{n} double" for n in range(3) for c in "xyz") + ", u0 double, v0 double, u1 double, v1 double"
        flat = spark.createDataFrame(rows, names)
        size = F.lit(tile) * F.pow(F.lit(2.0), F.col("level"))
        tiles = lambda a, b: F.sequence(F.floor((F.col(a) - 1e-9) / size), F.floor((F.col(b) + 1e-9) / size))
        return flat.withColumn("tu", F.explode(tiles("u0", "u1"))).withColumn("tv", F.explode(tiles("v0", "v1")))

    @staticmethod
    def _span(t: tuple[Vector, Vector, Vector], axes: tuple[int, int]) -> float:
        return max(max(p[a] for p in t) - min(p[a] for p in t) for a in axes)

    def _level(self, t: tuple[Vector, Vector, Vector], axes: tuple[int, int], tile: float) -> int:
        return max(0, math.ceil(math.log2(max(self._span(t, axes), 1e-9) / tile)))

    def _tile(self, axes: tuple[int, int]) -> float:
        """The tile of level 0: as large as most triangles."""
        spans = sorted(self._span(t, axes) for t in self.triangles())
        return max(spans[len(spans) // 2], 1e-9)

    def tiled(self, points: DataFrame, axes: tuple[int, int], tile: float, u: str, v: str) -> DataFrame:
        """points with the tile of each level that there are triangles of."""
        levels = sorted({self._level(t, axes, tile) for t in self.triangles()})
        size = F.lit(tile) * F.pow(F.lit(2.0), F.col("level"))
        out = points.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        return out.withColumns({"tu": F.floor(F.col(u) / size), "tv": F.floor(F.col(v) / size)})


@dataclass(frozen=True)
class MeshSurface:
    mesh: Mesh

    def __post_init__(self):
        for a, b, c in self.mesh.triangles():
            if abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) <= 1e-12:
                raise ModelError("a triangle is upright: the surface has no single height there")

    def heights(self, df: DataFrame, key: str, x: Column, y: Column, out: str = "surface_z", tol: float = 1e-9) -> DataFrame:
        """df with the height at x, y; points under no triangle, or under two heights, are an error."""
        hits = self._hits(df.select(F.col(key).alias("_key"), x.alias("px"), y.alias("py")), tol)
        return self._joined(df, df[key], hits, out)

    def _hits(self, points: DataFrame, tol: float = 1e-9) -> DataFrame:
        """_key, and the lowest and highest point of the mesh at px, py."""
        tile = self.mesh._tile((0, 1))
        c = F.col
        met = self.mesh.tiled(points, (0, 1), tile, "px", "py").join(self.mesh.table(points.sparkSession, (0, 1), tile), ["level", "tu", "tv"])
        d = (c("y1") - c("y2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("y0") - c("y2"))
        a = ((c("y1") - c("y2")) * (c("px") - c("x2")) + (c("x2") - c("x1")) * (c("py") - c("y2"))) / d
        b = ((c("y2") - c("y0")) * (c("px") - c("x2")) + (c("x0") - c("x2")) * (c("py") - c("y2"))) / d
        z = a * c("z0") + b * c("z1") + (1 - a - b) * c("z2")
        return met.where((a >= -tol) & (b >= -tol) & (1 - a - b >= -tol)).groupBy("_key").agg(F.min(z).alias("_lo"), F.max(z).alias("_hi"))

    @staticmethod
    def _joined(df: DataFrame, key: Column, hits: DataFrame, out: str) -> DataFrame:
        c = F.col
        joined = df.join(hits, key == hits["_key"], "left")
        said = F.when(c("_lo").isNull(), F.raise_error(F.lit("point under no triangle of the surface")).cast("double")).when(c("_hi") - c("_lo") > 1e-6, F.raise_error(F.lit("the surface has several heights at a point")).cast("double")).otherwise(c("_lo"))
        return joined.select(*df.columns, said.alias(out))

    def fraction_below(self, model: BlockModel, out: str = "fraction") -> DataFrame:
        x, y, z = model.geometry.xyz_of()
        if model.geometry.upright:
            hits = self._hits(model.geometry.columns(model.df.sparkSession).select(F.col("_column").alias("_key"), F.col("x").alias("px"), F.col("y").alias("py")))
            met = self._joined(model.df, model.geometry.column(), hits, "_surface")
        else:
            met = self.heights(model.df, "block_id", x, y, "_surface")
        return met.withColumn(out, _below(model.geometry.xyz_of()[2], F.col("_surface"), model.geometry)).drop("_surface")


@dataclass(frozen=True)
class Solid:
    """A closed mesh. Points on its surface are inside."""

    mesh: Mesh

    def __post_init__(self):
        if self.mesh.open_edges():
            raise ModelError("the solid is not closed: some edges don't have two faces")

    @property
    def name(self) -> str | None:
        return self.mesh.name

    #: A direction that no edge or face of ordinary models is parallel to, for the rays.
    RAY = (1.0, 0.0009137734, 0.0004271828)

    def inside_ids(self, model: BlockModel, tol: float = 1e-9) -> DataFrame:
        """block_id of the blocks whose centroid is inside: within the box, a ray crosses an odd number of faces or the point lies on one."""
        low, high = self.mesh.bounds()
        x, y, z = model.geometry.xyz_of()
        near = model.df.select("block_id", x.alias("px"), y.alias("py"), z.alias("pz"))
        near = near.where(reduce(lambda p, q: p & q, (F.col(f"p{c}").between(a - tol, b + tol) for c, a, b in zip("xyz", low, high))))
        # sheared so that the ray runs along x: a triangle is met through the tile of its (y, z)
        _, sy, sz = self.RAY
        sheared = Mesh(tuple((v[0], v[1] - sy * v[0], v[2] - sz * v[0]) for v in self.mesh.vertices), self.mesh.faces)
        tile = sheared._tile((1, 2))
        rows = near.withColumns({"qy": F.col("py") - sy * F.col("px"), "qz": F.col("pz") - sz * F.col("px")})
        c = F.col
        met = sheared.tiled(rows, (1, 2), tile, "qy", "qz").join(sheared.table(model.df.sparkSession, (1, 2), tile), ["level", "tu", "tv"])
        d = (c("z1") - c("z2")) * (c("y0") - c("y2")) + (c("y2") - c("y1")) * (c("z0") - c("z2"))
        a = F.try_divide((c("z1") - c("z2")) * (c("qy") - c("y2")) + (c("y2") - c("y1")) * (c("qz") - c("z2")), d)
        b = F.try_divide((c("z2") - c("z0")) * (c("qy") - c("y2")) + (c("y0") - c("y2")) * (c("qz") - c("z2")), d)
        at = a * c("x0") + b * c("x1") + (1 - a - b) * c("x2")
        hit = (a >= -1e-12) & (b >= -1e-12) & (1 - a - b >= -1e-12)
        ahead = F.count_if(hit & (at > c("px") + tol))
        touched = F.max((hit & (F.abs(at - c("px")) <= tol)).cast("int"))
        return met.groupBy("block_id").agg(ahead.alias("n"), touched.alias("on")).where("n % 2 = 1 OR on = 1").select("block_id")


def flag_polygon(model: BlockModel, polygon: Polygon, column: str = "inside", inside: object = None, outside: object = None) -> DataFrame:
    label = inside if inside is not None else polygon.name
    x, y, _ = model.geometry.xyz_of()
    if len(polygon.edges) <= UNROLLED:
        return model.df.withColumn(column, labelled(polygon.contains(x, y), label, outside))
    if model.geometry.upright:
        key, points = model.geometry.column(), model.geometry.columns(model.df.sparkSession).withColumnRenamed("_column", "_key")
    else:
        key, points = F.col("block_id"), model.df.select(F.col("block_id").alias("_key"), x.alias("x"), y.alias("y"))
    found = polygon.inside_keys(points, "_key").withColumn("_in", F.lit(True))
    joined = model.df.join(found, key == found["_key"], "left")
    return joined.withColumn(column, labelled(F.coalesce("_in", F.lit(False)), label, outside)).drop("_key", "_in")


def gather(model: BlockModel, values: DataFrame, column: str, default: object = None) -> DataFrame:
    """The model's table with ``column`` of a table by block_id; ``default`` where that has no such block."""
    joined = model.df.join(values.select("block_id", F.col(column).alias("_value")), "block_id", "left")
    return joined.withColumn(column, F.coalesce(F.col("_value"), F.lit(default)) if default is not None else F.col("_value")).drop("_value")


def flag_solid(model: BlockModel, solid: Solid, column: str = "inside", inside: object = None, outside: object = None) -> DataFrame:
    found = gather(model, solid.inside_ids(model).withColumn("_in", F.lit(True)), "_in", False)
    return found.withColumn(column, labelled(F.col("_in"), inside if inside is not None else solid.name, outside)).drop("_in")


def labelled(mask: Column, inside: object = None, outside: object = None) -> Column:
    """The label inside (a value, else True), and outside the other (null by default). Two booleans stay
    booleans, everything else is text."""
    inside = True if inside is None else inside
    if isinstance(inside, bool) and (outside is None or isinstance(outside, bool)):
        return F.when(mask, F.lit(inside)).otherwise(F.lit(outside).cast("boolean"))
    return F.when(mask, F.lit(str(inside))).otherwise(F.lit(None if outside is None else str(outside)).cast("string"))
