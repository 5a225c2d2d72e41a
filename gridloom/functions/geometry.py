"""The lattice of a block model and its world frame, as literals and Column expressions.

Block ids count cells with k fastest: ``block_id = (i * nj + j) * nk + k``.
All coordinates are computed in double precision from the id or from i, j, k.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Vector = tuple[float, float, float]
IDENTITY: tuple[Vector, Vector, Vector] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
MOST_BLOCKS = 2**31 - 1
LATTICE, FRAME = ("corner", "block_size", "shape"), ("origin", "axis_u", "axis_v", "axis_w", "srs")


class GeometryError(ValueError):
    pass


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Vector, b: Vector) -> float:
    return sum(x * y for x, y in zip(a, b))


def orthonormal(u: Vector, v: Vector, w: Vector, tol: float = 1e-8) -> bool:
    return all(abs(_dot(a, a) - 1) <= tol for a in (u, v, w)) and all(abs(_dot(a, b)) <= tol for a, b in ((u, v), (u, w), (v, w)))


def right_handed(u: Vector, v: Vector, w: Vector, tol: float = 1e-6) -> bool:
    return _dot(_cross(u, v), w) > 1 - tol


def angles_to_axes(azimuth: float = 0.0, dip: float = 0.0, plunge: float = 0.0) -> tuple[Vector, Vector, Vector]:
    """Axes u, v, w of a frame turned by azimuth and dip, then by plunge about u (degrees)."""
    if not (azimuth or dip or plunge):
        return IDENTITY
    a, d, p = (math.radians(x) for x in (azimuth, dip, plunge))
    u = (math.cos(a), math.sin(a), 0.0)
    v = (-math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), math.sin(d))
    w = _cross(u, v)

    def turned(x: Vector) -> Vector:
        side, along = _cross(u, x), _dot(u, x) * (1 - math.cos(p))
        return tuple(c * math.cos(p) + s * math.sin(p) + k * along for c, s, k in zip(x, side, u))

    return u, turned(v), turned(w)


def axes_to_angles(u: Vector, v: Vector, w: Vector) -> tuple[float, float, float]:
    """Azimuth, dip and plunge of axes; the plunge is not recoverable and comes back as 0."""
    return math.degrees(math.atan2(u[1], u[0])), math.degrees(math.asin(max(-1.0, min(1.0, v[2])))), 0.0


def rotate(x: Column, y: Column, z: Column, azimuth: float = 0.0, dip: float = 0.0, plunge: float = 0.0) -> tuple[Column, Column, Column]:
    """Points in the turned frame: x * u + y * v + z * w."""
    axes = angles_to_axes(azimuth, dip, plunge)
    return tuple(x * u + y * v + z * w for u, v, w in zip(*axes))


@dataclass(frozen=True)
class Geometry:
    """A regular grid: local corner, block size and shape, and the frame that places it in the world."""

    corner: Vector = (0.0, 0.0, 0.0)
    block_size: Vector = (1.0, 1.0, 1.0)
    shape: tuple[int, int, int] = (1, 1, 1)
    origin: Vector = (0.0, 0.0, 0.0)
    axis_u: Vector = IDENTITY[0]
    axis_v: Vector = IDENTITY[1]
    axis_w: Vector = IDENTITY[2]
    srs: str | None = None
    world_id: dict | None = None

    def __post_init__(self):
        for name in ("corner", "block_size", "origin", "axis_u", "axis_v", "axis_w"):
            object.__setattr__(self, name, tuple(float(x) for x in getattr(self, name)))
        object.__setattr__(self, "shape", tuple(int(x) for x in self.shape))
        if any(x <= 0 for x in self.block_size) or any(x < 1 for x in self.shape):
            raise GeometryError("block sizes and shape must be positive")
        if not orthonormal(*self.axes):
            raise GeometryError("the axes are not orthonormal")
        if self.blocks > MOST_BLOCKS:
            raise GeometryError(f"{self.blocks} blocks; ids are 32-bit integers")

    @classmethod
    def create(cls, corner=(0, 0, 0), block_size=(1, 1, 1), shape=(1, 1, 1), origin=(0, 0, 0), azimuth=0.0, dip=0.0, plunge=0.0, srs=None) -> Geometry:
        return cls(corner, block_size, shape, origin, *angles_to_axes(azimuth, dip, plunge), srs)

    @classmethod
    def of(cls, local: dict | None = None, world: dict | None = None, **flat) -> Geometry:
        """From a lattice (corner, block_size, shape) and a frame (origin, axes, srs), either of which may be left out,
        or from the same names side by side; both at once is an error."""
        if flat and (local is not None or world is not None):
            raise GeometryError("a lattice and a frame, or single values: not both")
        if local is not None and not set(local) <= set(LATTICE) or world is not None and not set(world) <= set(FRAME):
            raise GeometryError(f"a lattice has {', '.join(LATTICE)}, a frame {', '.join(FRAME)}")
        return cls(**(local or {}), **(world or {}), **flat)

    @property
    def local(self) -> dict:
        return {n: getattr(self, n) for n in LATTICE}

    @property
    def world(self) -> dict:
        return {n: getattr(self, n) for n in FRAME}

    # what the driver can say at once

    @property
    def axes(self) -> tuple[Vector, Vector, Vector]:
        return self.axis_u, self.axis_v, self.axis_w

    @property
    def blocks(self) -> int:
        return math.prod(self.shape)

    @property
    def volume(self) -> float:
        return math.prod(self.block_size)

    @property
    def rotated(self) -> bool:
        return any(abs(a - b) > 1e-12 for x, y in zip(self.axes, IDENTITY) for a, b in zip(x, y))

    @property
    def upright(self) -> bool:
        """Whether the blocks over each other share x and y."""
        return self.axis_w[0] == 0 and self.axis_w[1] == 0

    def column(self, block_id: str | Column = "block_id") -> Column:
        """The number of the column of blocks (i, j) that a block is in."""
        return F.call_function("div", col(block_id).cast("long"), F.lit(self.shape[2]).cast("long"))

    def columns(self, spark: SparkSession) -> DataFrame:
        """_column, x and y of each column of blocks, without any input; the frame has to be upright."""
        ids = spark.range(self.shape[0] * self.shape[1]).withColumnRenamed("id", "_column")
        x, y, _ = self.xyz_of(F.col("_column") * F.lit(self.shape[2]).cast("long"))
        return ids.select("_column", x.alias("x"), y.alias("y"))

    def world_point(self, p: Vector) -> Vector:
        return tuple(o + p[0] * u + p[1] * v + p[2] * w for o, u, v, w in zip(self.origin, *self.axes))

    def corners(self) -> list[Vector]:
        """The grid's eight corners in the world, the first axis fastest."""
        ends = [(c, c + n * d) for c, n, d in zip(self.corner, self.shape, self.block_size)]
        return [self.world_point((ends[0][a], ends[1][b], ends[2][c])) for c in (0, 1) for b in (0, 1) for a in (0, 1)]

    def bounds(self) -> tuple[Vector, Vector]:
        """Smallest and largest x, y, z of the whole grid."""
        points = list(zip(*self.corners()))
        return tuple(map(min, points)), tuple(map(max, points))

    def half_height(self) -> float:
        """Half of a block's extent along world z."""
        return 0.5 * sum(d * abs(a[2]) for d, a in zip(self.block_size, self.axes))

    def resized(self, block_size: Vector, shape: tuple[int, int, int]) -> Geometry:
        return replace(self, block_size=block_size, shape=shape)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Geometry:
        held = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})

    @classmethod
    def from_payload(cls, held: dict) -> Geometry:
        """From the geometry part of a file's footer."""
        names = ("corner", "block_size", "shape", "origin", "axis_u", "axis_v", "axis_w")
        return cls(**{n: tuple(held[n]) for n in names if n in held}, srs=held.get("srs"), world_id=held.get("world_id_encoding"))

    def to_payload(self) -> dict:
        held = asdict(self)
        held["world_id_encoding"] = held.pop("world_id")
        return {"schema_version": "1.1"} | held

    # columns

    def ijk(self, block_id: str | Column = "block_id") -> tuple[Column, Column, Column]:
        _, nj, nk = self.shape
        b = col(block_id).cast("long")
        div = lambda n: F.call_function("div", b, F.lit(n).cast("long"))
        return div(nj * nk).cast("int"), F.pmod(div(nk), F.lit(nj)).cast("int"), F.pmod(b, F.lit(nk)).cast("int")

    def block_id(self, i="i", j="j", k="k", strict: bool = True) -> Column:
        """The id of (i, j, k); outside the grid an error, or null if not strict."""
        i, j, k = col(i), col(j), col(k)
        inside = i.between(0, self.shape[0] - 1) & j.between(0, self.shape[1] - 1) & k.between(0, self.shape[2] - 1)
        made = ((i.cast("long") * self.shape[1] + j) * self.shape[2] + k).cast("int")
        return F.when(inside, made).otherwise(F.raise_error(F.lit("block index outside the grid")).cast("int") if strict else F.lit(None).cast("int"))

    def uvw(self, i="i", j="j", k="k") -> tuple[Column, Column, Column]:
        """Local centroids."""
        return tuple(F.lit(c) + (col(x) + F.lit(0.5)) * F.lit(d) for c, d, x in zip(self.corner, self.block_size, (i, j, k)))

    def to_world(self, u: Column, v: Column, w: Column) -> tuple[Column, Column, Column]:
        if not self.rotated and self.origin == (0.0, 0.0, 0.0):
            return u, v, w
        return tuple(F.lit(o) + u * F.lit(a) + v * F.lit(b) + w * F.lit(c) for o, a, b, c in zip(self.origin, *self.axes))

    def to_local(self, x="x", y="y", z="z") -> tuple[Column, Column, Column]:
        d = [col(c).cast("double") - F.lit(o) for c, o in zip((x, y, z), self.origin)]
        return tuple(d[0] * F.lit(a[0]) + d[1] * F.lit(a[1]) + d[2] * F.lit(a[2]) for a in self.axes)

    def xyz(self, i="i", j="j", k="k") -> tuple[Column, Column, Column]:
        return self.to_world(*self.uvw(i, j, k))

    def xyz_of(self, block_id="block_id") -> tuple[Column, Column, Column]:
        return self.xyz(*self.ijk(block_id))

    def lattice(self, x="x", y="y", z="z") -> tuple[Column, Column, Column]:
        """Fractional (i, j, k) of world points; whole numbers at centroids."""
        return tuple((p - F.lit(c)) / F.lit(d) - F.lit(0.5) for p, c, d in zip(self.to_local(x, y, z), self.corner, self.block_size))

    def ijk_from_xyz(self, x="x", y="y", z="z", tol: float = 1e-6, strict: bool = True) -> tuple[Column, Column, Column]:
        """Indices of centroids, rounded half to even; points off the lattice or outside the grid are an
        error, or null if not strict."""
        at = self.lattice(x, y, z)
        near = [F.rint(f) for f in at]
        ok = None
        for f, r, n in zip(at, near, self.shape):
            fits = (F.abs(f - r) <= tol) & (r >= 0) & (r <= n - 1)
            ok = fits if ok is None else ok & fits
        bad = F.raise_error(F.lit("point is no block centroid of the grid")).cast("int") if strict else F.lit(None).cast("int")
        return tuple(F.when(ok, r.cast("int")).otherwise(bad) for r in near)

    def block_id_from_xyz(self, x="x", y="y", z="z", tol: float = 1e-6, strict: bool = True) -> Column:
        return self.block_id(*self.ijk_from_xyz(x, y, z, tol, strict), strict=strict)

    def containing_block(self, x: float, y: float, z: float) -> int | None:
        """The id of the block around a world point, by arithmetic alone."""
        d = [p - o for p, o in zip((x, y, z), self.origin)]
        at = [math.floor((_dot(d, a) - c) / s) for a, c, s in zip(self.axes, self.corner, self.block_size)]
        if not all(0 <= i < n for i, n in zip(at, self.shape)):
            return None
        return (at[0] * self.shape[1] + at[1]) * self.shape[2] + at[2]

    # tables

    def grid(self, spark: SparkSession, xyz: bool = True) -> DataFrame:
        """The dense grid: block_id, i, j, k and centroids, without any input."""
        ids = spark.range(self.blocks).select(F.col("id").cast("int").alias("block_id"))
        out = ids.select("block_id", *(c.alias(n) for c, n in zip(self.ijk(), "ijk")))
        return out.select("*", *(c.alias(n) for c, n in zip(self.xyz(), "xyz"))) if xyz else out

    def with_positions(self, df: DataFrame) -> DataFrame:
        """i, j, k, x, y, z computed anew from block_id."""
        df = df.withColumns(dict(zip("ijk", self.ijk())))
        return df.withColumns(dict(zip("xyz", self.xyz())))
