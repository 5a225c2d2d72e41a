"""The block model: a DataFrame of blocks with its geometry and schema. Handles are immutable and lazy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.expressions import present
from gridloom.functions.geometry import Geometry, GeometryError
from gridloom.functions.worldid import WorldId
from gridloom.plans.schema import POSITION_TYPES, POSITIONS, BlockSchema, Engine, SchemaError, attribute_flags, calculate, definitions, persist_plan


class ModelError(ValueError):
    pass


def coerce_positions(df: DataFrame) -> DataFrame:
    """Position columns in their storage types; values that do not fit are an error."""
    there = {c: F.col(c).cast(t) for c, t in POSITION_TYPES.items() if c in df.columns}
    return df.withColumns(there) if there else df


def ordered(columns: Iterable[str]) -> list[str]:
    """Position columns first, the others as they come."""
    columns = list(columns)
    return [c for c in POSITIONS if c in columns] + [c for c in columns if c not in POSITIONS]


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns."""
    floats = {c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(floats) if floats else df


def derived_block_id(df: DataFrame, geometry: Geometry, tol: float = 1e-6, strict: bool = True) -> Column:
    """The block id, from the first of block_id, world_id, x/y/z and i/j/k that df has."""
    have = set(df.columns)
    if "block_id" in have:
        return F.col("block_id").cast("int")
    if "world_id" in have and geometry.world_id:
        x, y, z = WorldId.from_params(geometry.world_id).decode("world_id")
        # ids hold tenths: half a step on each axis, in blocks
        return geometry.block_id_from_xyz(x, y, z, max(tol, max(0.5 / s / d for s, d in zip(WorldId.from_params(geometry.world_id).scale, geometry.block_size)) * 1.01), strict)
    if {"x", "y", "z"} <= have:
        return geometry.block_id_from_xyz(tol=tol, strict=strict)
    if {"i", "j", "k"} <= have:
        return geometry.block_id(strict=strict)
    raise ModelError("no column says where a block is: block_id, world_id, x/y/z or i/j/k")


@dataclass(frozen=True)
class BlockModel:
    df: DataFrame
    geometry: Geometry
    schema: BlockSchema | None = None
    engine: Engine = Engine()
    name: str = "model"
    meta: dict[str, Any] = field(default_factory=dict)

    # where models come from

    @classmethod
    def from_dataframe(cls, df: DataFrame, geometry: Geometry, schema: BlockSchema | None = None, engine: Engine = Engine(), name: str = "model", tol: float = 1e-6) -> BlockModel:
        """A canonical model from rows that say in any way where they are: all positions in storage
        types, NaN as null, the schema's aliases, roundings and required columns applied."""
        df = without_nan(df)
        df = df.withColumn("block_id", derived_block_id(df, geometry, tol))
        df = geometry.with_positions(df)
        encoding = WorldId.from_params(geometry.world_id) if geometry.world_id else WorldId.for_geometry(geometry)
        geometry = replace(geometry, world_id=encoding.to_params())
        df = df.withColumn("world_id", encoding.encode())
        df = persist_plan(df, schema, geometry, engine) if schema else df
        return cls(coerce_positions(df).select(*ordered(df.columns)), geometry, schema, engine, name)

    @classmethod
    def from_geometry(cls, spark: SparkSession, geometry: Geometry, **more) -> BlockModel:
        return cls.from_dataframe(geometry.grid(spark, xyz=False), geometry, **more)

    @classmethod
    def from_sql(cls, spark: SparkSession, text: str, geometry: Geometry, **more) -> BlockModel:
        return cls.from_dataframe(spark.sql(text), geometry, **more)

    def with_schema(self, schema: BlockSchema) -> BlockModel:
        return replace(self, schema=schema)

    def with_engine(self, engine: Engine) -> BlockModel:
        return replace(self, engine=engine)

    def with_df(self, df: DataFrame) -> BlockModel:
        return replace(self, df=df)

    # columns

    @property
    def position_columns(self) -> list[str]:
        return [c for c in POSITIONS if c in self.df.columns]

    @property
    def persisted_columns(self) -> list[str]:
        return self.df.columns

    @property
    def calculated_columns(self) -> list[str]:
        return [c for c in definitions(self.schema, self.geometry) if c not in self.df.columns]

    @property
    def available_columns(self) -> list[str]:
        return [*self.persisted_columns, *self.calculated_columns]

    @property
    def attributes(self) -> list[str]:
        flags = attribute_flags(self.schema, self.geometry, self.df.columns)
        return [c for c in self.available_columns if flags[c]]

    def select(self, columns: Iterable[str] | None = None, index: str | None = "xyz", dense: bool = False, include_calculated: bool = False) -> DataFrame:
        """The index columns (xyz, ijk or none) and the wanted ones, calculated as needed.

        Without ``columns``: the schema's columns first, then the other stored ones, and with
        ``include_calculated`` the calculated ones. ``dense`` adds rows of nulls for absent blocks.
        """
        if index not in ("xyz", "ijk", None):
            raise ModelError("index is xyz, ijk or None")
        if columns is None:
            stored = [c for c in self.df.columns if c not in POSITIONS]
            first = [r.name for r in (self.schema.rules if self.schema else ()) if r.name in stored]
            columns = [*first, *(c for c in stored if c not in first)] + (self.calculated_columns if include_calculated else [])
        columns = list(columns)
        unknown = [c for c in columns if c not in self.available_columns]
        if unknown:
            raise SchemaError(f"no such columns: {unknown}")
        df = calculate(self.df, self.schema, self.geometry, columns, self.engine)
        df = self.densified(df, columns) if dense else df
        if index is None:
            return df.select(*columns)
        at = "block_id" if "block_id" in df.columns else derived_block_id(df, self.geometry)
        ijk = self.geometry.ijk(at)
        place = dict(zip("xyz", self.geometry.xyz(*ijk)) if index == "xyz" else zip("ijk", ijk))
        return df.select(*(c.alias(n) for n, c in place.items()), *(c for c in columns if c not in place))

    def densified(self, df: DataFrame | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """Every block of the grid, joined on its id; nulls where the model has none."""
        df = self.df if df is None else df
        keep = [c for c in (columns or df.columns) if c not in POSITIONS]
        grid = self.geometry.grid(df.sparkSession)
        return grid.join(df.select(F.col("block_id").cast("int").alias("block_id"), *keep), "block_id", "left")

    # filters

    def where(self, condition: Column | str) -> BlockModel:
        return self.with_df(self.df.where(condition))

    def where_at_least(self, column: str, threshold: float) -> BlockModel:
        """Values of at least the threshold; null and NaN never pass."""
        c = F.col(column)
        return self.where(present(c) & (c >= threshold))

    def where_between(self, column: str, low: float, high: float) -> BlockModel:
        """Values in the closed range; bounds in the wrong order are swapped."""
        low, high = min(low, high), max(low, high)
        c = F.col(column)
        return self.where(present(c) & c.between(low, high))

    def where_in(self, column: str, values: Iterable) -> BlockModel:
        """Values among those given; none given: no rows."""
        values = list(values)
        return self.where(F.col(column).isin(values) if values else F.lit(False))

    def where_bbox(self, low: tuple[float, float, float], high: tuple[float, float, float]) -> BlockModel:
        """Blocks whose centroid lies in the closed box. For grids that are not turned the box becomes a
        range of i, and so of block_id, by which files sorted by id are pruned."""
        g = self.geometry
        xyz = g.xyz_of()
        inside = None
        for c, a, b in zip(xyz, low, high):
            one = c.between(a, b)
            inside = one if inside is None else inside & one
        if not g.rotated:
            first = (low[0] - g.origin[0] - g.corner[0]) / g.block_size[0] - 0.5
            last = (high[0] - g.origin[0] - g.corner[0]) / g.block_size[0] - 0.5
            per = g.shape[1] * g.shape[2]
            lo, hi = max(0, int(first) - 1) * per, (min(g.shape[0] - 1, int(last) + 1) + 1) * per - 1
            inside = F.col("block_id").between(lo, hi) & inside
        return self.where(inside)

    def bounds_of(self, column: str) -> DataFrame:
        """low, high and step (a 200th of the range, of 1 at least) of the finite values."""
        c = F.col(column).cast("double")
        held = self.df.where(present(c) & (F.abs(c) != float("inf"))).agg(F.min(c).alias("low"), F.max(c).alias("high"))
        return held.select("low", "high", (F.greatest(F.col("high") - F.col("low"), F.lit(1.0)) / 200).alias("step"))

    def block(self, block_id: int) -> DataFrame:
        return self.df.where(F.col("block_id") == block_id)

    def nearest(self, x: float, y: float, z: float) -> DataFrame:
        """The block whose centroid is nearest; ties to the smallest id."""
        cx, cy, cz = self.geometry.xyz_of()
        d2 = (cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)
        return self.df.withColumn("distance2", d2).orderBy("distance2", "block_id").limit(1)

    # joins

    def merge(self, payload: DataFrame, keys: Iterable[str] | None = None) -> BlockModel:
        """New columns by key (block_id, else ijk, else xyz). Columns that exist and repeated keys are
        errors; x, y, z are turned into block ids first, so no floating-point value is a join key."""
        have = set(payload.columns)
        keys = list(keys or (["block_id"] if "block_id" in have else ["i", "j", "k"] if {"i", "j", "k"} <= have else ["x", "y", "z"]))
        new = [c for c in payload.columns if c not in keys and c not in POSITIONS]
        taken = [c for c in new if c in self.df.columns]
        if taken:
            raise ModelError(f"columns exist already: {taken}")
        if set(keys) & {"x", "y", "z", "i", "j", "k"}:
            payload = payload.withColumn("block_id", derived_block_id(payload.select(*keys, *new), self.geometry))
            keys = ["block_id"]
        if payload.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ModelError("the payload's keys repeat")
        return self.with_df(self.df.join(payload.select(*keys, *new), keys, "left"))

    def join_on_world_id(self, other: BlockModel, how: str = "inner") -> DataFrame:
        """Blocks of two models at the same place; both must use one encoding and one reference system."""
        if self.geometry.srs != other.geometry.srs or self.geometry.world_id != other.geometry.world_id:
            raise ModelError("the models' world ids are not comparable")
        right = other.df.select("world_id", *(F.col(c).alias(c if c not in self.df.columns else f"{c}_right") for c in other.df.columns if c not in POSITIONS))
        return self.df.join(right, "world_id", how)

    def union(self, other: BlockModel, source: str = "model") -> DataFrame:
        """Rows of both, with the model's name; columns that one lacks are null there."""
        a = self.df.withColumn(source, F.lit(self.name))
        return a.unionByName(other.df.withColumn(source, F.lit(other.name)), allowMissingColumns=True)

    def missing_blocks(self) -> DataFrame:
        return self.geometry.grid(self.df.sparkSession).join(self.df.select(F.col("block_id").cast("int").alias("block_id")), "block_id", "left_anti")

    # numbers

    def count(self) -> int:
        return self.meta.get("rows") or self.df.count()

    @property
    def is_sparse(self) -> bool:
        return self.count() < self.geometry.blocks

    @property
    def sparsity(self) -> float:
        return 1.0 - self.count() / self.geometry.blocks

    def sparsity_table(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.df.agg(n.alias("rows"), (n < self.geometry.blocks).alias("is_sparse"), (1.0 - n / float(self.geometry.blocks)).alias("sparsity"))

    def recompute_spatial(self) -> BlockModel:
        return self.with_df(coerce_positions(self.geometry.with_positions(self.df)).select(*ordered([*self.df.columns, *(c for c in "ijkxyz" if c not in self.df.columns)])))

    def recompute_world_id(self) -> BlockModel:
        g = self.geometry if self.geometry.world_id else replace(self.geometry, world_id=WorldId.for_geometry(self.geometry).to_params())
        df = self.df.withColumn("world_id", WorldId.from_params(g.world_id).encode(*g.xyz_of()))
        return replace(self, df=df.select(*ordered(df.columns)), geometry=g)

    def batches(self, rows: int) -> DataFrame:
        """df with ``batch``: the run of ``rows`` block ids that a block is in."""
        return self.df.withColumn("batch", F.call_function("div", F.col("block_id").cast("long"), F.lit(rows).cast("long")))

    def leading(self, rows: int) -> DataFrame:
        """The first rows by block id."""
        return self.df.orderBy("block_id").limit(rows)

    def sampled(self, share: float) -> DataFrame:
        """About that share of the blocks, the same ones whenever and wherever it is asked: by a digest of the id."""
        if not 0 <= share <= 1:
            raise ModelError("a share is between 0 and 1")
        if share == 1:
            return self.df
        return self.df.where(F.md5(F.col("block_id").cast("string").cast("binary")) < F.lit(f"{int(share * 2**32):08x}"))

    def kinds_of_columns(self) -> dict[str, str]:
        """position, attribute, or calculated: those that are not stored."""
        return {c: "position" if c in POSITIONS else "stored" if c in self.df.columns else "calculated" for c in self.available_columns}

    def canonical_order(self) -> DataFrame:
        return self.df.orderBy("block_id")

    def grid_order(self) -> DataFrame:
        """Rows with x fastest, then y, then z."""
        return self.df.orderBy("z", "y", "x")


def check_geometry(a: Geometry, b: Geometry) -> None:
    if a != b:
        raise GeometryError("the geometries differ")
