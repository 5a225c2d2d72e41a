"""Checks of models: ids, positions, geometry, spacing; and geometry inferred from coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.geometry import Geometry
from gridloom.functions.worldid import WorldId
from gridloom.operators.model import BlockModel, ModelError, derived_block_id


def block_id_report(df: DataFrame, blocks: int, column: str = "block_id") -> DataFrame:
    """One row: rows, nulls, distinct ids, lowest, highest, and whether the ids are unique and inside the grid."""
    c = F.col(column)
    held = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("ids"), F.min(c).cast("long").alias("lowest"), F.max(c).cast("long").alias("highest"))
    ok = (F.col("nulls") == 0) & (F.col("ids") == F.col("rows")) & ((F.col("rows") == 0) | ((F.col("lowest") >= 0) & (F.col("highest") < blocks)))
    return held.withColumn("valid", ok)


def assert_block_ids(model: BlockModel) -> None:
    if "block_id" not in model.df.columns:
        raise ModelError("block_id is missing")
    said = block_id_report(model.df, model.geometry.blocks).first()
    if not said["valid"]:
        raise ModelError(f"block ids are not unique numbers of the grid: {said.asDict()}")


def validate_sparse(model: BlockModel) -> DataFrame:
    """One row, valid: all ids are distinct blocks of the grid."""
    return block_id_report(model.df, model.geometry.blocks).select("rows", F.lit(model.geometry.blocks).cast("long").alias("dense_rows"), "valid")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def position_mismatches(model: BlockModel, tol: float = 1e-3, sample: int | None = None) -> DataFrame:
    """Rows whose other position columns disagree with block_id: the columns, and which of ijk, xyz, world_id is wrong.

    Stored coordinates are single precision, so the tolerance (in blocks) grows with their size.
    """
    g, df = model.geometry, model.df if sample is None else model.df.orderBy(F.xxhash64("block_id")).limit(sample)
    checks = {}
    ijk = g.ijk()
    if {"i", "j", "k"} <= set(df.columns):
        checks["bad_ijk"] = ~(F.col("i").eqNullSafe(ijk[0]) & F.col("j").eqNullSafe(ijk[1]) & F.col("k").eqNullSafe(ijk[2]))
    if {"x", "y", "z"} <= set(df.columns):
        far = [F.abs(F.col(c).cast("double") - w) > F.lit(tol) * d + F.abs(w) * 1.2e-7 for c, w, d in zip("xyz", g.xyz(*ijk), g.block_size)]
        checks["bad_xyz"] = F.coalesce(far[0] | far[1] | far[2], F.lit(True))
    if "world_id" in df.columns and g.world_id:
        checks["bad_world_id"] = ~F.col("world_id").eqNullSafe(WorldId.from_params(g.world_id).encode(*g.xyz(*ijk)))
    if not checks:
        return df.select("block_id").limit(0)
    # a row of its own for the flags: the filter then reads them, and does not compute them a second time
    out = df.select("block_id", F.inline(F.array(F.struct(*(c.alias(n) for n, c in checks.items())))))
    any_bad = None
    for c in checks:
        any_bad = F.col(c) if any_bad is None else any_bad | F.col(c)
    return out.where(any_bad).select("block_id", *checks)


def id_xyz_mismatches(df: DataFrame, geometry: Geometry, tol: float = 1e-6) -> DataFrame:
    """Rows whose block_id is not the block at their x, y, z: block_id and the id found there (null: none)."""
    at = geometry.block_id_from_xyz(tol=tol, strict=False)
    return df.select(F.col("block_id").cast("int").alias("block_id"), at.alias("found")).where(~F.col("block_id").eqNullSafe(F.col("found")))


def first_mismatch(df: DataFrame, geometry: Geometry) -> None:
    row = id_xyz_mismatches(df, geometry).orderBy("block_id").first()
    if row:
        raise ModelError(f"block {row['block_id']} is not where its coordinates say: {row['found']}")


def geometry_report(df: DataFrame, geometry: Geometry, tol: float = 1e-6) -> DataFrame:
    """One row for any table that says where its blocks are: rows, how many are off the grid, repeated ids, valid."""
    ids = df.select(derived_block_id(df, geometry, tol, strict=False).alias("id"))
    inside = F.when(F.col("id").between(0, geometry.blocks - 1), F.col("id"))
    held = ids.agg(F.count(F.lit(1)).alias("rows"), F.count_if(inside.isNull()).alias("outside"), (F.count(inside) - F.count_distinct(inside)).alias("repeated"))
    return held.withColumn("valid", (F.col("outside") == 0) & (F.col("repeated") == 0))


# spacing and inference


def axis_gaps(df: DataFrame, column: str, decimals: int | None = None) -> DataFrame:
    """Distinct coordinates in order with the gap to the next. An axis has few distinct coordinates, so
    one window over them all is small."""
    c = F.col(column).cast("double") if decimals is None else F.round(F.col(column).cast("double"), decimals)
    values = df.select(c.alias("at")).where("at IS NOT NULL").distinct()
    return values.withColumn("gap", F.lead("at").over(Window.orderBy("at")) - F.col("at"))


def spacing_report(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), tol: float = 1e-8) -> DataFrame:
    """For each axis: column, nulls, distinct, the smallest and largest gap, regular (two coordinates, no nulls, even gaps)."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ModelError(f"missing columns: {lacking}")
    out = None
    for c in columns:
        nulls = df.agg(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("nulls"))
        gaps = axis_gaps(df.where(~F.isnan(F.col(c).cast("double"))), c).agg(F.count(F.lit(1)).alias("distinct"), F.min("gap").alias("least"), F.max("gap").alias("most"))
        one = gaps.join(F.broadcast(nulls)).select(F.lit(c).alias("column"), "nulls", "distinct", "least", "most", ((F.col("nulls") == 0) & (F.col("distinct") >= 2) & (F.col("most") - F.col("least") <= tol)).alias("regular"))
        out = one if out is None else out.unionByName(one)
    return out


def inferred_axes(df: DataFrame, azimuth: float = 0.0, dip: float = 0.0, plunge: float = 0.0, decimals: int = 6) -> DataFrame:
    """For each local axis: axis, first centroid, block size (the smallest gap), n (blocks along it)."""
    turned = Geometry.create(azimuth=azimuth, dip=dip, plunge=plunge)
    local = df.select(*(c.alias(n) for n, c in zip("uvw", turned.to_local())))
    out = None
    for c in "uvw":
        held = axis_gaps(local, c, decimals).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("gap").alias("size"))
        one = held.select(F.lit(c).alias("axis"), "first", "size", (F.rint((F.col("last") - F.col("first")) / F.col("size")) + 1).cast("int").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def infer_geometry(df: DataFrame, azimuth: float = 0.0, dip: float = 0.0, plunge: float = 0.0) -> Geometry:
    rows = {r["axis"]: r for r in inferred_axes(df, azimuth, dip, plunge).collect()}
    if any(r["size"] is None for r in rows.values()):
        raise ModelError("an axis has fewer than two coordinates: its block size cannot be inferred")
    ordered = [rows[c] for c in "uvw"]
    return Geometry.create(tuple(r["first"] - r["size"] / 2 for r in ordered), tuple(r["size"] for r in ordered), tuple(r["n"] for r in ordered), azimuth=azimuth, dip=dip, plunge=plunge)


def mean_and_modal_spacing(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), decimals: int = 9) -> DataFrame:
    """For each axis: the mean gap, and the most frequent one (the lowest of ties)."""
    out = None
    for c in columns:
        gap = F.round("gap", decimals)
        one = axis_gaps(df, c).agg(F.avg("gap").alias("mean_gap"), F.mode(gap, True).alias("modal_gap")).select(F.lit(c).alias("column"), "mean_gap", "modal_gap")
        out = one if out is None else out.unionByName(one)
    return out
