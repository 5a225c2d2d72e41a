"""Generated models: a demo with depths, and a toy deposit."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry, rotate
from gridloom.operators.model import BlockModel


def ellipsoid_grade(x: Column, y: Column, z: Column, center: tuple[float, float, float], radii: tuple[float, float, float], grade_min: float = 5.0, grade_max: float = 65.0, bearing: float = 0.0, dip: float = 0.0, plunge: float = 0.0) -> Column:
    """From grade_max in the centre of an ellipsoid to grade_min at its surface, and grade_min outside."""
    d = [p - F.lit(c) for p, c in zip((x, y, z), center)]
    if bearing or dip or plunge:
        d = rotate(*d, bearing, dip, plunge)
    norm = None
    for c, r in zip(d, radii):
        part = F.pow(c / F.lit(r), 2)
        norm = part if norm is None else norm + part
    return F.when(norm <= 1, F.lit(grade_max) - F.lit(grade_max - grade_min) * F.sqrt(norm)).otherwise(F.lit(grade_min))


def demo(spark: SparkSession, geometry: Geometry) -> BlockModel:
    """Every block with its depth below the top of the grid, and the shallow and the deep half."""
    grid = geometry.grid(spark)
    top = max(c[2] for c in geometry.corners())
    low = min(c[2] for c in geometry.corners())
    half = geometry.half_height()
    depth = F.lit(top) - F.col("z")
    first, last = half, top - low - half
    mid = (first + last) / 2
    return BlockModel(grid.withColumns({"depth": depth, "depth_category": F.when(depth <= F.lit(mid), "shallow").otherwise("deep")}), geometry, name="demo")


def toy(spark: SparkSession, geometry: Geometry = Geometry(shape=(20, 15, 10)), bearing: float = 20.0, dip: float = 30.0, plunge: float = 10.0, name: str = "grade", grade_min: float = 50.0, grade_max: float = 65.0, center=(10.0, 7.5, 5.0), radii=(8.0, 5.0, 3.0), noise_std: float = 0.0, noise_rel: float | None = None, seed: int | None = None) -> BlockModel:
    """A demo model with an ellipsoid of grade, and normal noise: absolute, or relative to the grade."""
    made = demo(spark, geometry)
    grade = ellipsoid_grade(F.col("x"), F.col("y"), F.col("z"), center, radii, grade_min, grade_max, bearing, dip, plunge)
    if noise_rel:
        grade = grade * (1 + F.randn(seed) * noise_rel)
    elif noise_std:
        grade = grade + F.randn(seed) * noise_std
    return made.with_df(made.df.withColumn(name, grade))
