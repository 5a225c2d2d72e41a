"""Surfaces over time, as rows (time, x, y, value): generators, differences, nearest selections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.expressions import to_column


def _times(spark: SparkSession, times: Sequence[datetime], **more: Sequence[float]) -> DataFrame:
    """step (from 0), time and other values by step: as many rows as time steps."""
    names = ", ".join(f"{n} double" for n in more)
    rows = [(n, t, *(float(v[n]) for v in more.values())) for n, t in enumerate(times)]
    return spark.createDataFrame(rows, f"step int, time timestamp{', ' + names if names else ''}")


def _even(first: float, last: float, n: int, at: Column) -> Column:
    return F.lit(first) + at * F.lit((last - first) / max(n - 1, 1))


def plane(spark: SparkSession, x_range: tuple[float, float], y_range: tuple[float, float], n: int) -> DataFrame:
    """n * n even points: ix, iy, x, y."""
    ids = spark.range(n * n).select((F.col("id") % n).cast("int").alias("ix"), F.call_function("div", F.col("id"), F.lit(n).cast("long")).cast("int").alias("iy"))
    return ids.select("ix", "iy", _even(*x_range, n, F.col("ix")).alias("x"), _even(*y_range, n, F.col("iy")).alias("y"))


def depletion(spark: SparkSession, times: Sequence[datetime], x_range, y_range, n: int, a: float, b: float, max_depth: float, center=(0.0, 0.0), delay_edges: bool = False) -> DataFrame:
    """time, x, y, value: an elliptical bowl that sinks ever slower to max_depth; with delay_edges its edge follows later."""
    steps = len(times)
    depth = [max_depth * (1 - math.exp(-3 * (t + 1) / steps)) / (1 - math.exp(-3)) for t in range(steps)]
    r = (F.pow(F.col("x") - center[0], 2) / a**2) + (F.pow(F.col("y") - center[1], 2) / b**2)
    value = -F.col("depth") * (1 - r)
    if delay_edges:
        value = value * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), r - 0.5)))
    points = plane(spark, x_range, y_range, n).crossJoin(F.broadcast(_times(spark, times, depth=depth)))
    return points.select("time", "x", "y", F.when(r > 1, 0.0).otherwise(value).alias("value"))


def volumes(surfaces: DataFrame) -> DataFrame:
    """The positive sum of each time's values."""
    return surfaces.groupBy("time").agg(F.sum(-F.col("value")).alias("volume"))


def dump_shape(volume: float, angle: float = 38.0) -> tuple[float, float, float]:
    """Flat radius, height and base radius of a frustum of that volume: the height is half the flat radius,
    so the volume is a cube of the radius times a constant."""
    tan = math.tan(math.radians(angle))
    c = math.pi / 2 + math.pi / 6 * ((1 + 1 / (2 * tan)) ** 2 - 1)
    r = (volume / c) ** (1 / 3)
    return r, r / 2, r + r / 2 / tan


def waste_dumps(spark: SparkSession, dump_volumes: Sequence[float], times: Sequence[datetime], center: tuple[float, float], cell: float = 1.0, angle: float = 38.0) -> DataFrame:
    """time, x, y, value: dumps of these volumes with a flat top and slopes at the angle of repose."""
    if len(dump_volumes) != len(times):
        raise ValueError("a volume for each time")
    shapes = [dump_shape(v, angle) for v in dump_volumes]
    reach = math.ceil(max(s[2] for s in shapes) / cell)
    ranges = [(c - reach * cell, c + reach * cell) for c in center]
    flat, height, base = zip(*shapes)
    points = plane(spark, *ranges, 2 * reach + 1).crossJoin(F.broadcast(_times(spark, times, flat=flat, height=height, base=base)))
    r = F.sqrt(F.pow(F.col("x") - center[0], 2) + F.pow(F.col("y") - center[1], 2))
    slope = F.col("height") - (r - F.col("flat")) * math.tan(math.radians(angle))
    value = F.when(r <= F.col("flat"), F.col("height")).when(r <= F.col("base"), slope).otherwise(0.0)
    return points.select("time", "x", "y", value.alias("value"))


def differences(df: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value", direction: str = "previous") -> DataFrame:
    """The value minus that of the previous (or next) time at the same place; null at the end."""
    if direction not in ("previous", "next"):
        raise ValueError("direction is previous or next")
    w = Window.partitionBy(*keys).orderBy(time)
    other = F.lag(value).over(w) if direction == "previous" else F.lead(value).over(w)
    return df.withColumn("difference", F.col(value) - other)


def between(df: DataFrame, keys: Sequence[str], first, second, time: str = "time", value: str = "value") -> DataFrame:
    """The second time's value minus the first's, by place."""
    pick = lambda t: F.max(F.when(F.col(time) == F.lit(t), F.col(value)))
    return df.groupBy(*keys).agg((pick(second) - pick(first)).alias("difference"))


def at_nearest(df: DataFrame, keys: Sequence[str], target: Column, column: str = "time", value: str = "value") -> DataFrame:
    """By place, the value at the nearest time (or coordinate); of two equally near the earlier."""
    far = F.abs(F.col(column).cast("double") - target.cast("double"))
    picked = F.min_by(F.struct(F.col(column), F.col(value)), F.struct(far, F.col(column)))
    return df.groupBy(*keys).agg(picked.alias("p")).select(*keys, F.col(f"p.{column}").alias(column), F.col(f"p.{value}").alias(value))


def expression(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, to_column(text))
