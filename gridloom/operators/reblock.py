"""Reblocking: grouped aggregation to coarser grids, interpolation to finer ones, heatmaps.

Down: children share the parent (i div fx, j div fy, k div fz), one hash
aggregation for all statistics. Up: each fine block asks for the coarse blocks
it lies between; an equi-join on their ids fetches the values.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expressions import missing, present
from gridloom.functions.geometry import Geometry
from gridloom.operators.model import BlockModel, ModelError, coerce_positions, ordered
from gridloom.plans.schema import calculate

INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: What counts as "missing" as the new value of a replacement.
MISSING_WORDS = ("nan", "none", "na", "n/a", "null")


@dataclass(frozen=True)
class Agg:
    """How one attribute is aggregated. ``replace`` maps values of the result to others."""

    method: str  # sum, mean, weighted_mean, mode
    basis: str | None = None
    fill_ratio: str | None = None
    replace: Mapping[Any, Any] | None = None

    def __post_init__(self):
        if self.method not in ("sum", "mean", "weighted_mean", "mode"):
            raise ModelError(f"no such method: {self.method}")
        if self.method == "weighted_mean" and not self.basis:
            raise ModelError("a weighted mean needs a basis")


def factors(old: Geometry, block_size: tuple[float, float, float]) -> tuple[str, tuple[int, int, int]]:
    """("down" | "up" | "same", whole factors) from one block size to another."""
    ratios = [n / o for n, o in zip(block_size, old.block_size)]
    close = lambda a, b: abs(a - b) <= 1e-8 + 1e-5 * abs(b)
    if all(close(r, 1) for r in ratios):
        return "same", (1, 1, 1)
    if all(r > 1 or close(r, 1) for r in ratios):
        whole = tuple(round(r) for r in ratios)
        if not all(close(r, w) for r, w in zip(ratios, whole)):
            raise ModelError("block sizes must be whole multiples")
        if any(n % f for n, f in zip(old.shape, whole)):
            raise ModelError("the grid does not divide into the new blocks")
        return "down", whole
    if all(r < 1 or close(r, 1) for r in ratios):
        whole = tuple(round(1 / r) for r in ratios)
        if not all(close(1 / r, w) for r, w in zip(ratios, whole)):
            raise ModelError("block sizes must be whole fractions")
        return "up", whole
    raise ModelError("one call cannot both enlarge and shrink blocks")


def _finite(c: Column) -> Column:
    return present(c) & (F.abs(c) != float("inf"))


def _restored(value: Column, kind: str, promote: bool) -> Column:
    """The result in the source's type; integers are rounded half to even, and refused if they don't fit."""
    if kind in INTEGERS and not promote:
        return F.rint(value).cast(kind)
    return value.cast("float") if kind == "float" else value


def _replaced(value: Column, table: Mapping[Any, Any] | None, kind: str) -> Column:
    for old, new in (table or {}).items():
        gone = new is None or str(new).lower() in MISSING_WORDS
        value = F.when(value == F.lit(old), F.lit(None) if gone else F.lit(new)).otherwise(value)
    return value.cast(kind) if table else value


def downsample(model: BlockModel, block_size: tuple[float, float, float], config: Mapping[str, Agg], promote: bool = False) -> BlockModel:
    """The model on coarser blocks: every parent of the grid has a row, with nulls where no child has a value.

    Sums and means pass over missing values; a sum divided by ``fill_ratio``'s mean is what a full block
    would hold. The mode is the most frequent value, of ties the one whose first block comes first.
    """
    way, (fx, fy, fz) = factors(model.geometry, tuple(map(float, block_size)))
    if way == "same":
        return model
    if way != "down":
        raise ModelError("the new blocks are smaller: that is upsampling")
    fills = {a.fill_ratio for a in config.values() if a.fill_ratio}
    if len(fills) > 1:
        raise ModelError(f"one fill_ratio only: {sorted(fills)}")
    wanted = {*config, *(a.basis for a in config.values() if a.basis), *fills}
    unknown = wanted - set(model.available_columns)
    if unknown:
        raise ModelError(f"unknown attributes: {sorted(unknown)}")
    df = calculate(model.df, model.schema, model.geometry, sorted(wanted), model.engine)
    kinds = dict(df.dtypes)
    i, j, k = model.geometry.ijk()
    coarse = model.geometry.resized(tuple(d * f for d, f in zip(model.geometry.block_size, (fx, fy, fz))), tuple(n // f for n, f in zip(model.geometry.shape, (fx, fy, fz))))
    down = lambda c, f: F.call_function("div", c, F.lit(f)).cast("int")
    parent = coarse.block_id(down(i, fx), down(j, fy), down(k, fz))
    rows = df.select(parent.alias("parent"), "block_id", *sorted(wanted - {"block_id"}))

    fill = F.avg(missing(F.col(next(iter(fills))).cast("double"))) if fills else None
    made: dict[str, Column] = {}
    for name, a in config.items():
        if a.method == "mode":
            continue
        v = F.col(name).cast("double")
        if a.method == "sum":
            value = F.sum(F.when(_finite(v), v))
        elif a.method == "mean":
            value = F.avg(missing(v))
        else:
            b = F.col(a.basis).cast("double")
            pair = _finite(v) & _finite(b)
            value = F.try_divide(F.sum(F.when(pair, v * b)), F.sum(F.when(pair, b)))
        if a.fill_ratio and a.method != "mean":
            value = F.try_divide(value, fill)
        made[name] = _replaced(_restored(value, kinds[name], promote), a.replace, "double" if promote and kinds[name] in INTEGERS else kinds[name])
    parts = [rows.groupBy("parent").agg(*(c.alias(n) for n, c in made.items()))] if made else []
    for name, a in config.items():
        if a.method == "mode":
            parts.append(first_seen_mode(rows.where(present_any(name, kinds[name])), ["parent"], name, "block_id").withColumn(name, _replaced(F.col(name), a.replace, kinds[name])))
    grid = coarse.grid(df.sparkSession).withColumnRenamed("block_id", "parent")
    out = reduce(lambda x, y: x.join(y, "parent", "left"), parts, grid).withColumnRenamed("parent", "block_id")
    out = coerce_positions(out).select(*ordered([*"ijkxyz", "block_id"]), *config)
    return BlockModel(out, coarse, None, model.engine, f"{model.name}.reblocked")


def present_any(name: str, kind: str) -> Column:
    c = F.col(name)
    return present(c) if kind in ("double", "float") else c.isNotNull()


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys and the most frequent value; of ties the one with the smallest ``order``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


# up


def _sample(index: Column, n: int, f: int) -> Column:
    """Coordinate of a fine index among n coarse blocks: both ends of the axis fall on block 0 and n - 1."""
    return index.cast("double") * F.lit(float(n - 1)) / F.lit(float(max(n * f - 1, 1)))


def upsample(model: BlockModel, block_size: tuple[float, float, float], config: Mapping[str, str]) -> BlockModel:
    """The model on finer blocks. Each attribute has a method: parent, nearest, mode or linear.

    Every stored attribute must have one. Nearest: halves go to the lower block. Mode: among the up to
    eight coarse blocks around, of ties the lowest value, nulls don't count. Linear: trilinear, null
    unless all blocks around have a value; numbers only.
    """
    way, f = factors(model.geometry, tuple(map(float, block_size)))
    attributes = [c for c in model.persisted_columns if c in model.attributes]
    if set(config) != set(attributes):
        raise ModelError(f"every attribute needs a method: {sorted(set(attributes) ^ set(config))}")
    bad = {m for m in config.values()} - {"parent", "nearest", "mode", "linear"}
    if bad:
        raise ModelError(f"no such methods: {sorted(bad)}")
    if way == "same":
        return model
    if way != "up":
        raise ModelError("the new blocks are larger: that is downsampling")
    old = model.geometry
    fine = old.resized(tuple(d / n for d, n in zip(old.block_size, f)), tuple(n * m for n, m in zip(old.shape, f)))
    grid = fine.grid(model.df.sparkSession, xyz=False)
    coarse = model.df.select(F.col("block_id").alias("_coarse"), *config)
    kinds = dict(model.df.dtypes)
    parts: list[DataFrame] = []
    modes: list[DataFrame] = []
    by = lambda m: [c for c, v in config.items() if v == m]
    if names := by("parent"):
        at = [F.call_function("div", F.col(c), F.lit(n)) for c, n in zip("ijk", f)]
        parts.append(grid.select("block_id", old.block_id(*at).alias("_coarse")).join(coarse.select("_coarse", *names), "_coarse", "left").drop("_coarse"))
    if names := by("nearest"):
        at = [F.least(F.greatest(F.floor(_sample(F.col(c), n, m) + 0.5 - 1e-12), F.lit(0)), F.lit(n - 1)) for c, n, m in zip("ijk", old.shape, f)]
        parts.append(grid.select("block_id", old.block_id(*at).alias("_coarse")).join(coarse.select("_coarse", *names), "_coarse", "left").drop("_coarse"))
    if names := by("mode"):
        low = [F.floor(_sample(F.col(c), n, m)) for c, n, m in zip("ijk", old.shape, f)]
        high = [F.ceil(_sample(F.col(c), n, m)) for c, n, m in zip("ijk", old.shape, f)]
        around = grid.select("block_id", *(F.array_distinct(F.array(a, b)).alias(c) for c, a, b in zip("abc", low, high)))
        for c in "abc":
            around = around.withColumn(c, F.explode(c))
        around = around.select("block_id", old.block_id("a", "b", "c").alias("_coarse")).join(coarse.select("_coarse", *names), "_coarse")
        modes.append(around.groupBy("block_id").agg(*(F.mode(F.when(present_any(n, kinds[n]), F.col(n)), True).alias(n) for n in names)))
        parts.append(modes[-1])
    if names := by("linear"):
        for name in names:
            if kinds[name] not in (*INTEGERS, "double", "float"):
                raise ModelError(f"{name} is no number")
        parts.append(_trilinear(grid, coarse, names, old, f, kinds))
    # all methods but mode have a row for every fine block
    whole = [x for x in parts if all(x is not m for m in modes)]
    first = whole[0] if whole else grid.select("block_id")
    out = reduce(lambda a, b: a.join(b, "block_id", "left"), [x for x in parts if x is not first], first)
    out = coerce_positions(fine.with_positions(out))
    return BlockModel(out.select(*ordered([*"ijkxyz", "block_id"]), *config), fine, None, model.engine, f"{model.name}.reblocked")


def _trilinear(grid: DataFrame, coarse: DataFrame, names: list[str], old: Geometry, f: tuple[int, int, int], kinds: dict[str, str]) -> DataFrame:
    """Each fine block's 8 (or 4, 2, 1: axes of one block have no upper neighbour) corners and weights, one equi-join, one sum."""
    axes = []
    for c, n, m in zip("ijk", old.shape, f):
        at = _sample(F.col(c), n, m)
        if n == 1:
            axes.append(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(1.0).alias("w"))))
            continue
        low = F.least(F.floor(at), F.lit(n - 2)).cast("long")
        t = at - low
        axes.append(F.array(F.struct(low.alias("at"), (1 - t).alias("w")), F.struct((low + 1).alias("at"), t.alias("w"))))
    around = grid.select("block_id", *(a.alias(c) for c, a in zip("abc", axes)))
    for c in "abc":
        around = around.withColumn(c, F.explode(c))
    around = around.select("block_id", old.block_id("a.at", "b.at", "c.at").alias("_coarse"), (F.col("a.w") * F.col("b.w") * F.col("c.w")).alias("_w"))
    corners = 1
    for n in old.shape:
        corners *= 2 if n > 1 else 1
    met = around.join(coarse.select("_coarse", *names), "_coarse", "left")
    out = []
    for name in names:
        v = missing(F.col(name).cast("double"))
        value = F.when(F.count(v) == corners, F.sum(v * F.col("_w")))
        out.append(_restored(value, kinds[name], False).alias(name))
    return met.groupBy("block_id").agg(*out)


# other aggregations


def heatmap(model: BlockModel, attribute: str, threshold: float, axis: str = "z") -> DataFrame:
    """For each line of blocks along the axis, how many values are over the threshold: the two other indices and ``n``."""
    if axis not in "xyz":
        raise ModelError("the axis is x, y or z")
    ijk = dict(zip("ijk", model.geometry.ijk()))
    others = [c for c, a in zip("ijk", "xyz") if a != axis]
    v = F.col(attribute)
    rows = model.df.select(*(ijk[c].alias(c) for c in others), (present(v) & (v > threshold)).cast("int").alias("over"))
    return rows.groupBy(*others).agg(F.sum("over").alias("n"))


def weighted_aggregate(df: DataFrame, weights: Mapping[str, str], categories: tuple[str, ...] = (), treatment: str = "majority", as_columns: Mapping[str, tuple] | None = None) -> DataFrame:
    """One row: weighted means of the columns in ``weights`` over the rows that have value and weight, sums of
    the other numbers; categories by
    majority (lowest on ties) or as proportions, in a map or, for the values in ``as_columns``, in columns."""
    made: list[Column] = []
    for c in df.columns:
        if c in weights:
            w = F.col(weights[c])
            both = missing(F.col(c)).isNotNull() & missing(w).isNotNull()
            made.append(F.try_divide(F.sum(F.when(both, F.col(c) * w)), F.sum(F.when(both, w))).alias(c))
        elif c not in categories:
            made.append(F.sum(c).alias(c))
        elif treatment == "majority":
            made.append(F.mode(c, True).alias(c))
        elif as_columns:
            total = F.count(c)
            made += [F.try_divide(F.count_if(F.col(c) == v).cast("double"), total.cast("double")).alias(f"{c}_{v}") for v in as_columns[c]]
    out = df.agg(*made)
    if treatment == "proportions" and not as_columns:
        for c in categories:
            counted = df.where(F.col(c).isNotNull()).groupBy(c).count()
            total = counted.agg(F.sum("count").alias("total"))
            entries = counted.join(F.broadcast(total)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(c), F.col("count") / F.col("total"))))).alias(c))
            out = out.join(F.broadcast(entries))
        out = out.select(*df.columns)
    return out
