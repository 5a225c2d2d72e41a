"""The engine's queries over the driver's tables, each with SQL for an independent engine where SQL can say it.

The grids: events (block_id = event_id), orders and part (by their keys), with
10 by 10 blocks in j and k, and as many in i as there are rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import worldid
from gridloom.functions.expressions import present, round_half_even
from gridloom.functions.geometry import Geometry, angles_to_axes, rotate
from gridloom.operators import mesh, profile, quality, reblock, spatial, temporal
from gridloom.operators.model import BlockModel, coerce_positions, ordered
from gridloom.plans.schema import BlockSchema, Engine, Function, Lookup, Rule, persist_plan, violations
from gridloom.sources import catalog, files, generate, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIZE = (10.0, 10.0, 5.0)
AZIMUTH, ORIGIN = 30.0, (1000.0, 2000.0, 50.0)
COS, SIN = repr(math.cos(math.radians(AZIMUTH))), repr(math.sin(math.radians(AZIMUTH)))

EV = """ev AS (
  SELECT CAST(event_id AS INTEGER) AS block_id, CAST(event_id // 100 AS INTEGER) AS i, CAST((event_id // 10) % 10 AS INTEGER) AS j, CAST(event_id % 10 AS INTEGER) AS k,
         (event_id // 100 + 0.5) * 10.0 AS x, ((event_id // 10) % 10 + 0.5) * 10.0 AS y, (event_id % 10 + 0.5) * 5.0 AS z,
         value AS grade, event_type AS rock, CAST(user_id AS BIGINT) AS mass, ts FROM events)"""
DIMS = "dims AS (SELECT CAST(count(*) // 100 AS BIGINT) AS ni FROM events)"


#: DuckDB reads 0.5 as a decimal number and 0.5e0 as a double.
DECIMAL = re.compile(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = DECIMAL.sub(r"\1e0", sql)
        return f

    return keep


def r6(c, name: str):
    """Six decimals: sums of floating-point numbers depend on their order."""
    return F.round(c.cast("double") if not isinstance(c, str) else F.col(c).cast("double"), 6).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("block_id"), F.col("value").alias("grade"), F.col("event_type").alias("rock"), F.col("user_id").cast("long").alias("mass"), "ts")


@cache
def _rows(sf_dir: str, name: str, app: str) -> int:
    return table(SparkSession.active(), sf_dir, name).count()


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    return _rows(sf_dir, name, spark.sparkContext.applicationId)


def geometry(spark: SparkSession, sf_dir: str, name: str = "events", rotated: bool = False) -> Geometry:
    shape = (max(1, rows_of(spark, sf_dir, name) // 100), 10, 10)
    return Geometry.create(block_size=SIZE, shape=shape, origin=ORIGIN if rotated else (0, 0, 0), azimuth=AZIMUTH if rotated else 0.0)


def model(spark: SparkSession, sf_dir: str, rotated: bool = False, **more) -> BlockModel:
    return BlockModel(events(spark, sf_dir), geometry(spark, sf_dir, rotated=rotated), name="events", **more)


def orders(spark: SparkSession, sf_dir: str) -> BlockModel:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("block_id"), F.col("o_totalprice").alias("tonnes"), F.col("o_orderstatus").alias("domain"))
    return BlockModel(df, geometry(spark, sf_dir, "orders"), name="orders")


# sources


@query(f"WITH {EV} SELECT block_id, i, j, k, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, grade, rock FROM ev")
def src_block_model(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/events{store.SUFFIX}"
    held = store.save(BlockModel.from_dataframe(model(spark, sf_dir).df.select("block_id", "grade", "rock"), geometry(spark, sf_dir)), path)
    return held.df.select("block_id", "i", "j", "k", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyz"), "grade", "rock")


@query(f"WITH {EV} SELECT block_id, i, j, k, grade FROM ev")
def src_from_parquet(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/source.parquet"
    model(spark, sf_dir).select(["grade"]).write.parquet(path)
    found = store.from_parquet(spark, path)
    return found.df.select("block_id", "i", "j", "k", "grade")


@query(f"WITH {EV} SELECT block_id, i, j, k, grade FROM ev")
def src_from_dataframe(spark, sf_dir):
    df = model(spark, sf_dir).select(["grade"])
    return store.ingest(df).df.select("block_id", "i", "j", "k", "grade")


@query(f"WITH {EV} SELECT block_id, i, j, k, round(grade, 6) AS grade FROM ev")
def src_from_csv(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/source.csv"
    model(spark, sf_dir).select(["grade"]).write.option("header", True).csv(path)
    found = store.from_csv(spark, path, "x double, y double, z double, grade double")
    return found.df.select("block_id", "i", "j", "k", r6("grade", "grade"))


@query(f"WITH {EV} SELECT rock, CAST(count(*) AS BIGINT) AS n, round(avg(grade), 6) AS grade FROM ev GROUP BY rock")
def src_from_sql(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("gridloom_events")
    found = BlockModel.from_sql(spark, "SELECT CAST(event_id AS INT) AS block_id, value AS grade, event_type AS rock FROM gridloom_events", geometry(spark, sf_dir))
    return found.df.groupBy("rock").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("grade"), "grade"))


GRID_SQL = f"""WITH {DIMS}, g AS (SELECT unnest(generate_series(0, ni * 100 - 1)) AS b FROM dims)
SELECT CAST(b AS INTEGER) AS block_id, CAST(b // 100 AS INTEGER) AS i, CAST((b // 10) % 10 AS INTEGER) AS j, CAST(b % 10 AS INTEGER) AS k,
  (b // 100 + 0.5) * 10.0 AS x, ((b // 10) % 10 + 0.5) * 10.0 AS y, (b % 10 + 0.5) * 5.0 AS z FROM g"""


@query(GRID_SQL)
def gen_dense_grid(spark, sf_dir):
    return geometry(spark, sf_dir).grid(spark)


@query(GRID_SQL)
def gen_centroids(spark, sf_dir):
    g = geometry(spark, sf_dir)
    return g.grid(spark, xyz=False).select("*", *(c.alias(n) for n, c in zip("xyz", g.xyz_of())))


@query(f"""WITH {DIMS}, g AS (SELECT unnest(generate_series(0, ni * 100 - 1)) AS b FROM dims)
SELECT CAST(b AS INTEGER) AS block_id, 50.0 - (b % 10 + 0.5) * 5.0 AS depth,
  CASE WHEN 50.0 - (b % 10 + 0.5) * 5.0 <= 25.0 THEN 'shallow' ELSE 'deep' END AS depth_category FROM g""")
def gen_demo_model(spark, sf_dir):
    return generate.demo(spark, geometry(spark, sf_dir)).df.select("block_id", "depth", "depth_category")


@query("""WITH g AS (SELECT unnest(generate_series(0, 2999)) AS b), p AS (
  SELECT b, b // 150 + 0.5 - 10.0 AS x, (b // 10) % 15 + 0.5 - 7.5 AS y, b % 10 + 0.5 - 5.0 AS z FROM g
), n AS (SELECT b, power(x / 8.0, 2) + power(y / 5.0, 2) + power(z / 3.0, 2) AS n FROM p)
SELECT CAST(b AS INTEGER) AS block_id, round(CASE WHEN n <= 1 THEN 65.0 - 15.0 * sqrt(n) ELSE 50.0 END, 6) AS grade FROM n""")
def gen_toy_model(spark, sf_dir):
    toy = generate.toy(spark, Geometry(shape=(20, 15, 10)), bearing=0.0, dip=0.0, plunge=0.0)
    return toy.df.select("block_id", r6("grade", "grade"))


@query(f"WITH {EV} SELECT block_id, CAST(block_id AS INTEGER) AS by_xyz, CAST(block_id AS INTEGER) AS by_ijk, CAST(block_id AS INTEGER) AS by_world FROM ev")
def geo_block_id_fallback(spark, sf_dir):
    from gridloom.operators.model import derived_block_id

    m = BlockModel.from_dataframe(model(spark, sf_dir).df, geometry(spark, sf_dir))
    g = m.geometry
    exact = g.with_positions(m.df)
    return exact.select("block_id", g.block_id_from_xyz().alias("by_xyz"), g.block_id().alias("by_ijk"), derived_block_id(exact.drop("block_id"), g).alias("by_world"))


# sinks


@query(f"WITH {EV} SELECT block_id, i, j, k, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, grade FROM ev")
def sink_canonical_write(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/m"
    ijk = model(spark, sf_dir).select(["grade"], index="ijk")
    return store.save(BlockModel.from_dataframe(ijk, geometry(spark, sf_dir)), path).df.drop("world_id")


@query(f"WITH {EV} SELECT block_id, i, j, k, grade, mass, grade * mass AS metal FROM ev")
def sink_canonical_write_df(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/m"
    schema = BlockSchema((Rule("grade"), Rule("mass"), Rule("metal", expr="grade * mass")), strict="filter")
    found = store.save(BlockModel.from_dataframe(model(spark, sf_dir).df, geometry(spark, sf_dir), schema), path)
    return found.df.drop("world_id", "x", "y", "z")


@query(f"WITH {EV} SELECT block_id, grade * 2 AS grade, rock, mass FROM ev")
def sink_strict_write(spark, sf_dir):
    top = store.scratch_dir(spark)
    held = store.save(model(spark, sf_dir).with_df(events(spark, sf_dir).drop("ts")), f"{top}/m")
    return store.strict_write(held, held.df.withColumn("grade", F.col("grade") * 2), f"{top}/m").df


@query(f"WITH {EV} SELECT block_id, grade, o_totalprice AS price FROM ev LEFT JOIN orders ON o_orderkey = block_id")
def join_merge_columns(spark, sf_dir):
    extra = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("block_id"), F.col("o_totalprice").alias("price"))
    return model(spark, sf_dir).merge(extra).df.select("block_id", "grade", "price")


@query(f"WITH {EV} SELECT policy, codec, CAST(count(*) AS BIGINT) AS rows, round(sum(grade), 6) AS grade FROM ev, (VALUES ('fast', 'SNAPPY'), ('zstd', 'ZSTD'), ('9', 'ZSTD')) t(policy, codec) GROUP BY 1, 2")
def sink_compression(spark, sf_dir):
    out = []
    for name, policy in [("fast", "fast"), ("zstd", "zstd"), ("9", 9)]:
        path = f"{store.scratch_dir(spark)}/m"
        held = store.save(model(spark, sf_dir).with_df(events(spark, sf_dir).select("block_id", "grade")), path, policy)
        codecs = {c for _, c, _ in store.column_chunks(spark, path)}
        out.append(held.df.agg(F.lit(name).alias("policy"), F.lit(",".join(sorted(codecs))).alias("codec"), F.count(F.lit(1)).alias("rows"), r6(F.sum("grade"), "grade")))
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {EV} SELECT name, codec, round(sum(grade), 6) AS grade, CAST(sum(mass) AS BIGINT) AS mass FROM ev, (VALUES ('block_id', 'ZSTD'), ('grade', 'SNAPPY'), ('mass', 'ZSTD')) t(name, codec) GROUP BY 1, 2")
def sink_archive_compress(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/m"
    schema = BlockSchema((Rule("grade", compression="snappy"), Rule("mass", compression="7")))
    held = BlockModel(events(spark, sf_dir).select("block_id", "grade", "mass"), geometry(spark, sf_dir), schema)
    stored = store.compress(held, path)
    codecs = spark.createDataFrame(sorted({(n, c) for n, c, _ in store.column_chunks(spark, path)}), "name string, codec string")
    return codecs.join(stored.df.agg(r6(F.sum("grade"), "grade"), F.sum("mass").alias("mass")))


DENSE_SQL = """WITH d AS (SELECT CAST(count(*) // 100 AS BIGINT) AS ni FROM orders), g AS (SELECT unnest(generate_series(0, ni * 100 - 1)) AS b FROM d)
SELECT {cols} FROM g LEFT JOIN orders ON o_orderkey = b AND o_orderstatus = 'F'"""


@query(DENSE_SQL.format(cols="(b // 100 + 0.5) * 10.0 AS x, ((b // 10) % 10 + 0.5) * 10.0 AS y, (b % 10 + 0.5) * 5.0 AS z, o_totalprice AS tonnes"))
def export_dense(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/dense"
    m = orders(spark, sf_dir).where("domain = 'F'")
    store.dense_export(m.with_df(m.df.select("block_id", "tonnes")), path)
    return spark.read.parquet(path)


@query(DENSE_SQL.format(cols="CAST(b AS INTEGER) AS block_id, o_totalprice AS tonnes"))
def join_dense_reindex(spark, sf_dir):
    return orders(spark, sf_dir).where("domain = 'F'").densified(columns=["tonnes"]).select("block_id", "tonnes")


@query(DENSE_SQL.format(cols="CAST(((b % 10) * 10 + (b // 10) % 10) * ni + b // 100 AS BIGINT) AS cell, CAST(b // 100 AS INTEGER) AS i, CAST((b // 10) % 10 AS INTEGER) AS j, CAST(b % 10 AS INTEGER) AS k, o_totalprice AS tonnes").replace("FROM g LEFT", "FROM g CROSS JOIN d LEFT"))
def export_grid_table(spark, sf_dir):
    return mesh.grid_table(orders(spark, sf_dir).where("domain = 'F'"), ["tonnes"])


NODES = "(VALUES (0,0,0,0),(1,1,0,0),(2,0,1,0),(3,1,1,0),(4,0,0,1),(5,1,0,1),(6,0,1,1),(7,1,1,1)) c(corner, a, b, c)"


@query(f"WITH {EV} SELECT block_id, CAST(c.corner AS INTEGER) AS corner, (i + c.a) * 10.0 AS x, (j + c.b) * 10.0 AS y, (k + c.c) * 5.0 AS z FROM ev, {NODES}")
def export_voxel_nodes(spark, sf_dir):
    return mesh.hexahedra(model(spark, sf_dir))


@query("SELECT true AS geometry, true AS json, true AS schema, CAST(count(*) AS BIGINT) AS rows FROM events")
def meta_roundtrip(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/m"
    g = geometry(spark, sf_dir, rotated=True)
    schema = BlockSchema((Rule("grade", "double", title="Grade"), Rule("metal", expr="grade * mass", required=False)))
    held = store.save(BlockModel(events(spark, sf_dir), g, schema), path)
    return spark.createDataFrame([(held.geometry == g, Geometry.from_json(g.to_json()) == g, held.schema == schema, held.count())], "geometry boolean, json boolean, schema boolean, rows long")


# projections and calculated columns


@query(f"WITH {EV} SELECT x, y, z, grade, 500.0 AS volume FROM ev")
def proj_read(spark, sf_dir):
    return model(spark, sf_dir).select(["grade", "volume"])


@query(f"WITH {EV} SELECT block_id, i, j, k, grade FROM ev")
def proj_column_order(spark, sf_dir):
    df = geometry(spark, sf_dir).with_positions(events(spark, sf_dir)).select("grade", "k", "i", "block_id", "j")
    return df.select(*ordered(df.columns))


@query(f"WITH {EV} SELECT block_id, CAST(i AS INTEGER) AS i, CAST(x AS FLOAT) AS x FROM ev")
def proj_coerce_positions(spark, sf_dir):
    df = geometry(spark, sf_dir).with_positions(events(spark, sf_dir)).select(F.col("block_id").cast("long").alias("block_id"), F.col("i").cast("double").alias("i"), "x")
    return coerce_positions(df)


@query(f"WITH {EV} SELECT block_id, i, j, k, grade, round(grade * 2, 6) AS twice FROM ev")
def proj_strict_filter(spark, sf_dir):
    schema = BlockSchema((Rule("grade"), Rule("twice", expr="grade * 2"), Rule("virtual", expr="grade * 3", required=False)), strict="filter")
    df = geometry(spark, sf_dir).with_positions(events(spark, sf_dir)).drop("x", "y", "z")
    out = persist_plan(df, schema, geometry(spark, sf_dir))
    return out.withColumn("twice", F.round("twice", 6))


@query(f"WITH {EV} SELECT block_id, 500.0 AS volume FROM ev")
def calc_volume(spark, sf_dir):
    return model(spark, sf_dir).select(["block_id", "volume"], index=None)


CHAIN = BlockSchema((Rule("metal", expr="tonnes * grade", required=False), Rule("tonnes", expr="density * volume", required=False), Rule("density", expr="2.5", required=False)))


@query(f"WITH {EV} SELECT block_id, 1250.0 AS tonnes, round(1250.0 * grade, 6) AS metal FROM ev")
def calc_chained(spark, sf_dir):
    return model(spark, sf_dir, schema=CHAIN).select(["block_id", "tonnes", "metal"], index=None).withColumn("metal", F.round("metal", 6))


@query(f"WITH {EV} SELECT block_id, round((grade + 1) / nullif(mass, 0) - 2 * abs(grade - 50), 6) AS e FROM ev")
def calc_expr(spark, sf_dir):
    schema = BlockSchema((Rule("e", expr="(grade + 1) / mass - 2 * abs(grade - 50)", required=False),))
    return model(spark, sf_dir, schema=schema).select(["block_id", "e"], index=None).withColumn("e", F.round("e", 6))


@query(f"WITH {EV} SELECT block_id, CASE rock WHEN 'click' THEN 'ore' WHEN 'view' THEN 'waste' ELSE 'unknown' END AS kind FROM ev")
def calc_lookup(spark, sf_dir):
    schema = BlockSchema((Rule("kind", lookup=Lookup("rock", "kinds", "unknown"), required=False),))
    engine = Engine().with_resolvers(kinds={"click": "ore", "view": "waste"})
    return model(spark, sf_dir, schema=schema, engine=engine).select(["block_id", "kind"], index=None)


@query(f"WITH {EV} SELECT block_id, round(least(grade * 3, 100.0), 6) AS capped FROM ev")
def calc_function(spark, sf_dir):
    schema = BlockSchema((Rule("capped", function=Function("cap", ("grade",), {"most": 100.0}), required=False),))
    engine = Engine().with_functions(cap=lambda g, most: F.least(g * 3, F.lit(most)))
    return model(spark, sf_dir, schema=schema, engine=engine).select(["block_id", "capped"], index=None).withColumn("capped", F.round("capped", 6))


@query(f"WITH {EV} SELECT block_id, grade AS assay, round(grade + 1, 6) AS plus FROM ev")
def calc_alias(spark, sf_dir):
    schema = BlockSchema((Rule("assay", alias_of="grade"), Rule("plus", expr="assay + 1")))
    return persist_plan(events(spark, sf_dir), schema, None).select("block_id", "assay", F.round("plus", 6).alias("plus"))


@query(f"WITH {EV} SELECT block_id, round_even(grade * 10, 0) / 10 AS one, round_even(grade * 1000, 0) / 1000 AS three FROM ev")
def calc_decimals(spark, sf_dir):
    return events(spark, sf_dir).select("block_id", round_half_even(F.col("grade"), 1).alias("one"), round_half_even(F.col("grade"), 3).alias("three"))


@query(f"""WITH {EV}, n AS (SELECT block_id, power((x - 100.0) / 200.0, 2) + power((y - 50.0) / 40.0, 2) + power((z - 25.0) / 20.0, 2) AS n FROM ev)
SELECT block_id, round(CASE WHEN n <= 1 THEN 65.0 - 60.0 * sqrt(n) ELSE 5.0 END, 6) AS grade FROM n""")
def calc_ellipsoid_grade(spark, sf_dir):
    g = geometry(spark, sf_dir)
    return g.grid(spark).select("block_id", r6(generate.ellipsoid_grade(F.col("x"), F.col("y"), F.col("z"), (100.0, 50.0, 25.0), (200.0, 40.0, 20.0), 5.0, 65.0), "grade"))


# filters


@query(f"WITH {EV} SELECT block_id, grade FROM ev WHERE grade >= 50")
def filter_threshold(spark, sf_dir):
    return model(spark, sf_dir).where_at_least("grade", 50).df.select("block_id", "grade")


@query(f"WITH {EV} SELECT block_id, grade FROM ev WHERE grade BETWEEN 20 AND 60")
def filter_range(spark, sf_dir):
    return model(spark, sf_dir).where_between("grade", 60, 20).df.select("block_id", "grade")


@query(f"WITH {EV} SELECT block_id, rock FROM ev WHERE rock IN ('click', 'view')")
def filter_categories(spark, sf_dir):
    return model(spark, sf_dir).where_in("rock", ["click", "view"]).df.select("block_id", "rock")


@query(f"WITH {EV} SELECT block_id, CAST(grade > 50 AS INTEGER) AS over FROM ev")
def filter_heatmap_threshold(spark, sf_dir):
    v = F.col("grade")
    return events(spark, sf_dir).select("block_id", (present(v) & (v > 50)).cast("int").alias("over"))


@query(f"WITH {EV} SELECT min(grade) AS low, max(grade) AS high, greatest(max(grade) - min(grade), 1.0) / 200 AS step FROM ev")
def filter_bounds(spark, sf_dir):
    return model(spark, sf_dir).bounds_of("grade")


@query("SELECT CAST(o_orderkey AS INTEGER) AS block_id, o_totalprice AS tonnes FROM orders WHERE o_orderstatus = 'F'")
def filter_sparse(spark, sf_dir):
    return orders(spark, sf_dir).where("domain = 'F'").df.select("block_id", "tonnes")


@query(f"WITH {EV} SELECT block_id, grade FROM ev WHERE x BETWEEN 25 AND 75 AND y BETWEEN 0 AND 45 AND z BETWEEN 10 AND 40")
def filter_bbox(spark, sf_dir):
    return model(spark, sf_dir).where_bbox((25, 0, 10), (75, 45, 40)).df.select("block_id", "grade")


@query(f"WITH {EV} SELECT block_id, grade, rock FROM ev WHERE block_id = 123")
def filter_point_lookup(spark, sf_dir):
    return model(spark, sf_dir).block(123).select("block_id", "grade", "rock")


# geometry


@query(f"WITH {EV} SELECT block_id, i, j, k FROM ev")
def geo_ijk_from_block_id(spark, sf_dir):
    return events(spark, sf_dir).select("block_id", *(c.alias(n) for n, c in zip("ijk", geometry(spark, sf_dir).ijk())))


@query(f"WITH {EV} SELECT i, j, k, block_id FROM ev")
def geo_block_id_from_ijk(spark, sf_dir):
    return model(spark, sf_dir).select([], index="ijk").select("i", "j", "k", geometry(spark, sf_dir).block_id().alias("block_id"))


@query(f"WITH {EV} SELECT block_id, x AS u, y AS v, z AS w FROM ev")
def geo_uvw_from_ijk(spark, sf_dir):
    g = geometry(spark, sf_dir, rotated=True)
    return events(spark, sf_dir).select("block_id", *(c.alias(n) for n, c in zip("uvw", g.uvw(*g.ijk()))))


ROTATED = f"""rot AS (SELECT block_id, grade, 1000.0 + x * {COS} - y * {SIN} AS x, 2000.0 + x * {SIN} + y * {COS} AS y, 50.0 + z AS z FROM ev)"""


def _rotated(spark, sf_dir):
    g = geometry(spark, sf_dir, rotated=True)
    return g, events(spark, sf_dir).select("block_id", *(c.alias(n) for n, c in zip("xyz", g.xyz_of())))


@query(f"WITH {EV} SELECT block_id, i, j, k FROM ev")
def geo_ijk_from_xyz(spark, sf_dir):
    g, df = _rotated(spark, sf_dir)
    return df.select("block_id", *(c.alias(n) for n, c in zip("ijk", g.ijk_from_xyz())))


@query(f"WITH {EV}, {ROTATED} SELECT block_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM rot")
def geo_xyz_rotated(spark, sf_dir):
    _, df = _rotated(spark, sf_dir)
    return df.select("block_id", *(r6(c, c) for c in "xyz"))


@query(f"WITH {EV} SELECT block_id, round(x, 6) AS u, round(y, 6) AS v, round(z, 6) AS w FROM ev")
def geo_world_to_local(spark, sf_dir):
    g, df = _rotated(spark, sf_dir)
    return df.select("block_id", *(r6(c, n) for n, c in zip("uvw", g.to_local())))


@query(f"WITH {EV} SELECT block_id, x, y, z FROM ev")
def geo_xyz_from_block_id(spark, sf_dir):
    return events(spark, sf_dir).select("block_id", *(c.alias(n) for n, c in zip("xyz", geometry(spark, sf_dir).xyz_of())))


@query(f"WITH {EV} SELECT block_id, block_id AS found FROM ev")
def geo_block_id_from_xyz(spark, sf_dir):
    g, df = _rotated(spark, sf_dir)
    return df.select("block_id", g.block_id_from_xyz().alias("found"))


@query(f"""SELECT * FROM (VALUES ('u', round({COS}, 9), round({SIN}, 9), 0.0),
  ('v', round(-{SIN} * cos(radians(12)), 9), round({COS} * cos(radians(12)), 9), round(sin(radians(12)), 9)),
  ('w', round({SIN} * sin(radians(12)), 9), round(-{COS} * sin(radians(12)), 9), round(cos(radians(12)), 9))) t(axis, x, y, z)""")
def geo_angles_to_axes(spark, sf_dir):
    axes = angles_to_axes(AZIMUTH, 12.0)
    return spark.createDataFrame([(n, *(round(c, 9) + 0.0 for c in a)) for n, a in zip("uvw", axes)], "axis string, x double, y double, z double")


@query(f"WITH {EV} SELECT block_id, round(x * {COS} - y * {SIN}, 6) AS x, round(x * {SIN} + y * {COS}, 6) AS y, round(z, 6) AS z FROM ev")
def geo_rotate_points(spark, sf_dir):
    xyz = geometry(spark, sf_dir).xyz_of()
    return events(spark, sf_dir).select("block_id", *(r6(c, n) for n, c in zip("xyz", rotate(*xyz, AZIMUTH))))


@query(f"""WITH {DIMS}, c AS (SELECT a * ni * 10.0 AS u, b * 100.0 AS v, c * 50.0 AS w FROM dims, (VALUES (0), (1)) t(a), (VALUES (0), (1)) s(b), (VALUES (0), (1)) q(c)),
p AS (SELECT 1000.0 + CAST(u AS DOUBLE) * {COS} - CAST(v AS DOUBLE) * {SIN} AS x, 2000.0 + CAST(u AS DOUBLE) * {SIN} + CAST(v AS DOUBLE) * {COS} AS y, CAST(50.0 + w AS DOUBLE) AS z FROM c)
SELECT round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) AS ymin, round(max(y), 6) AS ymax, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax FROM p""")
def geo_extents(spark, sf_dir):
    low, high = geometry(spark, sf_dir, rotated=True).bounds()
    row = tuple(round(v, 6) for pair in zip(low, high) for v in pair)
    return spark.createDataFrame([row], ", ".join(f"{c}{e} double" for c in "xyz" for e in ("min", "max")))


def _morton_sql(x: str, y: str, z: str) -> str:
    q = (x, y, z)
    return " + ".join(f"(((CAST(round_even({q[a]} * 10, 0) AS BIGINT) >> {bit}) & 1) << {to})" for a, bit, to in worldid.layout(worldid.AXIS_BITS) if bit < 22)


@query(f"WITH {EV} SELECT block_id, CAST({_morton_sql('x', 'y', 'z')} AS BIGINT) AS world_id FROM ev")
def geo_world_id_encode(spark, sf_dir):
    return events(spark, sf_dir).select("block_id", worldid.WorldId().encode(*geometry(spark, sf_dir).xyz_of()).alias("world_id"))


@query(f"WITH {EV} SELECT block_id, x, y, z FROM ev")
def geo_world_id_decode(spark, sf_dir):
    w = worldid.WorldId()
    coded = events(spark, sf_dir).select("block_id", w.encode(*geometry(spark, sf_dir).xyz_of()).alias("world_id"))
    return coded.select("block_id", *(c.alias(n) for n, c in zip("xyz", w.decode())))


@query(f"WITH {EV} SELECT block_id, (CAST(round(x * 10) AS BIGINT) << 40) + (CAST(round(y * 10) AS BIGINT) << 16) + CAST(round(z * 10) AS BIGINT) AS code FROM ev")
def geo_legacy_encode(spark, sf_dir):
    return events(spark, sf_dir).select("block_id", worldid.encode_fields(*geometry(spark, sf_dir).xyz_of()).alias("code"))


@query(f"WITH {EV} SELECT block_id, x, y, z FROM ev")
def geo_legacy_decode(spark, sf_dir):
    return geo_legacy_encode(spark, sf_dir).select("block_id", *(c.alias(n) for n, c in zip("xyz", worldid.decode_fields())))


@query(f"WITH {EV} SELECT block_id, i, j, k, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM ev")
def geo_recompute_spatial(spark, sf_dir):
    m = model(spark, sf_dir)
    return m.with_df(m.df.select("block_id", F.lit(-1).alias("i"))).recompute_spatial().df


@query(f"WITH {EV} SELECT block_id, CAST({_morton_sql('x', 'y', 'z')} AS BIGINT) AS world_id FROM ev")
def geo_recompute_world_id(spark, sf_dir):
    return model(spark, sf_dir).recompute_world_id().df.select("block_id", "world_id")


# joins


WORLD = """SELECT CAST(event_id AS INTEGER) AS block_id, value AS grade, o_totalprice AS tonnes FROM events JOIN orders ON o_orderkey = event_id AND o_orderstatus = 'F'"""


def _world(spark, sf_dir, how):
    g = geometry(spark, sf_dir, "orders")
    a = BlockModel.from_dataframe(events(spark, sf_dir).select("block_id", "grade"), g)
    b = BlockModel.from_dataframe(orders(spark, sf_dir).where("domain = 'F'").df.select("block_id", "tonnes"), g)
    return a.join_on_world_id(b, how)


@query(WORLD)
def join_world_id(spark, sf_dir):
    return _world(spark, sf_dir, "inner").select("block_id", "grade", "tonnes")


@query("SELECT CAST(event_id AS INTEGER) AS block_id, value AS grade FROM events WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_world_id_semi(spark, sf_dir):
    return _world(spark, sf_dir, "left_semi").select("block_id", "grade")


@query("SELECT CAST(event_id AS INTEGER) AS block_id, value AS grade FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_world_id_anti(spark, sf_dir):
    return _world(spark, sf_dir, "left_anti").select("block_id", "grade")


SPARSE = """d AS (SELECT CAST(count(*) // 100 AS BIGINT) AS ni FROM orders),
sp AS (SELECT o_orderkey AS b, o_orderkey // 100 AS i, (o_orderkey // 10) % 10 AS j, o_orderkey % 10 AS k, o_totalprice AS tonnes FROM orders WHERE o_orderstatus = 'F')"""
STEPS = "(VALUES (0,0,0,-1),(1,0,0,1),(2,0,-1,0),(3,0,1,0),(4,-1,0,0),(5,1,0,0)) s(side, di, dj, dk)"
SIDES = f"""sides AS (SELECT sp.*, s.side FROM sp, {STEPS} WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.i = sp.i + s.di AND o.j = sp.j + s.dj AND o.k = sp.k + s.dk))"""


def _sparse(spark, sf_dir):
    m = orders(spark, sf_dir).where("domain = 'F'")
    return m.with_df(m.df.select("block_id", "tonnes"))


@query(f"WITH {SPARSE}, {SIDES} SELECT CAST(b AS INTEGER) AS block_id, CAST(side AS INTEGER) AS side FROM sides")
def join_exterior_faces(spark, sf_dir):
    return mesh.exterior_sides(_sparse(spark, sf_dir)).select("block_id", "side")


# reblocking


PARENTS = f"""WITH {EV}, {DIMS}, c AS (SELECT *, CAST(((i // 2) * 5 + j // 2) * 5 + k // 2 AS INTEGER) AS p FROM ev)"""
MODE = "m AS (SELECT p, rock, count(*) AS n, min(block_id) AS f FROM c GROUP BY p, rock), t AS (SELECT p, rock FROM m QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, f) = 1)"


def _down(spark, sf_dir, promote=False, **config):
    return reblock.downsample(model(spark, sf_dir), (20.0, 20.0, 10.0), config, promote).df


@query(f"""{PARENTS}, {MODE} SELECT p AS block_id, CAST(p // 25 AS INTEGER) AS i, CAST((p // 5) % 5 AS INTEGER) AS j, CAST(p % 5 AS INTEGER) AS k,
  round(avg(grade), 6) AS grade, CAST(sum(mass) AS BIGINT) AS mass, any_value(t.rock) AS rock FROM c JOIN t USING (p) GROUP BY p""")
def agg_downsample_full(spark, sf_dir):
    df = _down(spark, sf_dir, grade=reblock.Agg("mean"), mass=reblock.Agg("sum"), rock=reblock.Agg("mode"))
    return df.select("block_id", "i", "j", "k", r6("grade", "grade"), "mass", "rock")


@query(f"{PARENTS} SELECT p AS block_id, round(sum(grade), 6) AS grade FROM c GROUP BY p")
def agg_downsample_sum(spark, sf_dir):
    return _down(spark, sf_dir, grade=reblock.Agg("sum")).select("block_id", r6("grade", "grade"))


@query(f"{PARENTS} SELECT p AS block_id, round(avg(grade), 6) AS grade FROM c GROUP BY p")
def agg_downsample_mean(spark, sf_dir):
    return _down(spark, sf_dir, grade=reblock.Agg("mean")).select("block_id", r6("grade", "grade"))


@query(f"{PARENTS} SELECT p AS block_id, round(sum(grade * mass) / nullif(sum(mass), 0), 6) AS grade FROM c GROUP BY p")
def agg_downsample_weighted_mean(spark, sf_dir):
    return _down(spark, sf_dir, grade=reblock.Agg("weighted_mean", basis="mass")).select("block_id", r6("grade", "grade"))


@query(f"{PARENTS}, {MODE} SELECT p AS block_id, rock FROM t")
def agg_downsample_mode(spark, sf_dir):
    return _down(spark, sf_dir, rock=reblock.Agg("mode")).select("block_id", "rock")


@query(f"{PARENTS} SELECT p AS block_id, round(sum(grade) / avg(CASE WHEN rock = 'click' THEN 1.0 ELSE 0.5 END), 6) AS grade FROM c GROUP BY p")
def agg_downsample_fill_ratio(spark, sf_dir):
    m = model(spark, sf_dir)
    m = m.with_df(m.df.withColumn("fill", F.when(F.col("rock") == "click", 1.0).otherwise(0.5)))
    return reblock.downsample(m, (20.0, 20.0, 10.0), {"grade": reblock.Agg("sum", fill_ratio="fill")}).df.select("block_id", r6("grade", "grade"))


@query(f"{PARENTS}, {MODE} SELECT p AS block_id, CASE rock WHEN 'click' THEN 'ore' WHEN 'view' THEN NULL ELSE rock END AS rock FROM t")
def agg_downsample_replace(spark, sf_dir):
    return _down(spark, sf_dir, rock=reblock.Agg("mode", replace={"click": "ore", "view": "n/a"})).select("block_id", "rock")


@query(f"{PARENTS} SELECT p AS block_id, round(sum(grade * mass * 500.0) / nullif(sum(mass * 500.0), 0), 6) AS grade FROM c GROUP BY p")
def agg_downsample_calc_basis(spark, sf_dir):
    m = model(spark, sf_dir, schema=BlockSchema((Rule("tonnage", expr="mass * volume", required=False),)))
    return reblock.downsample(m, (20.0, 20.0, 10.0), {"grade": reblock.Agg("weighted_mean", basis="tonnage")}).df.select("block_id", r6("grade", "grade"))


@query(f"{PARENTS} SELECT p AS block_id, CAST(round_even(avg(mass), 0) AS BIGINT) AS mass FROM c GROUP BY p")
def agg_downsample_int_restore(spark, sf_dir):
    return _down(spark, sf_dir, mass=reblock.Agg("mean")).select("block_id", "mass")


@query(f"""WITH {EV}, c AS (SELECT rock, count(*) AS n FROM ev GROUP BY rock)
SELECT round(sum(grade * mass) / sum(mass), 6) AS grade, CAST(sum(mass) AS BIGINT) AS mass, (SELECT rock FROM c ORDER BY n DESC, rock LIMIT 1) AS rock FROM ev""")
def agg_weighted_majority(spark, sf_dir):
    out = reblock.weighted_aggregate(events(spark, sf_dir).drop("block_id", "ts"), {"grade": "mass"}, ("rock",))
    return out.select(r6("grade", "grade"), "mass", "rock")


@query(f"WITH {EV}, c AS (SELECT rock, count(*) AS n FROM ev GROUP BY rock) SELECT rock, round(n / (SELECT count(*) FROM ev), 6) AS share FROM c")
def agg_weighted_proportions_map(spark, sf_dir):
    out = reblock.weighted_aggregate(events(spark, sf_dir).select("grade", "mass", "rock"), {"grade": "mass"}, ("rock",), "proportions")
    return out.select(F.explode("rock").alias("rock", "share")).select("rock", r6("share", "share"))


@query(f"WITH {EV} SELECT round(avg(CASE WHEN rock = 'click' THEN 1.0 ELSE 0.0 END), 6) AS rock_click, round(avg(CASE WHEN rock = 'view' THEN 1.0 ELSE 0.0 END), 6) AS rock_view FROM ev")
def agg_weighted_proportions_cols(spark, sf_dir):
    out = reblock.weighted_aggregate(events(spark, sf_dir).select("rock"), {}, ("rock",), "proportions", {"rock": ("click", "view")})
    return out.select(r6("rock_click", "rock_click"), r6("rock_view", "rock_view"))


def _heat(axis: str, a: str, b: str):
    def run(spark, sf_dir):
        return reblock.heatmap(model(spark, sf_dir), "grade", 50.0, axis).select(a, b, F.col("n").cast("long").alias("n"))

    run.__name__ = f"agg_heatmap_{axis}"
    return query(f"WITH {EV} SELECT {a}, {b}, CAST(sum(CAST(grade > 50 AS INTEGER)) AS BIGINT) AS n FROM ev GROUP BY {a}, {b}")(run)


for _axis, _a, _b in (("z", "i", "j"), ("x", "j", "k"), ("y", "i", "k")):
    _heat(_axis, _a, _b)


@query(f"WITH {DIMS} SELECT 'u' AS axis, 5.0 AS first, 10.0 AS size, CAST(ni AS INTEGER) AS n FROM dims UNION ALL SELECT 'v', 5.0, 10.0, 10 UNION ALL SELECT 'w', 2.5, 5.0, 10")
def agg_infer_geometry(spark, sf_dir):
    g = Geometry.create(block_size=SIZE, shape=geometry(spark, sf_dir).shape, azimuth=AZIMUTH)
    df = events(spark, sf_dir).select(*(c.alias(n) for n, c in zip("xyz", g.xyz_of())))
    return quality.inferred_axes(df, AZIMUTH)


GAPS = f"""WITH {EV}, c AS (SELECT DISTINCT 'x' AS "column", x AS p FROM ev UNION SELECT DISTINCT 'y', y FROM ev UNION SELECT DISTINCT 'z', z FROM ev),
g AS (SELECT "column", p, lead(p) OVER (PARTITION BY "column" ORDER BY p) - p AS gap FROM c)"""


@query(f"""{GAPS} SELECT "column", round(avg(gap), 6) AS mean_gap FROM g GROUP BY 1""")
def agg_mean_spacing(spark, sf_dir):
    return quality.mean_and_modal_spacing(model(spark, sf_dir).select([])).select("column", r6("mean_gap", "mean_gap"))


@query(f"""{GAPS}, n AS (SELECT "column", round(gap, 6) AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT "column", gap AS modal_gap FROM n QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, gap) = 1""")
def agg_modal_spacing(spark, sf_dir):
    return quality.mean_and_modal_spacing(model(spark, sf_dir).select([])).select("column", r6("modal_gap", "modal_gap"))


@query("""WITH d AS (SELECT count(*) // 100 * 100 AS n FROM orders) SELECT CAST(count(*) AS BIGINT) AS rows, count(*) < any_value(n) AS is_sparse, round(1.0 - count(*) / any_value(n)::DOUBLE, 9) AS sparsity
FROM orders, d WHERE o_orderstatus = 'F'""")
def agg_sparsity(spark, sf_dir):
    return _sparse(spark, sf_dir).sparsity_table().withColumn("sparsity", F.round("sparsity", 9))


DECILES = "e AS (SELECT quantile_cont(grade, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS es FROM ev)"


@query(f"WITH {EV}, {DECILES} SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS decile, round(unnest(es), 6) AS edge FROM e")
def agg_deciles(spark, sf_dir):
    return profile.decile_edges(events(spark, sf_dir), "grade").select(F.posexplode("edges").alias("n", "edge")).select((F.col("n") + 1).alias("decile"), r6("edge", "edge"))


@query(f"WITH {EV}, {DECILES} SELECT block_id, CAST(least(len(list_filter(es, lambda t: t <= grade)), 9) AS INTEGER) AS decile FROM ev, e")
def bin_deciles(spark, sf_dir):
    return profile.bin_to_deciles(events(spark, sf_dir), "grade").select("block_id", "decile")


# finer blocks


UP = """d AS (SELECT CAST(count(*) // 100 AS BIGINT) AS ni FROM part), f AS (SELECT unnest(generate_series(0, ni * 800 - 1)) AS b FROM d),
q AS (SELECT b, ni, b // 400 AS i, (b // 20) % 20 AS j, b % 20 AS k FROM f, d),
s AS (SELECT b, ni, i, j, k, i * (ni - 1.0) / greatest(2 * ni - 1, 1) AS ci, j * 9.0 / 19.0 AS cj, k * 9.0 / 19.0 AS ck FROM q),
p AS (SELECT p_partkey AS c, p_retailprice AS density, p_brand AS lith, p_size AS cls FROM part)"""


def _part(spark, sf_dir, *columns):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("block_id"), F.col("p_retailprice").alias("density"), F.col("p_brand").alias("lith"), F.col("p_size").alias("cls"))
    return BlockModel(df.select("block_id", *columns), geometry(spark, sf_dir, "part"), name="part")


def _up(spark, sf_dir, **config):
    return reblock.upsample(_part(spark, sf_dir, *config), (5.0, 5.0, 2.5), config).df


PARENT_AT = "((i // 2) * 10 + j // 2) * 10 + k // 2"
NEAR_AT = "(CAST(floor(ci + 0.5 - 1e-12) AS BIGINT) * 10 + CAST(floor(cj + 0.5 - 1e-12) AS BIGINT)) * 10 + CAST(floor(ck + 0.5 - 1e-12) AS BIGINT)"
LINEAR = """lo AS (SELECT b, ci, cj, ck, least(floor(ci), ni - 2) AS li, least(floor(cj), 8) AS lj, least(floor(ck), 8) AS lk FROM s),
lin AS (SELECT b, round(sum(density * (CASE di WHEN 1 THEN ci - li ELSE 1 - (ci - li) END) * (CASE dj WHEN 1 THEN cj - lj ELSE 1 - (cj - lj) END) * (CASE dk WHEN 1 THEN ck - lk ELSE 1 - (ck - lk) END)), 6) AS density
  FROM lo, (VALUES (0), (1)) x(di), (VALUES (0), (1)) y(dj), (VALUES (0), (1)) w(dk), p WHERE c = CAST(((li + di) * 10 + lj + dj) * 10 + lk + dk AS BIGINT) GROUP BY b)"""
UPMODE = """nb AS (SELECT DISTINCT b, CAST(a.v * 100 + m.v * 10 + n.v AS BIGINT) AS c FROM s, LATERAL (VALUES (floor(ci)), (ceil(ci))) a(v), LATERAL (VALUES (floor(cj)), (ceil(cj))) m(v), LATERAL (VALUES (floor(ck)), (ceil(ck))) n(v)),
mo AS (SELECT b, lith FROM (SELECT b, lith, count(*) AS n FROM nb JOIN p USING (c) GROUP BY b, lith) QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC, lith) = 1)"""


@query(f"WITH {UP} SELECT CAST(b AS INTEGER) AS block_id, lith FROM s LEFT JOIN p ON c = {PARENT_AT}")
def upsample_parent(spark, sf_dir):
    return _up(spark, sf_dir, lith="parent").select("block_id", "lith")


@query(f"WITH {UP} SELECT CAST(b AS INTEGER) AS block_id, cls FROM s LEFT JOIN p ON c = {NEAR_AT}")
def upsample_nearest(spark, sf_dir):
    return _up(spark, sf_dir, cls="nearest").select("block_id", "cls")


@query(f"WITH {UP}, {UPMODE} SELECT CAST(b AS INTEGER) AS block_id, lith FROM s LEFT JOIN mo USING (b)")
def upsample_mode(spark, sf_dir):
    return _up(spark, sf_dir, lith="mode").select("block_id", "lith")


@query(f"WITH {UP}, {LINEAR} SELECT CAST(b AS INTEGER) AS block_id, density FROM lin")
def upsample_linear(spark, sf_dir):
    return _up(spark, sf_dir, density="linear").select("block_id", r6("density", "density"))


@query(f"WITH {UP}, {LINEAR}, {UPMODE} SELECT CAST(b AS INTEGER) AS block_id, lin.density, mo.lith, cls FROM s LEFT JOIN lin USING (b) LEFT JOIN mo USING (b) LEFT JOIN p ON c = {NEAR_AT}")
def upsample_full(spark, sf_dir):
    return _up(spark, sf_dir, density="linear", lith="mode", cls="nearest").select("block_id", r6("density", "density"), "lith", "cls")


# flags and surfaces


TRIANGLE = ((15.0, 15.0), (95.0, 15.0), (55.0, 85.0))


def _inside_sql(x: str, y: str) -> str:
    edges = list(zip(TRIANGLE, (*TRIANGLE[1:], TRIANGLE[0])))
    cross = " + ".join(f"CAST((({b} > {y}) <> ({d} > {y})) AND ({x} < ({c} - {a}) * ({y} - {b}) / nullif({d} - {b}, 0) + {a}) AS INTEGER)" if b != d else "0" for (a, b), (c, d) in edges)
    on = " OR ".join(f"(abs(({x} - {a}) * ({d} - {b}) - ({y} - {b}) * ({c} - {a})) <= 1e-9 AND {x} BETWEEN {min(a, c)} AND {max(a, c)} AND {y} BETWEEN {min(b, d)} AND {max(b, d)})" for (a, b), (c, d) in edges)
    return f"((({cross}) % 2 = 1) OR {on})"


@query(f"WITH {EV} SELECT block_id, {_inside_sql('x', 'y')} AS inside FROM ev")
def spatial_flag_polygon(spark, sf_dir):
    return spatial.flag_polygon(model(spark, sf_dir), spatial.Polygon(((TRIANGLE,),)), outside=False).select("block_id", "inside")


@query(f"WITH {EV} SELECT block_id, CASE WHEN {_inside_sql('x', 'y')} THEN 'pit' END AS domain FROM ev")
def spatial_flag_labels(spark, sf_dir):
    return spatial.flag_polygon(model(spark, sf_dir), spatial.Polygon(((TRIANGLE,),), "pit"), "domain").select("block_id", "domain")


def _cube(low, high, name=None):
    points = [tuple((low, high)[e][a] for a, e in enumerate(c)) for c in mesh.CORNERS]
    return spatial.Mesh(tuple(points), tuple(t for _, *ts in mesh.SIDES for t in ts), name)


@query(f"WITH {EV} SELECT block_id, x BETWEEN 12 AND 65 AND y BETWEEN 15 AND 80 AND z BETWEEN 6 AND 41 AS inside FROM ev")
def spatial_flag_solid(spark, sf_dir):
    solid = spatial.Solid(_cube((12.0, 15.0, 6.0), (65.0, 80.0, 41.0)))
    return spatial.flag_solid(model(spark, sf_dir), solid, outside=False).select("block_id", "inside")


def _raster(spark, sf_dir):
    far = geometry(spark, sf_dir).shape[0] * 10.0
    return spatial.Raster((0.0, far / 2, far), (0.0, 50.0, 100.0), ((10.0, 20.0, 30.0), (15.0, 25.0, 20.0), (40.0, 5.0, 12.0)))


RASTER = f"""WITH {EV}, {DIMS}, h AS (SELECT ev.*, ni * 5.0 AS half FROM ev, dims), c AS (SELECT *, CAST(least(floor(x / half), 1) AS INTEGER) AS cx, CAST(least(floor(y / 50), 1) AS INTEGER) AS cy FROM h),
v AS (SELECT * FROM (VALUES (0,0,10.0),(1,0,20.0),(2,0,30.0),(0,1,15.0),(1,1,25.0),(2,1,20.0),(0,2,40.0),(1,2,5.0),(2,2,12.0)) t(vx, vy, h)),
r AS (SELECT block_id, z, (x - cx * half) / half AS tx, (y - cy * 50) / 50.0 AS ty, a.h AS z00, b.h AS z10, d.h AS z01, e.h AS z11 FROM c
  JOIN v a ON a.vx = cx AND a.vy = cy JOIN v b ON b.vx = cx + 1 AND b.vy = cy JOIN v d ON d.vx = cx AND d.vy = cy + 1 JOIN v e ON e.vx = cx + 1 AND e.vy = cy + 1),
s AS (SELECT block_id, z, (1 - tx) * (1 - ty) * z00 + tx * (1 - ty) * z10 + (1 - tx) * ty * z01 + tx * ty * z11 AS sz FROM r)"""


@query(f"{RASTER} SELECT block_id, round(sz, 6) AS surface_z FROM s")
def surf_raster_z(spark, sf_dir):
    x, y, _ = geometry(spark, sf_dir).xyz_of()
    return _raster(spark, sf_dir).heights(events(spark, sf_dir), x, y).select("block_id", r6("surface_z", "surface_z"))


@query(f"{RASTER} SELECT block_id, round(greatest(0.0, least(1.0, (sz - (z - 2.5)) / 5.0)), 6) AS fraction FROM s")
def surf_raster_fraction(spark, sf_dir):
    return _raster(spark, sf_dir).fraction_below(model(spark, sf_dir)).select("block_id", r6("fraction", "fraction"))


def _slope(spark, sf_dir):
    far = geometry(spark, sf_dir).shape[0] * 10.0
    return spatial.MeshSurface(spatial.Mesh(((0.0, 0.0, 0.0), (far, 0.0, 50.0), (far, 100.0, 50.0), (0.0, 100.0, 0.0)), ((0, 1, 2), (0, 2, 3))))


@query(f"WITH {EV}, {DIMS} SELECT block_id, round(x / (ni * 10.0) * 50.0, 6) AS surface_z FROM ev, dims")
def surf_mesh_z(spark, sf_dir):
    x, y, _ = geometry(spark, sf_dir).xyz_of()
    return _slope(spark, sf_dir).heights(events(spark, sf_dir), "block_id", x, y).select("block_id", r6("surface_z", "surface_z"))


@query(f"WITH {EV}, {DIMS} SELECT block_id, round(greatest(0.0, least(1.0, (x / (ni * 10.0) * 50.0 - (z - 2.5)) / 5.0)), 6) AS fraction FROM ev, dims")
def surf_mesh_fraction(spark, sf_dir):
    return _slope(spark, sf_dir).fraction_below(model(spark, sf_dir)).select("block_id", r6("fraction", "fraction"))


# meshes


TRIS = "(VALUES " + ", ".join(f"({s},{h},{t[0]},{t[1]},{t[2]})" for s, (_, *ts) in enumerate(mesh.SIDES) for h, t in enumerate(ts)) + ") t(side, half, v0, v1, v2)"
FACE = "CAST(b * 12 + t.side * 2 + t.half AS BIGINT) AS face_id, CAST(b * 8 + t.v0 AS BIGINT) AS v0, CAST(b * 8 + t.v1 AS BIGINT) AS v1, CAST(b * 8 + t.v2 AS BIGINT) AS v2"


@query(f"WITH {SPARSE} SELECT CAST(b * 8 + c.corner AS BIGINT) AS vertex_id, (i + c.a) * 10.0 AS x, (j + c.b) * 10.0 AS y, (k + c.c) * 5.0 AS z FROM sp, {NODES}".replace("sp,", "(SELECT b, i, j, k FROM sp) sp,").replace("CAST(b *", "CAST(sp.b *"))
def mesh_vertices(spark, sf_dir):
    return mesh.triangulate(_sparse(spark, sf_dir), surface_only=False).vertices.select("vertex_id", "x", "y", "z")


@query(f"WITH {SPARSE} SELECT {FACE} FROM sp, {TRIS}")
def mesh_faces_all(spark, sf_dir):
    return mesh.triangulate(_sparse(spark, sf_dir), surface_only=False).faces.select("face_id", "v0", "v1", "v2")


@query(f"WITH {DIMS} SELECT CAST(ni * 800 AS BIGINT) AS vertices, CAST(ni * 1200 AS BIGINT) AS faces FROM dims")
def mesh_dense_counts(spark, sf_dir):
    m = mesh.triangulate(model(spark, sf_dir), surface_only=False)
    return m.vertices.agg(F.count(F.lit(1)).alias("vertices")).join(m.faces.agg(F.count(F.lit(1)).alias("faces")))


@query(f"WITH {SPARSE}, {SIDES} SELECT {FACE} FROM sides JOIN {TRIS} USING (side)".replace("t.side", "side"))
def mesh_surface_faces(spark, sf_dir):
    return mesh.triangulate(_sparse(spark, sf_dir)).faces.select("face_id", "v0", "v1", "v2")


@query(f"WITH {SPARSE}, {SIDES} SELECT CAST(b * 12 + side * 2 + t.half AS BIGINT) AS face_id, tonnes FROM sides JOIN {TRIS} USING (side)")
def mesh_attributes(spark, sf_dir):
    return mesh.triangulate(_sparse(spark, sf_dir), ["tonnes"]).faces.select("face_id", "tonnes")


@query(f"""WITH {SPARSE}, {SIDES} SELECT CAST(count(DISTINCT b) * 8 AS BIGINT) AS vertices, CAST(count(*) * 2 AS BIGINT) AS faces FROM sides""")
def mesh_triangulate(spark, sf_dir):
    m = mesh.triangulate(_sparse(spark, sf_dir))
    return m.vertices.agg(F.count(F.lit(1)).alias("vertices")).join(m.faces.agg(F.count(F.lit(1)).alias("faces")))


@query(f"""WITH {SPARSE}, {SIDES} SELECT CAST(count(DISTINCT b) * 8 AS BIGINT) AS vertices, CAST(count(*) * 2 AS BIGINT) AS faces, CAST(0 AS BIGINT) AS dangling FROM sides""")
def mesh_validate(spark, sf_dir):
    return mesh.validate(mesh.triangulate(_sparse(spark, sf_dir)))


@query(f"""WITH {SPARSE}, e AS (SELECT min(tonnes) AS lo, max(tonnes) AS hi FROM sp), g AS (SELECT b, CAST(floor((tonnes - lo) / (hi - lo) * 255) AS INTEGER) AS g FROM sp, e)
SELECT CAST(b AS INTEGER) AS block_id, g AS r, g, g AS b, 255 AS a FROM g""")
def mesh_vertex_gray(spark, sf_dir):
    return mesh.colours(_sparse(spark, sf_dir).df, "tonnes").select("block_id", "r", "g", "b", "a")


@query(f"""WITH {SPARSE}, f AS (SELECT {FACE} FROM sp, {TRIS}), e AS (SELECT least(v0, v1) AS a, greatest(v0, v1) AS b FROM f UNION ALL SELECT least(v1, v2), greatest(v1, v2) FROM f UNION ALL SELECT least(v2, v0), greatest(v2, v0) FROM f)
SELECT a, b, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY a, b HAVING count(*) <> 2""")
def mesh_open_edges(spark, sf_dir):
    return mesh.open_edges(mesh.triangulate(_sparse(spark, sf_dir), surface_only=False).faces)


# checks


BAD_IDS = "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS ids, CAST(min(l_orderkey) AS BIGINT) AS lowest, CAST(max(l_orderkey) AS BIGINT) AS highest, count(*) = count(DISTINCT l_orderkey) AS valid FROM lineitem"


@query(BAD_IDS)
def valid_block_id(spark, sf_dir):
    return quality.block_id_report(table(spark, sf_dir, "lineitem"), geometry(spark, sf_dir, "orders").blocks, "l_orderkey")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS rows, CAST(count(*) // 100 * 100 AS BIGINT) AS dense_rows, true AS valid FROM orders")
def valid_sparse(spark, sf_dir):
    return quality.validate_sparse(_sparse(spark, sf_dir))


@query(f"WITH {EV} SELECT block_id, true AS bad_ijk, false AS bad_xyz, false AS bad_world_id FROM ev WHERE block_id % 97 = 0")
def valid_special_columns(spark, sf_dir):
    m = BlockModel.from_dataframe(events(spark, sf_dir), geometry(spark, sf_dir))
    broken = m.with_df(m.df.withColumn("j", F.when(F.col("block_id") % 97 == 0, F.col("j") + 1).otherwise(F.col("j"))))
    return quality.position_mismatches(broken)


@query(f"WITH {EV} SELECT block_id, CAST(block_id - 1 AS INTEGER) AS found FROM ev WHERE block_id % 97 = 5 AND k > 0")
def valid_id_xyz_mismatch(spark, sf_dir):
    g = geometry(spark, sf_dir)
    df = g.with_positions(events(spark, sf_dir))
    df = df.withColumn("z", F.when((F.col("block_id") % 97 == 5) & (F.col("k") > 0), F.col("z") - 5).otherwise(F.col("z")))
    return quality.id_xyz_mismatches(df, g)


@query(f"WITH {EV} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE i = 3) AS BIGINT) AS outside, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (WHERE i = 3) = 0 AS valid FROM ev")
def valid_geometry(spark, sf_dir):
    g = geometry(spark, sf_dir)
    df = model(spark, sf_dir).select([], index="xyz").withColumn("x", F.when(F.col("x") == 35, 35.5).otherwise(F.col("x")))
    return quality.geometry_report(df, g)


@query(f"""{GAPS} SELECT "column", CAST(0 AS BIGINT) AS nulls, CAST(count(*) AS BIGINT) AS "distinct", min(gap) AS least, max(gap) AS most, max(gap) - min(gap) <= 1e-8 AS regular FROM g GROUP BY 1""")
def valid_regular_spacing(spark, sf_dir):
    return quality.spacing_report(model(spark, sf_dir).select([]))


@query(f"""WITH {EV}, v AS (SELECT 'grade' AS "column", 'too large' AS "check", CAST(count(*) AS BIGINT) AS rows FROM ev WHERE grade > 90
  UNION ALL SELECT 'rock', 'not allowed', count(*) FROM ev WHERE rock NOT IN ('click', 'view') UNION ALL SELECT 'density', 'missing', 1) SELECT * FROM v WHERE rows > 0""")
def valid_schema(spark, sf_dir):
    schema = BlockSchema((Rule("grade", "double", most=90), Rule("rock", allowed=("click", "view")), Rule("density"), Rule("mass", "bigint", least=0)))
    return violations(events(spark, sf_dir), schema)


# windows, order, sets


@query(f'WITH {EV}, v AS (SELECT DISTINCT z AS c FROM ev) SELECT c AS "at", lead(c) OVER (ORDER BY c) - c AS gap FROM v')
def win_axis_gaps(spark, sf_dir):
    return quality.axis_gaps(model(spark, sf_dir).select([]), "z")


@query(f"WITH {EV} SELECT block_id, x, y, z, grade FROM ev ORDER BY z, y, x")
def sort_vtk_order(spark, sf_dir):
    m = model(spark, sf_dir)
    return m.with_df(m.geometry.with_positions(m.df).select("block_id", "x", "y", "z", "grade")).grid_order()


@query(f"WITH {EV} SELECT block_id, grade FROM ev ORDER BY block_id")
def sort_canonical(spark, sf_dir):
    m = model(spark, sf_dir)
    return m.with_df(m.df.select("block_id", "grade")).canonical_order()


@query(f"WITH {EV} SELECT block_id, grade FROM ev ORDER BY block_id LIMIT 100")
def limit_sample(spark, sf_dir):
    return model(spark, sf_dir).leading(100).select("block_id", "grade")


@query(f"WITH {EV} SELECT block_id, grade FROM ev WHERE md5(CAST(block_id AS VARCHAR)) < '{int(0.1 * 2**32):08x}'")
def sample_rows(spark, sf_dir):
    return model(spark, sf_dir).sampled(0.1).select("block_id", "grade")


@query(f"WITH {EV} SELECT block_id, round(power(x - 33, 2) + power(y - 41, 2) + power(z - 17, 2), 6) AS distance2 FROM ev ORDER BY 2, 1 LIMIT 1")
def topk_nearest_block(spark, sf_dir):
    return model(spark, sf_dir).nearest(33, 41, 17).select("block_id", r6("distance2", "distance2"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def set_distinct_ids(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT CAST(o_orderkey AS INTEGER) AS block_id FROM orders WHERE o_orderstatus <> 'F'")
def set_missing_blocks(spark, sf_dir):
    return _sparse(spark, sf_dir).missing_blocks().select("block_id")


@query("SELECT 'events' AS model, CAST(event_id AS INTEGER) AS block_id, value AS grade, NULL::DOUBLE AS tonnes FROM events UNION ALL SELECT 'orders', CAST(o_orderkey AS INTEGER), NULL, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def set_union_models(spark, sf_dir):
    a = model(spark, sf_dir)
    return a.with_df(a.df.select("block_id", "grade")).union(_sparse(spark, sf_dir)).select("model", "block_id", "grade", "tonnes")


# profiles


@query(f"""WITH {EV} SELECT 'grade' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(grade) AS BIGINT) AS missing, CAST(count(DISTINCT grade) AS BIGINT) AS "distinct", CAST(count(*) FILTER (WHERE grade = 0) AS BIGINT) AS zeros,
  min(grade) AS min, max(grade) AS max, round(avg(grade), 6) AS mean, round(stddev_samp(grade), 6) AS std, round(quantile_cont(grade, 0.25), 6) AS q25, round(quantile_cont(grade, 0.5), 6) AS q50, round(quantile_cont(grade, 0.75), 6) AS q75 FROM ev
UNION ALL SELECT 'mass', CAST(count(*) AS BIGINT), 0, CAST(count(DISTINCT mass) AS BIGINT), CAST(count(*) FILTER (WHERE mass = 0) AS BIGINT), min(mass), max(mass), round(avg(mass), 6), round(stddev_samp(mass), 6), round(quantile_cont(mass::DOUBLE, 0.25), 6), round(quantile_cont(mass::DOUBLE, 0.5), 6), round(quantile_cont(mass::DOUBLE, 0.75), 6) FROM ev""")
def profile_numeric(spark, sf_dir):
    out = profile.numeric_profile(events(spark, sf_dir), ["grade", "mass"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(f"""WITH {EV} SELECT 'rock' AS "column", rock AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM ev), 6) AS share FROM ev GROUP BY rock""")
def profile_categorical(spark, sf_dir):
    return profile.categorical_profile(events(spark, sf_dir), ["rock"]).withColumn("share", F.round("share", 6))


@query(f"WITH {EV} SELECT 'grade' AS a, 'mass' AS b, round(corr(grade, mass), 6) AS r FROM ev")
def profile_correlation(spark, sf_dir):
    return profile.correlations(events(spark, sf_dir), ["grade", "mass"]).withColumn("r", F.round("r", 6))


@query(f"WITH {EV} SELECT CAST(2 + 1 + 3 + 1 + least(count(DISTINCT rock), 10) AS BIGINT) AS rows, true AS described FROM ev")
def profile_report(spark, sf_dir):
    text = profile.report_html(events(spark, sf_dir).drop("ts"), "events", {"grade": "Grade"})
    return spark.createDataFrame([(text.count("<tr>"), "Grade" in text)], "rows long, described boolean")


@query("""SELECT column_name AS "column", true AS sized, CAST(count(*) OVER () AS INTEGER) AS batch FROM (DESCRIBE SELECT * FROM events)""")
def profile_column_sizes(spark, sf_dir):
    sizes = profile.column_sizes(f"{sf_dir}/events.parquet")
    names = sorted(sizes)
    batch = profile.columns_per_batch(names, sizes, profile.parse_memory_budget("1GiB"))
    return spark.createDataFrame([(n, sizes[n] > 0, batch) for n in names], "column string, sized boolean, batch int")


# time


TIMES = [datetime(2024, m, 1) for m in (1, 2, 3)]
STEPS_SQL = "t AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', 0), (TIMESTAMP '2024-02-01', 1), (TIMESTAMP '2024-03-01', 2)) s(time, n))"


@query(f"""WITH {STEPS_SQL}, p AS (SELECT -5 + a * 2.5 AS x, -5 + b * 2.5 AS y FROM range(5) r(a), range(5) s(b)), q AS (SELECT time, x, y, (x * x + y * y) / 25.0 AS r, 10 * (1 - exp(-3 * (n + 1) / 3.0)) / (1 - exp(-3)) AS d FROM p, t)
SELECT time, x, y, round(CASE WHEN r > 1 THEN 0.0 ELSE -d * (1 - r) * (1 - greatest(0.0, least(1.0, r - 0.5))) END, 6) + 0.0 AS value FROM q""")
def temporal_depletion(spark, sf_dir):
    df = temporal.depletion(spark, TIMES, (-5.0, 5.0), (-5.0, 5.0), 5, 5.0, 5.0, 10.0, delay_edges=True)
    return df.select(F.col("time").cast("timestamp_ntz").alias("time"), "x", "y", (F.round("value", 6) + 0.0).alias("value"))


C_DUMP = "(pi() / 2 + pi() / 6 * (power(1 + 1 / (2 * tan(radians(38))), 2) - 1))"


@query(f"""WITH v AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', 100.0), (TIMESTAMP '2024-02-01', 200.0), (TIMESTAMP '2024-03-01', 400.0)) s(time, v)),
s AS (SELECT time, cbrt(v / {C_DUMP}) AS rf FROM v), b AS (SELECT time, rf, rf / 2 AS h, rf + rf / 2 / tan(radians(38)) AS rb FROM s), m AS (SELECT CAST(ceil(max(rb)) AS BIGINT) AS g FROM b),
p AS (SELECT unnest(generate_series(-g, g)) AS x, g FROM m), q AS (SELECT x, unnest(generate_series(-g, g)) AS y FROM p), z AS (SELECT time, x, y, sqrt(x * x + y * y) AS r, rf, h, rb FROM q, b)
SELECT time, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(CASE WHEN r <= rf THEN h WHEN r <= rb THEN h - (r - rf) * tan(radians(38)) ELSE 0.0 END, 6) AS value FROM z""")
def temporal_waste_dump(spark, sf_dir):
    df = temporal.waste_dumps(spark, [100.0, 200.0, 400.0], TIMES, (0.0, 0.0))
    return df.select(F.col("time").cast("timestamp_ntz").alias("time"), "x", "y", F.round("value", 6).alias("value"))


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS difference FROM events")
def temporal_diff(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return temporal.differences(df, ["user_id"], "at").select("event_id", "user_id", r6("difference", "difference"))


@query("""WITH d AS (SELECT user_id, event_id, value, abs(epoch(ts) - epoch(TIMESTAMP '2024-01-15')) AS far FROM events)
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY far, event_id) AS r FROM d) WHERE r = 1""")
def temporal_nearest(spark, sf_dir):
    far = F.abs(F.col("ts").cast("timestamp").cast("double") - F.lit(datetime(2024, 1, 15)).cast("timestamp").cast("double"))
    picked = F.min_by(F.struct("event_id", "value"), F.struct(far, F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(picked.alias("p")).select("user_id", "p.event_id", "p.value")


@query("SELECT event_id, round(value * 2 + user_id, 6) AS e FROM events")
def temporal_expression(spark, sf_dir):
    return temporal.expression(table(spark, sf_dir, "events"), "value * 2 + user_id", "e").select("event_id", r6("e", "e"))


# functions of users, categories


@query(f"WITH {EV} SELECT block_id, round(grade * grade, 6) AS squared FROM ev")
def udf_pandas_scalar(spark, sf_dir):
    import pandas as pd

    def square(v):
        return v * v

    square.__annotations__ = {"v": pd.Series, "return": pd.Series}
    squared = F.pandas_udf(square, "double")
    schema = BlockSchema((Rule("squared", function=Function("squared", ("grade",)), required=False),))
    out = model(spark, sf_dir, schema=schema, engine=Engine().with_functions(squared=lambda g: squared(g))).select(["block_id", "squared"], index=None)
    return out.withColumn("squared", F.round("squared", 6))


@query(f"WITH {EV}, v AS (SELECT DISTINCT rock AS category FROM ev) SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM v")
def cat_encode_codes(spark, sf_dir):
    return profile.category_codes(events(spark, sf_dir), "rock")


# files


@query(f"WITH {EV} SELECT CASE WHEN {_inside_sql('x', 'y')} THEN true END AS inside, CAST(count(*) AS BIGINT) AS count FROM ev GROUP BY 1")
def geo_polygon_from_parquet(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/polygons"
    spark.createDataFrame([("pit", bytearray(files.to_wkb([[*TRIANGLE, TRIANGLE[0]]])))], "name string, geometry binary").write.parquet(path)
    polygon = files.read_polygon(spark, path, "pit")
    return spatial.flag_polygon(model(spark, sf_dir), polygon, inside=True).groupBy("inside").count()


@query(f"""WITH {DIMS}, c AS (SELECT * FROM (VALUES (0, 0, 0, 50, 10.0, 20.0, 15.0, 25.0), (1, 0, 0, 50, 20.0, 30.0, 25.0, 20.0), (0, 1, 50, 100, 15.0, 25.0, 40.0, 5.0), (1, 1, 50, 100, 25.0, 20.0, 5.0, 12.0)) t(cx, cy, y0, y1, z00, z10, z01, z11))
SELECT cx, cy, cx * ni * 5.0 AS x0, (cx + 1) * ni * 5.0 AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1, z00, z10, z01, z11 FROM c, dims""")
def geo_raster_from_npz(spark, sf_dir):
    import numpy as np

    r, d = _raster(spark, sf_dir), store.file_dir(spark)
    np.savez(f"{d}/r.npz", x_coords=r.xs, y_coords=r.ys, values=r.values)
    return files.read_raster(f"{d}/r.npz").cells(spark)


SURFACE = f"""WITH {SPARSE}, {SIDES}, shown AS (SELECT DISTINCT b, tonnes FROM sides)
SELECT CAST(8 * count(*) AS BIGINT) AS vertices, (SELECT CAST(2 * count(*) AS BIGINT) FROM sides) AS faces"""
PLY_SQL = f"{SURFACE}, round(8 * sum(CAST(CAST(tonnes AS FLOAT) AS DOUBLE)) / 1e6, 4) AS tonnes FROM shown"


def _surface(spark, sf_dir):
    return mesh.triangulate(_sparse(spark, sf_dir), ["tonnes"], merge=True)


@query(PLY_SQL)
def mesh_read_ply(spark, sf_dir):
    path = f"{store.file_dir(spark)}/m.ply"
    files.write_ply(_surface(spark, sf_dir), path)
    held = files.ply_tables(spark, path)
    tonnes = F.round(F.sum(F.col("tonnes").cast("float").cast("double")) / 1e6, 4)
    return held.vertices.agg(F.count(F.lit(1)).alias("vertices"), tonnes.alias("tonnes")).join(held.faces.agg(F.count(F.lit(1)).alias("faces")))


@query(PLY_SQL)
def mesh_write_ply(spark, sf_dir):
    path = f"{store.file_dir(spark)}/m.ply"
    files.write_ply(_surface(spark, sf_dir), path, binary=True)
    _, _, chunks = files.ply_chunks(path)
    counts, tonnes = {"vertex": 0, "face": 0}, []
    for name, columns, corners in chunks:
        counts[name] += len(corners) if name == "face" else len(columns["x"])
        if name == "vertex":
            tonnes.append(math.fsum(columns["tonnes"]))
    return spark.createDataFrame([(counts["vertex"], counts["face"], round(math.fsum(tonnes) / 1e6, 4))], "vertices long, faces long, tonnes double")


@query(f"{SURFACE}, CAST(8 * count(*) AS BIGINT) AS colours FROM shown")
def mesh_write_glb(spark, sf_dir):
    m, path = _surface(spark, sf_dir), f"{store.file_dir(spark)}/m.glb"
    files.write_glb(m, path, mesh.colours(m.vertices, "tonnes"))
    counts = [0, 0, 0]
    for part, rows in files.glb_chunks(path)[1]:
        counts[part] += len(rows)
    return spark.createDataFrame([tuple(counts)], "vertices long, faces long, colours long")


@query("SELECT 'ore' AS layer, 8 AS vertices, 12 AS faces, 0 AS open")
def mesh_read_dxf(spark, sf_dir):
    path = f"{store.file_dir(spark)}/m.dxf"
    solid = _cube((0.0, 0.0, 0.0), (2.0, 2.0, 2.0))
    rows = []
    for t in solid.triangles():
        rows += ["0", "3DFACE", "8", "ore"]
        for n, p in enumerate((*t, t[2])):
            for a, c in enumerate(p, 1):
                rows += [str(10 * a + n), str(c)]
    with open(path, "w") as f:
        f.write("\n".join([*rows, "0", "EOF", ""]))
    meshes = files.dxf_meshes(path)
    return spark.createDataFrame([(k, len(m.vertices), len(m.faces), len(m.open_edges())) for k, m in meshes.items()], "layer string, vertices int, faces int, open int")


def _catalog(spark):
    top = store.scratch_dir(spark)
    g = Geometry(shape=(2, 2, 2))
    for site, period, name in (("alpha", "base", "a"), ("alpha", "opt", "b"), ("beta", "base", "c")):
        store.save(BlockModel.from_geometry(spark, g), f"{top}/site={site}/period={period}/{name}{store.SUFFIX}")
    return catalog.Catalog.discover(spark, top)


@query("SELECT * FROM (VALUES ('a', 'alpha', 'base'), ('b', 'alpha', 'opt'), ('c', 'beta', 'base')) t(name, site, period)")
def cat_discover(spark, sf_dir):
    return _catalog(spark).df.drop("path")


@query("""SELECT * FROM (VALUES ('base'), ('opt')) t("option")""")
def cat_level_options(spark, sf_dir):
    return _catalog(spark).options("period", site="alpha", name="c")


@query("SELECT CAST(b AS INTEGER) AS block_id, CAST(b // 4 AS INTEGER) AS i, CAST((b // 2) % 2 AS INTEGER) AS j, CAST(b % 2 AS INTEGER) AS k FROM range(8) r(b)")
def cat_select(spark, sf_dir):
    c = _catalog(spark)
    return c.open(site="beta", period="base").df.select("block_id", "i", "j", "k")
