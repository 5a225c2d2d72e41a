"""More queries: what describes models, frames, schemas and reports, and rules that hold for missing values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import geometry as frames
from gridloom.functions.geometry import Geometry
from gridloom.functions.worldid import WorldId
from gridloom.operators import accessors, profile, quality, reblock, spatial
from gridloom.operators.model import BlockModel, ModelError
from gridloom.plans import schema as schemas
from gridloom.plans.queries import COS, DIMS, EV, SIN, TRIANGLE, _inside_sql, _sparse, events, geometry, model, query, r6, table
from gridloom.plans.schema import BlockSchema, Engine, Lookup, Rule, violations
from gridloom.sources import files, generate, store

# stored models


@query(f"WITH {EV} SELECT block_id, grade, false AS old_is_there FROM ev")
def sink_rename(spark, sf_dir):
    top = store.scratch_dir(spark)
    store.save(BlockModel(events(spark, sf_dir).select("block_id", "grade"), geometry(spark, sf_dir)), f"{top}/a{store.SUFFIX}")
    held = store.rename(spark, f"{top}/a{store.SUFFIX}", f"{top}/b{store.SUFFIX}")
    return held.df.select("block_id", "grade", F.lit(store.exists(spark, f"{top}/a{store.SUFFIX}")).alias("old_is_there"))


@query(f"WITH {EV} SELECT block_id, grade FROM ev")
def sink_interrupted_replacement(spark, sf_dir):
    """A model whose replacement ended between its two renames is there again when it is opened."""
    path = f"{store.scratch_dir(spark)}/a{store.SUFFIX}"
    store.save(BlockModel(events(spark, sf_dir).select("block_id", "grade"), geometry(spark, sf_dir)), path)
    store.move(spark, path, f"{path}.old")
    return store.load(spark, path).df.select("block_id", "grade")


@query(f"WITH {EV} SELECT grade FROM ev WHERE block_id >= 50 AND block_id < 150")
def src_lazy_columns(spark, sf_dir):
    path = f"{store.scratch_dir(spark)}/lazy{store.SUFFIX}"
    held = store.save(BlockModel(events(spark, sf_dir).select("block_id", "grade", "rock", "mass"), geometry(spark, sf_dir)), path)
    return held.df.where("block_id >= 50 AND block_id < 150").select("grade")


@query(f"WITH {EV} SELECT CAST(block_id // 300 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, round(sum(grade), 6) AS grade FROM ev GROUP BY 1")
def src_batches(spark, sf_dir):
    return model(spark, sf_dir).batches(300).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("grade"), "grade"))


@query(f"WITH {EV} SELECT DISTINCT rock AS label FROM ev")
def cat_labels(spark, sf_dir):
    labels = store.category_lists(events(spark, sf_dir), ["rock"])["rock"]
    return spark.createDataFrame([(x,) for x in labels], "label string")


@query(f"WITH {EV}, {DIMS} SELECT CAST((k * 10 + j) * ni + i AS BIGINT) AS cell, grade FROM ev, dims")
def src_transform(spark, sf_dir):
    """Rows with x, y and z become a stored model, and that a grid, by DataFrame.transform alone."""
    path = f"{store.scratch_dir(spark)}/t{store.SUFFIX}"
    rows = model(spark, sf_dir).select(["grade"])
    return rows.transform(accessors.stored(path)).transform(accessors.as_grid(["grade"], geometry(spark, sf_dir))).select("cell", "grade")


# columns and schemas


TONNES = BlockSchema((Rule("tonnage", expr="mass * volume", required=False), Rule("grade", "double", title="Grade", description="of the ore"), Rule("rock", title="Rock"), Rule("mass", is_attribute=False)))


@query("""SELECT * FROM (VALUES ('block_id', 'position', false), ('grade', 'stored', true), ('rock', 'stored', true), ('mass', 'stored', false), ('ts', 'stored', true), ('volume', 'calculated', false), ('tonnage', 'calculated', true)) t("column", kind, attribute)""")
def meta_columns(spark, sf_dir):
    m = model(spark, sf_dir, schema=TONNES)
    flags = schemas.attribute_flags(m.schema, m.geometry, m.df.columns)
    return spark.createDataFrame([(c, k, flags[c]) for c, k in m.kinds_of_columns().items()], "column string, kind string, attribute boolean")


@query("""SELECT * FROM (VALUES ('volume', '500.0'), ('tonnage', 'mass * volume')) t(name, expr)""")
def meta_operations(spark, sf_dir):
    found = schemas.definitions(TONNES, geometry(spark, sf_dir))
    return spark.createDataFrame([(n, r.expr) for n, r in found.items()], "name string, expr string")


@query("""SELECT * FROM (VALUES ('grade', 'Grade - of the ore'), ('rock', 'Rock')) t("column", said)""")
def meta_descriptions(spark, sf_dir):
    return spark.createDataFrame(list(schemas.descriptions(TONNES, events(spark, sf_dir).columns).items()), "column string, said string")


@query(f"""WITH {EV}, v AS (SELECT 'grade' AS "column", 'too large' AS "check", CAST(count(*) AS BIGINT) AS rows FROM ev WHERE grade > 90
  UNION ALL SELECT 'rock', 'not allowed', count(*) FROM ev WHERE rock NOT IN ('click', 'view') UNION ALL SELECT 'density', 'missing', 1) SELECT * FROM v WHERE rows > 0""")
def valid_schema_from_yaml(spark, sf_dir):
    written = BlockSchema((Rule("grade", "double", most=90), Rule("rock", allowed=("click", "view")), Rule("density"), Rule("mass", "bigint", least=0))).to_yaml()
    return violations(events(spark, sf_dir), BlockSchema.from_yaml(written))


@query(f"WITH {EV} SELECT block_id, CASE rock WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 0 END AS hardness, round(grade * 2, 6) AS twice FROM ev")
def calc_engine_registered_later(spark, sf_dir):
    schema = BlockSchema((Rule("hardness", lookup=Lookup("rock", "hard", 0), required=False), Rule("twice", function=schemas.Function("double_it", ("grade",)), required=False)))
    engine = Engine().with_resolvers(hard={"click": 9, "view": 9}).with_functions(double_it=lambda g: g * 3)
    m = model(spark, sf_dir, schema=schema, engine=engine)
    m = m.with_engine(m.engine.with_resolvers(hard={"click": 3, "view": 1}).with_functions(double_it=lambda g: g * 2))  # what comes later holds
    return m.select(["block_id", "hardness", "twice"], index=None).withColumn("twice", F.round("twice", 6))


# frames: one for each nation, turned by its key


TURNS = "t AS (SELECT n_nationkey AS key, n_nationkey * 13.0 - 150.0 AS azimuth, (n_nationkey % 5) * 15.0 - 30.0 AS dip FROM nation)"


def _frames(spark, sf_dir):
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 nations
    return [(k, frames.angles_to_axes(k * 13.0 - 150.0, k % 5 * 15.0 - 30.0)) for k in keys]


@query(f"WITH {TURNS} SELECT key, round(azimuth, 6) AS azimuth, round(dip, 6) AS dip, 0.0 AS plunge FROM t")
def geo_axes_to_angles(spark, sf_dir):
    rows = [(k, *(round(a, 6) + 0.0 for a in frames.axes_to_angles(*axes))) for k, axes in _frames(spark, sf_dir)]
    return spark.createDataFrame(rows, "key int, azimuth double, dip double, plunge double")


@query(f"WITH {TURNS} SELECT key, true AS orthonormal, true AS right_handed, false AS mirrored, azimuth <> 0 OR dip <> 0 AS rotated, dip = 0 AS upright FROM t")
def geo_frame_checks(spark, sf_dir):
    rows = []
    for k, (u, v, w) in _frames(spark, sf_dir):
        g = Geometry(axis_u=u, axis_v=v, axis_w=w)
        rows.append((k, frames.orthonormal(u, v, w), frames.right_handed(u, v, w), frames.right_handed(v, u, w), g.rotated, all(abs(c) < 1e-12 for c in w[:2])))
    return spark.createDataFrame(rows, "key int, orthonormal boolean, right_handed boolean, mirrored boolean, rotated boolean, upright boolean")


@query(f"WITH {TURNS} SELECT key, round(0.5 * (10 * abs(sin(radians(0.0))) + 10 * abs(sin(radians(dip))) + 5 * abs(cos(radians(dip)))), 6) AS half_height FROM t")
def geo_half_heights(spark, sf_dir):
    rows = [(k, round(Geometry(block_size=(10, 10, 5), axis_u=u, axis_v=v, axis_w=w).half_height(), 6)) for k, (u, v, w) in _frames(spark, sf_dir)]
    return spark.createDataFrame(rows, "key int, half_height double")


@query(f"""WITH {DIMS}, v AS (SELECT unnest(['blocks', 'volume', 'x0', 'x1', 'y0', 'y1', 'z0', 'z1', 'rotated']) AS name,
  unnest([ni * 100.0, 500.0, 1000.0 - 100.0 * {SIN}, 1000.0 + ni * 10.0 * {COS}, 2000.0, 2000.0 + ni * 10.0 * {SIN} + 100.0 * {COS}, 50.0, 100.0, 1.0]) AS value FROM dims) SELECT name, round(value, 6) AS value FROM v""")
def geo_accessors(spark, sf_dir):
    g = geometry(spark, sf_dir, rotated=True)
    g = Geometry.from_payload(g.to_payload())
    low, high = g.bounds()
    held = {"blocks": g.blocks, "volume": g.volume, "rotated": g.rotated} | {f"{a}{n}": p[i] for n, p in enumerate((low, high)) for i, a in enumerate("xyz")}
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in held.items()], "name string, value double")


@query(f"WITH {DIMS} SELECT way, CASE way WHEN 'parts' THEN ni * 100 WHEN 'flat' THEN ni * 100 WHEN 'lattice' THEN ni * 100 WHEN 'frame' THEN 1 END AS blocks, way IN ('parts', 'flat', 'frame') AS turned FROM dims, (VALUES ('parts'), ('flat'), ('lattice'), ('frame'), ('both'), ('mixed up')) t(way)")
def geo_constructors(spark, sf_dir):
    g = geometry(spark, sf_dir, rotated=True)
    ways = {"parts": {"local": g.local, "world": g.world}, "flat": g.local | g.world, "lattice": {"local": g.local}, "frame": {"world": g.world}, "both": {"local": g.local, "shape": (1, 1, 1)}, "mixed up": {"local": g.world}}
    rows = []
    for way, said in ways.items():
        try:
            made = Geometry.of(**said)
            rows.append((way, made.blocks, made.rotated))
        except frames.GeometryError:
            rows.append((way, None, False))
    return spark.createDataFrame(rows, "way string, blocks long, turned boolean")


@query(f"""WITH {DIMS}, o AS (SELECT unnest(['x', 'y', 'z']) AS axis, unnest([floor((1000.0 - 100.0 * {SIN}) * 10) / 10, 2000.0, 50.0]) AS origin FROM dims)
SELECT axis, origin AS "offset", 10.0 AS scale, CASE axis WHEN 'z' THEN 16 ELSE 24 END AS bits FROM o""")
def geo_world_id_params(spark, sf_dir):
    made = WorldId.for_geometry(geometry(spark, sf_dir, rotated=True))
    held = WorldId.from_params(made.to_params() | {"scale": 10})  # one number for all axes
    return spark.createDataFrame(list(zip("xyz", held.offset, held.scale, held.bits)), "axis string, offset double, scale double, bits int")


@query(f"WITH {DIMS}, b AS (SELECT unnest(generate_series(4, 24)) AS bits FROM dims) SELECT CAST(bits AS INTEGER) AS bits, round(greatest(ni * 10, 100) * 10) < power(2, bits) AS fits FROM b, dims")
def geo_world_id_limits(spark, sf_dir):
    def fits(bits):
        try:
            return bool(WorldId.for_geometry(geometry(spark, sf_dir), bits=(bits, bits, 16)))
        except ValueError:
            return False

    return spark.createDataFrame([(b, fits(b)) for b in range(4, 25)], "bits int, fits boolean")


@query(f"WITH {EV} SELECT block_id, CAST(row_number() OVER (ORDER BY x, y, z) - 1 AS INTEGER) AS place FROM ev")
def gen_row_ids(spark, sf_dir):
    g = geometry(spark, sf_dir)
    return g.with_positions(events(spark, sf_dir)).select("block_id", g.block_id_from_xyz().alias("place"))


@query(f"WITH {EV} SELECT CASE WHEN k >= 5 THEN 'shallow' ELSE 'deep' END AS depth_category, CAST(count(*) AS BIGINT) AS n, round(min(50.0 - z), 6) AS least, round(max(50.0 - z), 6) AS most FROM ev GROUP BY 1")
def bin_two(spark, sf_dir):
    made = generate.demo(spark, geometry(spark, sf_dir)).df
    return made.groupBy("depth_category").agg(F.count(F.lit(1)).alias("n"), r6(F.min("depth"), "least"), r6(F.max("depth"), "most"))


# reblocking


@query("""SELECT * FROM (VALUES (20.0, 20.0, 10.0, 'down', 2, 2, 2), (5.0, 10.0, 2.5, 'up', 2, 1, 2), (10.0, 10.0, 5.0, 'same', 1, 1, 1), (10.0, 50.0, 5.0, 'down', 1, 5, 1),
  (15.0, 10.0, 5.0, 'error', NULL, NULL, NULL), (10.0, 30.0, 5.0, 'error', NULL, NULL, NULL), (20.0, 5.0, 5.0, 'error', NULL, NULL, NULL)) t(du, dv, dw, way, fu, fv, fw)""")
def agg_factors(spark, sf_dir):
    rows = []
    for size in ((20.0, 20.0, 10.0), (5.0, 10.0, 2.5), (10.0, 10.0, 5.0), (10.0, 50.0, 5.0), (15.0, 10.0, 5.0), (10.0, 30.0, 5.0), (20.0, 5.0, 5.0)):
        try:
            way, f = reblock.factors(geometry(spark, sf_dir), size)
        except ModelError:
            way, f = "error", (None, None, None)
        rows.append((*size, way, *f))
    return spark.createDataFrame(rows, "du double, dv double, dw double, way string, fu int, fv int, fw int")


@query(f"WITH {DIMS} SELECT CAST(ni // 2 AS INTEGER) AS ni, 5 AS nj, 5 AS nk, 20.0 AS du, 20.0 AS dv, 10.0 AS dw, 1000.0 AS x0, true AS same_frame FROM dims")
def agg_reblocked_geometry(spark, sf_dir):
    m = model(spark, sf_dir, rotated=True)
    g = reblock.downsample(m, (20.0, 20.0, 10.0), {"grade": reblock.Agg("mean")}).geometry
    return spark.createDataFrame([(*g.shape, *g.block_size, g.origin[0], g.axes == m.geometry.axes)], "ni int, nj int, nk int, du double, dv double, dw double, x0 double, same_frame boolean")


HOLES = """h AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS grade, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS mass, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS rock, event_id AS b FROM events)"""


def _holes(spark, sf_dir):
    """Grades, masses and rocks with nulls, and NaN among the grades."""
    b = F.col("block_id")
    return events(spark, sf_dir).select("block_id", F.when(b % 6 == 0, F.lit(float("nan"))).when(b % 3 != 0, F.col("grade")).alias("grade"), F.when(b % 5 != 0, F.col("mass")).alias("mass"), F.when(b % 4 != 0, F.col("rock")).alias("rock"))


@query(f"""WITH {HOLES}, c AS (SELECT rock, count(*) AS n FROM h WHERE rock IS NOT NULL GROUP BY rock)
SELECT round(sum(grade * mass) / sum(mass) FILTER (WHERE grade IS NOT NULL), 6) AS grade, CAST(sum(mass) AS BIGINT) AS mass, (SELECT rock FROM c ORDER BY n DESC, rock LIMIT 1) AS rock FROM h""")
def agg_weighted_with_nulls(spark, sf_dir):
    out = reblock.weighted_aggregate(_holes(spark, sf_dir).drop("block_id"), {"grade": "mass"}, ("rock",))
    return out.select(r6("grade", "grade"), "mass", "rock")


@query(f"""WITH {HOLES}, c AS (SELECT *, CAST(((b // 200) * 5 + (b // 10) % 10 // 2) * 5 + b % 10 // 2 AS INTEGER) AS p FROM h), m AS (SELECT p, rock, count(*) AS n, min(b) AS f FROM c WHERE rock IS NOT NULL GROUP BY p, rock),
t AS (SELECT p, rock FROM m QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, f) = 1), s AS (SELECT p, round(sum(grade * mass) / nullif(sum(mass) FILTER (WHERE grade IS NOT NULL), 0), 6) AS grade, CAST(sum(mass) AS BIGINT) AS mass FROM c GROUP BY p)
SELECT p AS block_id, s.grade, s.mass, t.rock FROM s LEFT JOIN t USING (p)""")
def agg_downsample_with_nulls(spark, sf_dir):
    m = BlockModel(_holes(spark, sf_dir), geometry(spark, sf_dir), name="events")
    config = {"grade": reblock.Agg("weighted_mean", basis="mass"), "mass": reblock.Agg("sum"), "rock": reblock.Agg("mode")}
    return reblock.downsample(m, (20.0, 20.0, 10.0), config).df.select("block_id", r6("grade", "grade"), "mass", "rock")


# places


BOX = "(x BETWEEN 60.0 AND 90.0 AND y BETWEEN 40.0 AND 95.0)"


@query(f"WITH {EV} SELECT block_id, ({_inside_sql('x', 'y')} OR {BOX}) AS inside FROM ev")
def spatial_flag_union(spark, sf_dir):
    box = spatial.Polygon.box(60.0, 40.0, 90.0, 95.0)
    return spatial.flag_polygon(model(spark, sf_dir), spatial.Polygon(((TRIANGLE,), *box.parts)), outside=False).select("block_id", "inside")


RING = [(50.0 + 43.21 * math.cos(2 * math.pi * n / 720), 50.0 + 37.89 * math.sin(2 * math.pi * n / 720)) for n in range(720)]


@query(f"WITH {EV} SELECT block_id, power((x - 50) / 43.21, 2) + power((y - 50) / 37.89, 2) <= 1 AS inside FROM ev")
def spatial_flag_long_ring(spark, sf_dir):
    """A ring of 720 edges, met through bands."""
    return spatial.flag_polygon(model(spark, sf_dir), spatial.Polygon(((RING,),)), outside=False).select("block_id", "inside")


@query(f"WITH {EV} SELECT block_id, round(3.0 + 0.25 * x - 0.5 * y, 6) AS height FROM ev")
def surf_from_arrays(spark, sf_dir):
    """A raster of falling axes, as arrays give it; its heights are a plane's."""
    g = geometry(spark, sf_dir)
    xs, ys = [g.shape[0] * 10.0, g.shape[0] * 3.0, 0.0], [100.0, 35.0, 20.0, 0.0]
    r = spatial.Raster(tuple(xs), tuple(ys), tuple(tuple(3.0 + 0.25 * x - 0.5 * y for x in xs) for y in ys))
    x, y, _ = g.xyz_of()
    return r.heights(events(spark, sf_dir), x, y, "height").select("block_id", r6("height", "height"))


def write_geotiff(path, xs, ys, values, tiles=False, order="<"):
    """A deflated GeoTIFF of doubles, by strips of two rows or tiles of 16 by 16 pixels; ys fall."""
    import struct
    import zlib
    from itertools import accumulate

    import numpy as np

    values, blobs = np.asarray(values, f"{order}f8"), []
    if tiles:
        padded = np.pad(values, [(0, -n % 16) for n in values.shape])
        blobs = [padded[y : y + 16, x : x + 16] for y in range(0, padded.shape[0], 16) for x in range(0, padded.shape[1], 16)]
    else:
        blobs = [values[y : y + 2] for y in range(0, len(values), 2)]
    blobs = [zlib.compress(np.ascontiguousarray(b).tobytes()) for b in blobs]
    dx, dy = xs[1] - xs[0], ys[0] - ys[1]
    layout = [(322, 3, [16]), (323, 3, [16]), (324, 4, None), (325, 4, [len(b) for b in blobs])] if tiles else [(273, 4, None), (278, 3, [2]), (279, 4, [len(b) for b in blobs])]
    tags = [(256, 4, [len(xs)]), (257, 4, [len(ys)]), (258, 3, [64]), (259, 3, [8]), (277, 3, [1]), (339, 3, [3]), *layout, (33550, 12, [dx, dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, xs[0] - dx / 2, ys[0] + dy / 2, 0.0])]
    starts = list(accumulate(map(len, blobs[:-1]), initial=8))
    tags = sorted((t, k, starts if v is None else v) for t, k, v in tags)
    data, at, extra = b"".join(blobs), 8 + sum(map(len, blobs)), b""
    entries = b""
    after = at + 2 + 12 * len(tags) + 4
    for t, k, v in tags:
        packed = struct.pack(f"{order}{ {3: 'H', 4: 'I', 12: 'd'}[k] * len(v)}", *v)
        spot = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(f"{order}I", after + len(extra))
        extra += packed if len(packed) > 4 else b""
        entries += struct.pack(f"{order}HHI", t, k, len(v)) + spot
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at) + data + struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", 0) + extra)


@query(f"WITH {EV} SELECT block_id, round(3.0 + 0.25 * x - 0.5 * y, 6) AS strips, round(3.0 + 0.25 * x - 0.5 * y, 6) AS tiles FROM ev")
def surf_from_geotiff(spark, sf_dir):
    """Heights of a plane from files in strips and in tiles, of either byte order."""
    import numpy as np

    g, d = geometry(spark, sf_dir), store.file_dir(spark)
    xs = [-2.5 + 5.0 * n for n in range(g.shape[0] * 2 + 2)]
    ys = [104.0 - 4.0 * n for n in range(27)]
    values = 3.0 + 0.25 * np.array(xs) - 0.5 * np.array(ys)[:, None]
    write_geotiff(f"{d}/strips.tif", xs, ys, values)
    write_geotiff(f"{d}/tiles.tif", xs, ys, values, tiles=True, order=">")
    x, y, _ = g.xyz_of()
    df = files.read_geotiff(f"{d}/strips.tif").heights(events(spark, sf_dir), x, y, "strips")
    df = files.read_geotiff(f"{d}/tiles.tif").heights(df, x, y, "tiles")
    return df.select("block_id", r6("strips", "strips"), r6("tiles", "tiles"))


@query(f"WITH {EV} SELECT block_id, round(3.0 + 0.25 * x - 0.5 * y, 6) AS height FROM ev")
def surf_triangles_of_all_sizes(spark, sf_dir):
    """A plane of two triangles as large as the grid and many small ones beside them, through tiles of several levels."""
    g = geometry(spark, sf_dir)
    far = g.shape[0] * 10.0
    points, faces = [], []

    def square(x0, y0, x1, y1):
        n = len(points)
        points.extend((x, y, 3.0 + 0.25 * x - 0.5 * y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))
        faces.extend([(n, n + 1, n + 2), (n, n + 2, n + 3)])

    square(0.0, 0.0, far, 101.0)
    for n in range(60):
        square(-10.0, n, -9.0, n + 1.0)
    x, y, _ = g.xyz_of()
    return spatial.MeshSurface(spatial.Mesh(tuple(points), tuple(faces))).heights(events(spark, sf_dir), "block_id", x, y, "height").select("block_id", r6("height", "height"))


@query(f"WITH {EV}, o AS (SELECT CAST(o_orderkey AS INTEGER) AS block_id, o_totalprice AS tonnes FROM orders WHERE o_orderstatus = 'F') SELECT block_id, coalesce(tonnes, -1.0) AS tonnes FROM ev LEFT JOIN o USING (block_id)")
def join_mask_gather(spark, sf_dir):
    return spatial.gather(model(spark, sf_dir), _sparse(spark, sf_dir).df, "tonnes", -1.0).select("block_id", "tonnes")


@query("""WITH o AS (SELECT o_orderkey AS b FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT unnest(generate_series(0, count(*) // 100 * 100 - 1)) AS b FROM orders)
SELECT 'sparse in dense' AS test, (SELECT count(*) FROM o WHERE b NOT IN (SELECT b FROM g)) = 0 AS holds UNION ALL SELECT 'dense in sparse', (SELECT count(*) FROM g WHERE b NOT IN (SELECT b FROM o)) = 0""")
def set_subset(spark, sf_dir):
    m = _sparse(spark, sf_dir)
    inside = quality.validate_sparse(m).select(F.lit("sparse in dense").alias("test"), F.col("valid").alias("holds"))
    return inside.union(m.missing_blocks().agg(F.count(F.lit(1)).alias("n")).select(F.lit("dense in sparse"), F.col("n") == 0))


# VTK files, written and read back


@query("""WITH d AS (SELECT CAST(count(*) // 100 AS BIGINT) AS ni FROM orders), g AS (SELECT unnest(generate_series(0, ni * 100 - 1)) AS b, ni FROM d)
SELECT CAST(((b % 10) * 10 + (b // 10) % 10) * ni + b // 100 AS BIGINT) AS cell, o_totalprice AS tonnes FROM g LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = b""")
def export_vti(spark, sf_dir):
    path = f"{store.file_dir(spark)}/m.vti"
    files.write_vti(_sparse(spark, sf_dir), path, ["tonnes"])
    _, held = files.read_vtk(path)
    return spark.createDataFrame([(n, None if math.isnan(v) else v) for n, v in enumerate(held["tonnes"])], "cell long, tonnes double")


@query(f"""WITH {EV} SELECT CAST(count(*) AS BIGINT) AS cells, CAST(8 * count(*) AS BIGINT) AS points, round(sum(grade), 4) AS grade, round(sum(8 * x), 3) AS x, round(sum(8 * z), 3) AS z, true AS voxels FROM ev""")
def export_vtu(spark, sf_dir):
    import numpy as np

    path = f"{store.file_dir(spark)}/m.vtu"
    files.write_vtu(model(spark, sf_dir), path, ["grade"])
    counts, sums, voxels = {}, {"grade": [], "x": [], "z": []}, True
    for name, part in files.vtk_chunks(path):
        if name is None or part is None:
            continue
        first = counts.get(name, 0)
        counts[name] = first + len(part)
        if name == "Points":  # x, y, z by turns; a chunk begins anywhere
            sums["x"].append(math.fsum(part[-first % 3 :: 3]))
            sums["z"].append(math.fsum(part[(2 - first) % 3 :: 3]))
        elif name == "grade":
            sums["grade"].append(math.fsum(part))
        elif name == "types":
            voxels = voxels and bool((part == 11).all())
        elif name == "connectivity":
            voxels = voxels and bool((part == np.arange(first, first + len(part))).all())
    points = counts.get("Points", 0) // 3
    row = (counts.get("offsets", 0), points, *(round(math.fsum(sums[c]), d) for c, d in (("grade", 4), ("x", 3), ("z", 3))), voxels and counts.get("connectivity", 0) == points)
    return spark.createDataFrame([row], "cells long, points long, grade double, x double, z double, voxels boolean")


# DXF


@query("""SELECT * FROM (VALUES ('layer', 'ore', 16, 24, 0), ('layer', 'net', 9, 8, 8), ('block', 'cube', 16, 24, 0)) t("by", name, vertices, faces, open)""")
def mesh_read_dxf_blocks(spark, sf_dir):
    """A block of a cube that stands twice in the drawing, once turned and enlarged, and a net of 3 by 3 points."""
    corners = [(a, b, c) for c in (0, 1) for b in (0, 1) for a in (0, 1)]
    sides = [(1, 3, 4, 2), (5, 6, 8, 7), (1, 2, 6, 5), (3, 7, 8, 4), (1, 5, 7, 3), (2, 4, 8, 6)]
    cube = ["0", "POLYLINE", "8", "0", "70", "64", "71", "8", "72", "6"]
    for x, y, z in corners:
        cube += ["0", "VERTEX", "8", "0", "10", x, "20", y, "30", z, "70", "192"]
    for s in sides:
        cube += ["0", "VERTEX", "8", "0", "10", 0, "20", 0, "30", 0, "70", "128", *(x for c, n in zip((71, 72, 73, 74), s) for x in (c, n))]
    net = ["0", "POLYLINE", "8", "net", "70", "16", "71", "3", "72", "3"]
    for n in range(9):
        net += ["0", "VERTEX", "8", "net", "10", n // 3, "20", n % 3, "30", 0, "70", "64"]
    text = ["0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "cube", "10", 0, "20", 0, "30", 0, *cube, "0", "SEQEND", "0", "ENDBLK", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    text += ["0", "INSERT", "8", "ore", "2", "cube", "10", 5, "20", 5, "30", 0, "0", "INSERT", "8", "ore", "2", "cube", "10", 50, "20", 5, "30", 0, "41", 2, "42", 2, "43", 3, "50", 30]
    path = f"{store.file_dir(spark)}/m.dxf"
    with open(path, "w") as f:
        f.write("\n".join(map(str, [*text, *net, "0", "SEQEND", "0", "ENDSEC", "0", "EOF", ""])))
    rows = [(by, k, len(m.vertices), len(m.faces), len(m.open_edges())) for by in ("layer", "block") for k, m in files.dxf_meshes(path, by).items()]
    return spark.createDataFrame(rows, "by string, name string, vertices int, faces int, open int")


# reports


@query("""SELECT * FROM (VALUES ('256MB', CAST(256000000 AS BIGINT)), ('2GiB', 2147483648), ('1.5 kB', 1500), ('77', 77)) t(budget, bytes)""")
def profile_budgets(spark, sf_dir):
    return spark.createDataFrame([(b, profile.parse_memory_budget(b)) for b in ("256MB", "2GiB", "1.5 kB", "77")], "budget string, bytes long")


@query("""SELECT * FROM (VALUES (CAST(90 AS BIGINT), 1), (249, 1), (260, 2), (349, 2), (350, 3)) t(budget, columns)""")
def profile_batches(spark, sf_dir):
    sizes = {"a": 100, "b": 150, "c": 100}
    return spark.createDataFrame([(b, profile.columns_per_batch(list(sizes), sizes, b)) for b in (90, 249, 260, 349, 350)], "budget long, columns int")
