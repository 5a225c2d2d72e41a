import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry
from gridloom.operators import quality
from gridloom.operators.model import BlockModel, ModelError, ordered
from gridloom.plans.schema import BlockSchema, Engine, Function, Lookup, Rule, SchemaError, attribute_flags, descriptions, needed, definitions, persist_plan, violations
from gridloom.sources import catalog, generate, store

G = Geometry(shape=(3, 3, 3))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def demo(spark):
    return generate.demo(spark, G)


def test_demo_model(demo):
    got = rows(demo.df.orderBy("block_id").select("depth", "depth_category"))
    assert got[:3] == [(2.5, "deep"), (1.5, "shallow"), (0.5, "shallow")]


def test_canonical_model(spark, demo):
    m = BlockModel.from_dataframe(demo.df.select("x", "y", "z", "depth"), G)
    assert m.df.columns == ["block_id", "world_id", "i", "j", "k", "x", "y", "z", "depth"]
    assert [t for _, t in m.df.dtypes][:8] == ["int", "bigint", "int", "int", "int", "float", "float", "float"]
    for way in (["world_id"], ["i", "j", "k"], ["block_id"]):
        again = BlockModel.from_dataframe(m.df.select(*way, "depth"), m.geometry)
        assert sorted(rows(again.df)) == sorted(rows(m.df))
    with pytest.raises(ModelError, match="where"):
        BlockModel.from_dataframe(demo.df.select("depth"), G)


def test_select(spark, demo):
    m = demo.with_schema(BlockSchema((Rule("tonnes", expr="density * volume", required=False), Rule("density", expr="2.5", required=False))))
    assert m.calculated_columns == ["volume", "tonnes", "density"]
    assert m.select(["tonnes"]).columns == ["x", "y", "z", "tonnes"]
    assert m.select(["tonnes"], index="ijk").first()["tonnes"] == 2.5
    assert m.select(index=None).columns == ["depth", "depth_category"]
    assert m.select(index=None, include_calculated=True).columns == ["depth", "depth_category", "volume", "tonnes", "density"]
    assert "volume" not in m.attributes and "tonnes" in m.attributes
    with pytest.raises(SchemaError, match="no such"):
        m.select(["nothing"])
    with pytest.raises(ModelError):
        m.select(index="abc")


def test_sparse_and_dense(spark):
    g = Geometry(shape=(4, 4, 4))
    m = generate.demo(spark, g).where("z <> 1.5")
    assert m.count() == 48 and m.is_sparse and m.sparsity == 0.25
    dense = m.select(["depth"], dense=True)
    assert dense.count() == 64 and dense.where("depth IS NULL").count() == 16
    assert m.missing_blocks().count() == 16
    assert quality.validate_sparse(m).first()["valid"]


def test_filters_pass_over_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 5.0)], "block_id int, v double")
    m = BlockModel(df, Geometry(shape=(1, 1, 4)))
    ids = lambda x: sorted(r[0] for r in rows(x.df))
    assert ids(m.where_at_least("v", 1)) == [0, 3] and ids(m.where_between("v", 5, 2)) == [3] and ids(m.where_in("v", [])) == []
    assert rows(m.bounds_of("v")) == [(1.0, 5.0, 0.02)]


def test_box_prunes_by_id(demo):
    box = demo.where_bbox((0.6, 0, 0), (1.6, 2, 0.6))
    assert sorted(r[0] for r in rows(box.df.select("block_id"))) == [9, 12]
    assert "block_id" in box.df._jdf.queryExecution().optimizedPlan().toString()


def test_merge(spark, demo):
    extra = spark.createDataFrame([(0, 1.0), (26, 2.0)], "block_id int, v double")
    got = demo.merge(extra).df
    assert got.count() == 27 and got.where("v IS NOT NULL").count() == 2
    by_xyz = spark.createDataFrame([(0.5, 0.5, 1.5, 9.0)], "x double, y double, z double, v double")
    assert rows(demo.merge(by_xyz).df.where("v = 9").select("block_id")) == [(1,)]
    with pytest.raises(ModelError, match="exist"):
        demo.merge(extra.withColumnRenamed("v", "depth"))
    with pytest.raises(ModelError, match="repeat"):
        demo.merge(extra.union(extra))


def test_nearest_and_orders(demo):
    assert demo.nearest(1, 1, 1).first()["block_id"] == 0
    assert [r[0] for r in rows(demo.grid_order().select("block_id"))][:4] == [0, 9, 18, 3]


# schemas


def test_dependencies():
    schema = BlockSchema((Rule("c", expr="b + 1"), Rule("b", expr="a * volume"), Rule("x", expr="y"), Rule("y", expr="x")))
    assert [r.name for r in needed(definitions(schema, G), ["c"])] == ["volume", "b", "c"]
    with pytest.raises(SchemaError, match="cycle"):
        needed(definitions(schema, G), ["x"])


def test_persisted_columns(spark):
    df = spark.createDataFrame([(0, 0.12345, 2.0, "z")], "block_id int, deposit double, density double, waste string")
    schema = BlockSchema((Rule("code", alias_of="deposit", decimals=3), Rule("plus", expr="code + 1"), Rule("later", expr="plus * 2", required=False), Rule("name", lookup=Lookup("density", {2.0: "Low"}, "Unknown")), Rule("twice", function=Function(lambda d, k: d * k, ("density",), {"k": 2})), Rule("density")), strict="filter")
    out = persist_plan(df, schema, None)
    assert out.columns == ["block_id", "code", "density", "plus", "name", "twice"]
    assert rows(out) == [(0, 0.123, 2.0, 1.123, "Low", 4.0)]


def test_lookups_default(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 9.0), (2, None)], "block_id int, density double")
    schema = BlockSchema((Rule("name", lookup=Lookup("density", "names", "Unknown"), required=False),))
    m = BlockModel(df, Geometry(shape=(1, 1, 3)), schema, Engine().with_resolvers(names={2.0: "Low"}))
    assert sorted(rows(m.select(["block_id", "name"], index=None))) == [(0, "Low"), (1, "Unknown"), (2, "Unknown")]


def test_violations_are_all_reported(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, None, "b"), (2, float("nan"), "c"), (3, 99.0, "a")], "block_id int, v double, t string")
    schema = BlockSchema((Rule("v", "double", least=2, most=50), Rule("t", "int", allowed=("a", "b")), Rule("gone"), Rule("maybe", required=False)), strict=True)
    got = {(r[0], r[1]): r[2] for r in rows(violations(df, schema))}
    assert got == {("v", "null"): 2, ("v", "too small"): 1, ("v", "too large"): 1, ("t", "type string"): 1, ("t", "not allowed"): 1, ("gone", "missing"): 1}


def test_yaml_round_trip():
    schema = BlockSchema((Rule("a", "double", title="A", description="first", least=0.0), Rule("b", expr="a * 2", required=False, is_attribute=False), Rule("c", lookup=Lookup("a", {1.0: "x"}, "y")), Rule("d", function=Function("f", ("a",), {"k": 1})), Rule("e", alias_of="q", decimals=2, compression="zstd"), Rule("t", allowed=("u", "v"))), strict="filter")
    assert BlockSchema.from_yaml(schema.to_yaml()) == schema
    assert descriptions(schema, ["a", "b"]) == {"a": "A - first"}
    assert attribute_flags(schema, G, ["block_id", "a"])["b"] is False


# storage


def test_store(spark, demo, tmp_path):
    path = f"{tmp_path}/m.pbm"
    m = store.save(demo.with_schema(BlockSchema((Rule("depth"),))), path)
    assert m.count() == 27 and m.geometry == G and m.schema.rule("depth")
    with pytest.raises(ModelError, match="exists"):
        store.save(demo, path)
    twice = store.strict_write(m, m.df.withColumn("depth", F.col("depth") * 2), path)  # replaces what it reads
    assert twice.df.agg(F.sum("depth")).first()[0] == 27 * 1.5 * 2
    with pytest.raises(ModelError, match="lost"):
        store.strict_write(twice, twice.df.drop("depth"), path)
    with pytest.raises(ModelError, match="rows"):
        store.strict_write(twice, twice.df.limit(3), path)
    moved = store.rename(spark, path, f"{tmp_path}/n.pbm")
    assert moved.count() == 27
    for a, b in ((path, f"{tmp_path}/o.pbm"), (f"{tmp_path}/n.pbm", f"{tmp_path}/n.pbm"), (f"{tmp_path}/n.pbm", f"{tmp_path}/n.txt")):
        with pytest.raises(ModelError):
            store.rename(spark, a, b)


def test_single_file_with_a_footer(spark, demo, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.Table.from_pandas(demo.df.toPandas(), preserve_index=False)
    g = Geometry.create(shape=(3, 3, 3), azimuth=30, origin=(5, 5, 5))
    pq.write_table(table.replace_schema_metadata({"some": "thing", "model": json.dumps({"geometry": g.to_payload(), "schema_yaml": "columns: {depth: {title: Depth}}"})}), f"{tmp_path}/a.pbm")
    m = store.open_single_file(spark, f"{tmp_path}/a.pbm")
    assert m.geometry == g and m.schema.rule("depth").title == "Depth"
    with pytest.raises(ModelError):
        store.open_single_file(spark, f"{tmp_path}/a.txt")


def test_compression_policies():
    assert store.active_codec("fast") == store.active_codec(0) == store.active_codec("Snappy") == ("snappy", None)
    assert store.active_codec(7) == ("zstd", 7)
    for bad in ("lz", 40, True):
        with pytest.raises(ValueError):
            store.active_codec(bad)


def test_ingest(spark, tmp_path):
    g = Geometry((10, 20, -1), (2, 1, 0.5), (4, 3, 2))
    xyz = g.grid(spark).select("x", "y", "z", F.col("x").alias("v"))
    m = store.ingest(xyz)
    assert m.geometry.corner == g.corner and m.geometry.shape == g.shape and m.geometry.block_size == g.block_size
    turned = Geometry.create(shape=(5, 4, 3), azimuth=35, dip=12, plunge=8, origin=(100, 200, 50))
    found = store.ingest(turned.grid(spark).select("x", "y", "z"), azimuth=35, dip=12, plunge=8)
    assert found.geometry.shape == (5, 4, 3) and found.df.count() == 60
    xyz.write.option("header", True).csv(f"{tmp_path}/s.csv")
    assert store.from_csv(spark, f"{tmp_path}/s.csv").df.count() == 24
    with pytest.raises(ModelError, match="missing"):
        xyz.drop("z").write.option("header", True).csv(f"{tmp_path}/t.csv")
        store.from_csv(spark, f"{tmp_path}/t.csv")
    with pytest.raises(ModelError, match="unique"):
        store.ingest(xyz.union(xyz), g)


def test_catalog(spark, tmp_path):
    for site, period, name in (("alpha", "base", "a"), ("alpha", "opt", "b"), ("beta", "base", "c")):
        store.save(BlockModel.from_geometry(spark, Geometry(shape=(2, 2, 2))), f"{tmp_path}/site={site}/period={period}/{name}.pbm")
    c = catalog.Catalog.discover(spark, str(tmp_path))
    assert sorted(rows(c.df.select("name", "site", "period"))) == [("a", "alpha", "base"), ("b", "alpha", "opt"), ("c", "beta", "base")]
    assert rows(c.options("period", site="alpha", name="c")) == [("base",), ("opt",)]
    assert c.open(site="beta").count() == 8
    for bad in ({"site": "alpha"}, {"site": "gamma"}, {"what": "x"}):
        with pytest.raises(LookupError):
            c.select(**bad)


def test_union_and_world_join(spark):
    a = BlockModel.from_dataframe(G.grid(spark).select("block_id", F.lit(1.0).alias("p")), G, name="a")
    b = BlockModel.from_dataframe(G.grid(spark).where("block_id < 5").select("block_id", F.lit(2.0).alias("q")), G, name="b")
    assert a.join_on_world_id(b).count() == 5 and a.join_on_world_id(b, "left_anti").count() == 22
    both = a.union(b)
    assert both.count() == 32 and both.where("p IS NULL").count() == 5
    other = BlockModel.from_dataframe(G.grid(spark).select("block_id"), Geometry(shape=(3, 3, 3), origin=(1, 0, 0)))
    with pytest.raises(ModelError):
        a.join_on_world_id(other)


def test_order_of_columns():
    assert ordered(["v", "z", "block_id", "u"]) == ["block_id", "z", "v", "u"]


def test_stream_ingest(spark, tmp_path):
    from gridloom.streaming import ingest

    g = Geometry(shape=(2, 2, 2))
    source = g.grid(spark).select("block_id", F.current_timestamp().alias("at"))
    source.union(source).write.parquet(f"{tmp_path}/in")
    q = ingest.write_blocks(ingest.read_blocks(spark, f"{tmp_path}/in", source.schema, g, "at"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 8 and out.columns[:7] == ["block_id", "i", "j", "k", "x", "y", "z"]


def test_stream_windows(spark, tmp_path):
    from gridloom.streaming import ingest

    g = Geometry(shape=(1, 1, 4), block_size=(2, 2, 2))
    rows = spark.createDataFrame([(0, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 03:00:00")], "block_id int, at string").select("block_id", F.to_timestamp("at").alias("at"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = ingest.windowed_volume(stream, g, "at").writeStream.format("memory").queryName("volumes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["blocks"], r["volume"]) for r in spark.table("volumes").collect()) == [(1, 8.0), (2, 16.0)]
