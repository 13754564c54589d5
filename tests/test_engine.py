"""Distances, keys, lookups, registry, search paths and SQL shapes on four rows."""

import datetime

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanvec.functions import keys
from spanvec.operators.ivf import IvfIndex, recall
from spanvec.operators.knn import KnnPlan, nearest, vector_search
from spanvec.plans import dialect
from spanvec.plans.engine import Engine
from spanvec.plans.registry import IndexConfig, Registry, TableConfig
from spanvec.sources import files
from spanvec.sources.lookup import ArrowLookup, Lookup, MemoryLookup, PackedParquetLookup, SidecarBuilder, open_or_build

Q = "ARRAY[1.0, 0.0, 0.0, 0.0]"
ROWS = [(1, "red", [1.0, 0.0, 0.0, 0.0]), (2, "green", [0.0, 1.0, 0.0, 0.0]), (3, "blue", [0.0, 0.0, 1.0, 0.0]), (4, "red", [0.0, 0.0, 0.0, 1.0])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, "id long, label string, vector array<float>").cache()


@pytest.fixture(scope="module")
def engine(spark, items, tmp_path_factory):
    e = Engine(spark)
    index = IvfIndex.build(items, "id", "vector", IndexConfig(4, lists=2), f"{tmp_path_factory.mktemp('index')}/ivf")
    e.add_table("lake.demo.items", "vector", scan=items, lookup=items.select("id", "label"), key="id", config=IndexConfig(4, lists=2), table=TableConfig(approximate=True, nprobe=2), index=index)
    return e


def test_distances(engine):
    r = engine.sql(f"SELECT id, l2_distance(vector, {Q}) AS a, cosine_distance(vector, {Q}) AS b, negative_dot_product(vector, {Q}) AS c FROM items ORDER BY id").collect()
    assert [tuple(x) for x in r] == [(1, 0.0, 0.0, -1.0), (2, 2.0, 1.0, 0.0), (3, 2.0, 1.0, 0.0), (4, 2.0, 1.0, 0.0)]


def test_zero_vector_null_and_mismatch(spark, engine):
    df = spark.createDataFrame([(1, [0.0] * 4), (2, None)], "id long, vector array<float>")
    df.createOrReplaceTempView("odd")
    assert [x[0] for x in engine.sql(f"SELECT cosine_distance(vector, {Q}) FROM odd ORDER BY id").collect()] == [1.0, None]
    for sql in (f"SELECT l2_distance(vector, ARRAY[1.0]) FROM odd WHERE id = 1", "SELECT l2_distance(vector, array(1.0, 2.0)) FROM odd WHERE id = 1"):
        with pytest.raises(Exception, match="must match"):
            engine.sql(sql).collect()
        with pytest.raises(Exception, match="must match"):
            spark.sql(dialect.arrays(sql)).collect()
    with pytest.raises(ValueError, match="expected 2 arguments"):
        engine.sql("SELECT l2_distance(vector) FROM odd")


def test_registered_form_equals_native(spark, engine):
    a = engine.sql(f"SELECT id, l2_distance(vector, {Q}) AS d FROM items").collect()
    b = spark.sql(dialect.arrays(f"SELECT id, l2_distance(vector, {Q}) AS d FROM items")).collect()
    assert sorted(a) == sorted(b)


SHAPES = [
    (f"SELECT id, l2_distance(vector, {Q}) AS d FROM items ORDER BY d LIMIT 2", True),
    (f"SELECT id FROM items ORDER BY l2_distance(vector, {Q}) LIMIT 2", True),
    (f"SELECT * FROM items ORDER BY l2_distance(vector, {Q}) LIMIT 2", True),
    (f"SELECT id FROM items WHERE label = 'red' ORDER BY l2_distance(vector, {Q}) LIMIT 2", True),
    (f"SELECT id FROM lake.demo.items ORDER BY l2_distance(vector, {Q}) LIMIT 2", True),
    (f"SELECT id FROM items ORDER BY l2_distance(vector, {Q})", False),
    (f"SELECT id FROM items ORDER BY l2_distance(vector, {Q}) DESC LIMIT 2", False),
    (f"SELECT id FROM items ORDER BY cosine_distance(vector, {Q}) LIMIT 2", False),
    (f"SELECT id FROM items ORDER BY label, l2_distance(vector, {Q}) LIMIT 2", False),
    ("SELECT id FROM items ORDER BY l2_distance(vector, vector) LIMIT 2", False),
    ("SELECT id FROM items ORDER BY id LIMIT 2", False),
]


@pytest.mark.parametrize("sql,matches", SHAPES)
def test_shapes(engine, sql, matches):
    assert (engine.plan(sql) is not None) == matches
    assert engine.sql(sql).count() == (4 if "LIMIT" not in sql else 2)


def test_ordering_and_filters(engine):
    assert engine.sql(f"SELECT id FROM items ORDER BY l2_distance(vector, {Q}) DESC, id LIMIT 3").collect() == [(2,), (3,), (4,)]
    assert engine.sql(f"SELECT id FROM items WHERE label = 'red' ORDER BY l2_distance(vector, {Q}) LIMIT 9").collect() == [(1,), (4,)]
    assert engine.sql(f"SELECT id FROM items WHERE label = 'none' ORDER BY l2_distance(vector, {Q}) LIMIT 9").collect() == []


def test_table_function(engine):
    call = f"vector_search_vector('lake.demo.items', 'vector', {Q}, 2)"
    assert engine.sql(f"SELECT id, label, _distance FROM {call} ORDER BY _distance, id LIMIT 1").collect() == [(1, "red", 0.0)]
    for bad, error in ((call.replace("lake.demo.items", "a.b"), "Expected 'connection.schema.table'"), (call.replace("items", "none"), "no loaded vector index"), (call.replace(", 2)", ")"), "expected 4 arguments"), (call.replace(", 2)", ", -1)"), "not be")):
        with pytest.raises((ValueError, LookupError), match=error if error != "not be" else "below zero"):
            engine.sql(f"SELECT * FROM {bad}")


def test_dialect_leaves_strings_alone():
    text = "SELECT 'ARRAY[1]' AS a, \"l2_distance(x)\" -- l2_distance(y)\nFROM t"
    assert dialect.expand_distances(dialect.arrays(text)) == text
    assert dialect.arrays("ARRAY[ARRAY[1], ARRAY[2]][0]") == "array(array(1), array(2))[0]"


def test_registry_messages(items):
    r = Registry()
    with pytest.raises(ValueError, match="not in the lookup schema"):
        r.add("a", items, items.select("label"), "id", "vector", IndexConfig(4))
    with pytest.raises(ValueError, match="not in the scan schema"):
        r.add("a", items.select("vector"), items, "id", "vector", IndexConfig(4))
    r.add("a::b::c::v", items, items, "id", "vector", IndexConfig(4))
    assert r.get("a::b::c::v").schema.fieldNames()[-1] == "_distance"
    assert r.remove_by_prefix("a::b") == 1 and r.get("a::b::c::v") is None


def test_adaptive_paths(engine):
    entry = engine.registry.get("lake::demo::items::vector")
    stats = {}
    got = KnnPlan("items", entry, (1.0, 0.0, 0.0, 0.0), 2, ("label = 'none'",)).execute(stats)
    assert got.count() == 0 and stats["path"] == "exact" and stats["valid_rows"] == 0
    stats = {}
    got = KnnPlan("items", entry, (1.0, 0.0, 0.0, 0.0), 9, ("id > 1",)).execute(stats)
    assert got.count() == 3 and stats["path"] == "index"
    with pytest.raises(ValueError, match="must match"):
        KnnPlan("items", entry, (1.0,), 2).execute()
    assert "filters=[id > 1]" in KnnPlan("items", entry, (1.0,), 2, ("id > 1",)).explain()


def test_ivf_recall(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = IvfIndex.build(e, "vec_id", "embedding", IndexConfig(64), f"{tmp_path}/ivf")
    hit, queries = 0.0, [r[0] for r in e.where("vec_id % 200 = 0").select("embedding").collect()]
    for q in queries:
        hit += recall(index.search(spark, q, 10, TableConfig().nprobe), nearest(e, "embedding", q, 10, key="vec_id"), "vec_id")
    assert hit / len(queries) >= 0.9


@given(st.integers(0, 2**16 - 1), st.integers(0, 2**16 - 1), st.integers(0, 2**32 - 1))
def test_packed_keys(f, g, o):
    assert keys.unpack(keys.pack(f, g, o)) == (f, g, o)


def test_pack_overflow(spark):
    with pytest.raises(OverflowError):
        keys.pack(1 << 16, 0, 0)
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(keys.pack_columns(F.lit(0), F.lit(1 << 16), F.lit(0))).collect()
    with pytest.raises(ValueError, match="leaves its folder"):
        keys.DatasetLayout.from_files(["a/../b.parquet"])


def test_lookups(spark, tmp_path):
    df = spark.createDataFrame([(-5, "a"), (-1, "b"), (3, "c"), (10, None)], "k long, name string")
    with SidecarBuilder(spark, f"{tmp_path}/kv", "k") as b:
        b.push(df.where("k > 0"))
        b.push(df.where("k < 0"))
        store = b.finish()
    memory = MemoryLookup(df, "k")
    for wanted in ([], [-5], [10], [3, 3, -1], [99, -99], [4], [-5, -1, 3, 10]):
        model = sorted(k for k in {*wanted} if k in (-5, -1, 3, 10))
        assert [r.k for r in store.fetch_by_keys(wanted).collect()] == model
        assert sorted(r.k for r in memory.fetch_by_keys(wanted).collect()) == model
    assert len(memory) == 4 and store.fetch_by_keys([3], ["name", "k"]).columns == ["name", "k"]
    with pytest.raises(ValueError, match="null or repeated"), SidecarBuilder(spark, f"{tmp_path}/dup", "k") as b:
        b.push(df)
        b.push(df.limit(1))
        b.finish()
    assert not (tmp_path / "dup").exists() and not list(tmp_path.glob("dup.staging*"))
    with pytest.raises(TypeError, match="must be an integer"):
        Lookup(df, "name")


def test_memory_lookup_keeps_the_last(spark):
    df = spark.createDataFrame([(1, "old", 0), (1, "new", 1), (None, "x", 2)], "k long, v string, at int")
    m = MemoryLookup(df, "k", "at")
    assert [r.v for r in m.fetch_by_keys([1]).collect()] == ["new"] and len(m) == 1 and m.scan().count() == 3


def test_open_or_build_and_packed(spark, tmp_path):
    spark.createDataFrame([("alice",), ("bob",), ("carol",)], "name string").coalesce(1).write.parquet(f"{tmp_path}/in")
    (file,) = map(str, (tmp_path / "in").glob("*.parquet"))
    store = open_or_build(spark, f"{tmp_path}/kv", "id", [file])
    assert [tuple(r) for r in store.fetch_by_keys([0, 2, 7]).collect()] == [(0, "alice"), (2, "carol")]
    assert open_or_build(spark, f"{tmp_path}/kv", "id", []).scan().count() == 3
    packed = PackedParquetLookup(spark, keys.DatasetLayout.from_files([file]))
    assert [r.name for r in packed.fetch_by_keys([keys.pack(0, 0, 2), keys.pack(0, 0, 0), keys.pack(0, 0, 9), keys.pack(0, 0, 2)]).collect()] == ["alice", "carol"]
    with pytest.raises(IndexError, match="file_idx=5"):
        packed.fetch_by_keys([keys.pack(5, 0, 0)])


def test_sqlite_and_ipc(spark, engine, tmp_path):
    day = datetime.date(2024, 2, 29)
    df = spark.createDataFrame([(1, 'a"b', [1, 2], True, day, 0.5), (7, None, None, None, None, None)], 'id long, `na"me` string, xs array<long>, flag boolean, day date, x double')
    files.write_sqlite(df, f"{tmp_path}/t.db", 'odd "table', "id")
    back = spark.read.format("sqlite_table").option("path", f"{tmp_path}/t.db").option("table", 'odd "table').load()
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(1, 'a"b', [1, 2], True, day, 0.5), (7, None, None, None, None, None)]
    with pytest.raises(TypeError, match="price"):
        files.write_sqlite(spark.sql("SELECT 1L AS id, 1.50BD AS price"), f"{tmp_path}/u.db", "t", "id")
    table = pa.table({"k": [1, 2, 3], "v": ["x", None, "z"]})
    with pa.OSFile(f"{tmp_path}/f.arrow", "wb") as sink, pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table, max_chunksize=2)
    assert spark.read.format("arrow_ipc").option("path", f"{tmp_path}/f.arrow").load().orderBy("k").collect() == [(1, "x"), (2, None), (3, "z")]


def test_streaming_feed(spark, tmp_path):
    from spanvec.streaming import ingest

    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/src")
    b = SidecarBuilder(spark, f"{tmp_path}/kv", "id")
    ingest.feed(spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/src"), b, f"{tmp_path}/cp").awaitTermination(60)
    assert b.finish().scan().count() == 10


def test_vector_search_arguments(engine):
    with pytest.raises(ValueError, match="below zero"):
        vector_search(engine.registry, "lake.demo.items", "vector", [1.0, 0, 0, 0], -1)


@pytest.mark.parametrize("where, k, want", [("", 4, [1, 2, 3, 4]), ("WHERE label <> 'green'", 3, [1, 3, 4]), ("WHERE label = 'green'", 2, [2]), ("WHERE id > 9", 1, [])])
def test_sql_index_widens_to_whole_results(spark, items, tmp_path, where, k, want):
    e = Engine(spark)
    index = IvfIndex.build(items, "id", "vector", IndexConfig(4, lists=4), f"{tmp_path}/ivf")
    e.add_table("a.b.widening", "vector", scan=items, lookup=items, key="id", config=IndexConfig(4, lists=4), table=TableConfig(approximate=True, nprobe=1), index=index)
    found = e.sql(f"SELECT id FROM widening {where} ORDER BY l2_distance(vector, {Q}), id LIMIT {k}").collect()
    assert sorted(r["id"] for r in found) == want
    few = where == "WHERE id > 9"
    assert e.last_query_stats["path"] == ("exact" if few else "index") and e.last_query_stats["filtered"] == bool(where)
    if where:
        assert e.last_query_stats["selectivity"] == len(items.where(where[6:]).collect()) / 4


def test_arrow_ipc_builder(spark, tmp_path):
    path, rows = f"{tmp_path}/store", [(-5, "a"), (3, "b"), (-1, None), (10, "c")]
    files.write_arrow_ipc(spark.createDataFrame(rows, "rowid long, name string").repartition(3), path, "rowid")
    store = ArrowLookup(spark, path, "rowid")
    assert [r["rowid"] for r in store.scan().collect()] == [3, 10, -5, -1]
    assert [tuple(r) for r in store.fetch_by_keys([-1, 3, 99, 3, -5]).collect()] == [(3, "b"), (-5, "a"), (-1, None)]
    assert [r["name"] for r in store.fetch_by_keys([-5, 10], ["name"]).collect()] == ["c", "a"]
    with pytest.raises(FileExistsError):
        files.write_arrow_ipc(spark.range(1), path, "id")
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            files.write_arrow_ipc(spark.createDataFrame(bad, "rowid long, name string"), f"{tmp_path}/bad", "rowid")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["store"]
    files.write_arrow_ipc(spark.range(0), f"{tmp_path}/none", "id")
    assert ArrowLookup(spark, f"{tmp_path}/none", "id").is_empty


def test_arrow_ipc_keys_must_rise(spark, tmp_path):
    for n, ids in enumerate(([2, 1], [1, 1], [1, None])):
        table = pa.table({"id": pa.array(ids, pa.int64())})
        with pa.ipc.new_file(f"{tmp_path}/{n}.arrow", table.schema) as w:
            w.write_table(table)
        with pytest.raises(ValueError):
            ArrowLookup(spark, f"{tmp_path}/{n}.arrow", "id")
