"""Shapes of queries that an index may answer, the stored index, joins by distance, and plans that work out a distance once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanvec.operators import knn
from spanvec.operators.ivf import IvfIndex, recall
from spanvec.operators.knn import KnnPlan, knn_join, nearest
from spanvec.plans.engine import Engine
from spanvec.plans.registry import IndexConfig, LoadingResolver, Registry, TableConfig

Q = "ARRAY[0.5, -0.25, 0.125]"
FUNCTIONS = {"l2sq": "l2_distance", "cos": "cosine_distance", "ip": "negative_dot_product"}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), ["red", "green", "blue"][i % 3], rng.normal(size=3).astype("f4").tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id long, colour string, place array<float>").cache()


@pytest.fixture(scope="module", params=FUNCTIONS)
def engine(request, spark, points, tmp_path_factory):
    config = IndexConfig(3, request.param, lists=4)
    index = IvfIndex.build(points, "id", "place", config, f"{tmp_path_factory.mktemp('shapes')}/ivf")
    e = Engine(spark)
    e.add_table("lake.map.points", "place", scan=points, lookup=points.select("id", "colour"), key="id", config=config, table=TableConfig(approximate=True, nprobe=4), index=index)
    return e


#: {d}: a distance to the literal; whether a registered index of that metric may answer.
SHAPES = {
    "SELECT id, {d} AS dist FROM points ORDER BY dist LIMIT 5": True,
    "SELECT id, {d} AS dist FROM points ORDER BY dist ASC NULLS LAST LIMIT 5": True,
    "SELECT *, {d} AS dist FROM points ORDER BY dist LIMIT 5": True,
    "SELECT * FROM points ORDER BY {d} LIMIT 5": True,
    "SELECT id FROM points ORDER BY {d}, id LIMIT 5": True,
    "SELECT id, colour FROM points WHERE colour = 'red' ORDER BY {d} LIMIT 5": True,
    "SELECT id, {d} AS dist FROM points WHERE colour = 'red' AND id > 3 ORDER BY dist LIMIT 5": True,
    "SELECT * FROM points WHERE id > 3 ORDER BY {d} LIMIT 5": True,
    "SELECT place FROM points ORDER BY {d} LIMIT 5": True,
    "SELECT {d} FROM points ORDER BY {d} LIMIT 5": True,
    "SELECT {d} AS dist FROM points ORDER BY dist LIMIT 5": True,
    "SELECT id + 1 AS next_id, {d} AS dist FROM points ORDER BY dist LIMIT 5": True,
    "SELECT id, {d} AS dist FROM lake.map.points ORDER BY dist LIMIT 5": True,
    "SELECT * FROM lake.map.points ORDER BY {d} LIMIT 5": True,
    "SELECT id FROM lake.map.points WHERE colour <> 'red' ORDER BY {d} LIMIT 5": True,
    "SELECT {d} AS dist FROM lake.map.points ORDER BY dist LIMIT 5": True,
    "SELECT p.id FROM points AS p ORDER BY {p} LIMIT 5": True,
    "SELECT p.id, {p} AS dist FROM points AS p WHERE p.id > 3 ORDER BY dist LIMIT 5": True,
    "SELECT id, {d} AS dist FROM (SELECT * FROM points AS a) AS b ORDER BY dist LIMIT 5": True,
    "SELECT * FROM (SELECT * FROM (SELECT * FROM points) a) b ORDER BY {d} LIMIT 5": True,
    "SELECT id FROM (SELECT * FROM points WHERE colour = 'red') a ORDER BY {d} LIMIT 5": True,
    "SELECT id FROM (SELECT * FROM points WHERE id > 3) a WHERE colour = 'red' ORDER BY {d} LIMIT 5": False,
    "SELECT id FROM points ORDER BY {d}": False,
    "SELECT id FROM points ORDER BY {d} DESC LIMIT 5": False,
    "SELECT id FROM points ORDER BY colour, {d} LIMIT 5": False,
    "SELECT id FROM points ORDER BY {d} + 1 LIMIT 5": False,
    "SELECT id FROM points LIMIT 5": False,
    "SELECT id FROM points ORDER BY id LIMIT 5": False,
    "SELECT a.id FROM points a JOIN points b ON a.id = b.id + 1 ORDER BY {a} LIMIT 5": False,
    "SELECT colour, count(*) AS n FROM points GROUP BY colour ORDER BY n LIMIT 5": False,
    "SELECT id FROM points ORDER BY {d} LIMIT 5 OFFSET 2": False,
}


@pytest.mark.parametrize("sql", SHAPES)
def test_shapes(engine, points, sql):
    """The right shape and metric match; with every list read, or exactly, the answer is that of no index at all."""
    own = engine.registry.peek("lake::map::points::place").config.metric
    for metric, f in FUNCTIONS.items():
        text = sql.format(d=f"{f}(place, {Q})", p=f"{f}(p.place, {Q})", a=f"{f}(a.place, {Q})")
        assert (engine.plan(text) is not None) == (SHAPES[sql] and metric == own)
    text = sql.format(**{k: f"{FUNCTIONS[own]}({v}place, {Q})" for k, v in {"d": "", "p": "p.", "a": "a."}.items()})
    got = engine.sql(text).collect()
    assert (engine.last_query_stats["path"] == "index") == SHAPES[sql]
    plain = Engine(engine.spark)
    plain.views = dict(engine.views)
    want = plain.sql(text).collect()
    if "LIMIT 5" in sql and "ORDER BY" not in sql or "GROUP BY" in sql:
        assert len(got) == len(want)
    else:
        assert [str(r) for r in got] == [str(r) for r in want]


@pytest.mark.parametrize("metric", FUNCTIONS)
def test_distance_is_worked_out_once(points, metric):
    plan = nearest(points, "place", [0.5, -0.25, 0.125], 3, metric, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"aggregate\(", plan)) == 1


def test_nearest_leaves_out_null_and_nan(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [None, 1.0]), (5, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for metric, want in (("l2sq", [1, 5]), ("cos", [1, 5]), ("ip", [1, 5])):
        assert [r.id for r in nearest(df, "v", [1.0, 0.0], 5, metric, "id").collect()] == want


@pytest.mark.parametrize("metric", FUNCTIONS)
def test_knn_join(spark, points, metric, monkeypatch):
    """Against single searches, in small blocks; ties by key; rows without a usable vector have no part."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(knn, "ROW_BLOCK", 7)
    odd = spark.createDataFrame([(100, "x", None), (101, "x", [None, 1.0, 1.0]), (102, "x", [float("nan"), 0.0, 0.0]), (103, "x", points.where("id = 4").first().place)], points.schema)
    right, left = points.unionByName(odd), points.where("id % 6 = 4").unionByName(odd)
    got = knn_join(left.select(F.col("id").alias("q"), F.col("place").alias("v")), right, "v", "place", 4, "q", "id", metric).collect()
    for q in left.collect():
        own = sorted([(r._distance, r.id) for r in got if r.q == q.id])
        if q.id in (100, 101, 102):
            assert own == []
        else:
            assert own == [(r._distance, r.id) for r in nearest(right, "place", q.place, 4, metric, "id").collect()]
    assert knn_join(points.limit(0).select(F.col("id").alias("q"), F.col("place").alias("v")), right, "v", "place", 4, "q", "id").count() == 0


def test_knn_join_refuses_mixed_lengths(spark, points):
    short = spark.createDataFrame([(1, [1.0, 2.0])], "q long, v array<float>")
    with pytest.raises(Exception, match="must match"):
        knn_join(short, points, "v", "place", 2, "q", "id").collect()
    mixed = points.select("id", "place").unionByName(spark.createDataFrame([(99, [1.0])], "id long, place array<float>"))
    with pytest.raises(Exception, match="must match"):
        knn_join(points.select(F.col("id").alias("q"), F.col("place").alias("v")), mixed.coalesce(1), "v", "place", 2, "q", "id").collect()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = f"{tmp_path_factory.mktemp('stored')}/ivf"
    return e, path, IvfIndex.build(e, "vec_id", "embedding", IndexConfig(64), path)


def test_stored_index(spark, stored):
    """An index that is opened again is the one that was built; a search reads the folders of its lists only."""
    e, path, built = stored
    q = e.where("vec_id = 5").first().embedding
    two = built.order(q)[:2]
    plan = nearest(built.lists.where(F.col("list_id").isin(two)), "embedding", q, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list_id", plan)
    for again in (IvfIndex.view(spark, path), IvfIndex.load(spark, path)):
        assert again.config == built.config and again.size == 2000 and (again.centroids == built.centroids).all()
        assert again.search(spark, q, 10, 12).collect() == built.search(spark, q, 10, 12).collect()
    assert built.lists.count() == 2000


@pytest.mark.parametrize("where", [None, "label < 5", "vec_id % 3 = 0"])
def test_recall_with_and_without_filters(spark, stored, where):
    e, _, index = stored
    rows = e if where is None else e.where(where)
    hit, queries = 0.0, [r[0] for r in e.where("vec_id % 250 = 0").select("embedding").collect()]
    for q in queries:
        hit += recall(index.search(spark, q, 10, TableConfig().nprobe, None if where is None else rows), nearest(rows, "embedding", q, 10, key="vec_id"), "vec_id")
    assert hit / len(queries) >= 0.9


def test_index_without_a_path_is_not_searched(spark, points):
    index = IvfIndex.build(points, "id", "place", IndexConfig(3, lists=4))
    r = Registry()
    r.add("a::b::c::place", points, points, "id", "place", IndexConfig(3), TableConfig(approximate=True), index)
    stats = {}
    assert KnnPlan("c", r.get("a::b::c::place"), (0.5, 0.0, 0.0), 3).execute(stats).count() == 3 and stats["path"] == "exact"
    with pytest.raises(ValueError, match="not stored"):
        index.search(spark, [0.5, 0.0, 0.0], 3, 1)


def test_index_of_an_empty_table(spark, points, tmp_path):
    index = IvfIndex.build(points.limit(0), "id", "place", IndexConfig(3), f"{tmp_path}/ivf")
    assert IvfIndex.view(spark, f"{tmp_path}/ivf").search(spark, [1.0, 0.0, 0.0], 3, 1).count() == index.size == 0


def test_resolvers(spark, points):
    r, name = Registry(), "a::b::points::place"
    entry = r.add(name, points, points, "id", "place", IndexConfig(3))
    assert r.peek(name).config.dimensions == 3 and r.peek(name).key == "id" and r.resolve(name) is r.prepare(name) is entry
    assert r.peek("x") is None and r.resolve("x") is None
    with pytest.raises(LookupError, match="is not loaded"):
        r.prepare("x")
    loads = []
    lazy = LoadingResolver({name: r.peek(name)}, lambda n: loads.append(n) or entry)
    assert lazy.peek(name) == r.peek(name) and lazy.resolve(name) is None and lazy.names() == [name]
    assert lazy.prepare(name) is lazy.prepare(name) is lazy.resolve(name) is entry and loads == [name]
    with pytest.raises(LookupError, match="is not loaded"):
        lazy.prepare("x")
    snapshot = r.prepare(name)
    r.configure(name, nprobe=1)
    assert snapshot.table.nprobe != 1 and r.get(name).table.nprobe == 1
