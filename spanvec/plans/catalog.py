"""Queries over the reference tables, with SQL that gives the same rows.

Vector queries search for vector 0.  ``{table}`` in a host query stands for a
table; the same text runs on Spark and in the SQL check unless it is given twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.distance import MACROS, METRICS, distance
from ..operators.ivf import IvfIndex
from ..operators.knn import KnnPlan, knn_join, nearest, vector_search
from ..sources import files
from ..sources.lookup import ArrowLookup, Lookup, MemoryLookup, PackedParquetLookup, SidecarBuilder, SqliteLookup, open_or_build
from ..sources.workspace import work_path
from ..streaming import ingest
from .engine import Engine
from .registry import IndexConfig, Registry, TableConfig

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Indexes stored in this session, by table: an index is built once and then searched.
_STORED: dict[tuple[str, str], str] = {}

_TERM = {"l2sq": "(v[i]::DOUBLE - qv[i]::DOUBLE) * (v[i]::DOUBLE - qv[i]::DOUBLE)", "dot": "v[i]::DOUBLE * qv[i]::DOUBLE", "vv": "v[i]::DOUBLE * v[i]::DOUBLE", "qq": "qv[i]::DOUBLE * qv[i]::DOUBLE"}


def _duck(metric: str, v: str = "embedding", q: str = "qv") -> str:
    def total(term: str) -> str:
        t = re.sub(r"\bqv\b", "\0", _TERM[term])
        return f"list_reduce(list_transform(range(1, len({v}) + 1), lambda i: {re.sub(r'\bv\b', v, t).replace(chr(0), q)}), lambda a, b: a + b)"

    if metric == "l2sq":
        return f"{total('l2sq')}::FLOAT"
    if metric == "ip":
        return f"(-{total('dot')})::FLOAT"
    return f"(1 - {total('dot')} / (sqrt({total('vv')}) * sqrt({total('qq')})))::FLOAT"


_Q = "CROSS JOIN (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector(spark: SparkSession, sf: str, i: int = 0) -> list[float]:
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == i).select("embedding").first()[0])


def engine(spark: SparkSession, sf: str) -> Engine:
    """An engine with ``embeddings`` registered three times, once a metric."""
    e = Engine(spark)
    e.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    emb = table(spark, sf, "embeddings")
    e.add_table("main.public.embeddings", "embedding", scan=emb, lookup=emb.select("vec_id", "label"), key="vec_id", config=IndexConfig(64))
    return e


def add(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def host(name: str, sql: str, duck: str | None = None) -> None:
    """A query that is SQL on both sides."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    QUERIES[name] = lambda spark, sf: spark.sql(sql, **{t: table(spark, sf, t) for t in used})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck or sql)


def _literal(spark: SparkSession, sf: str) -> str:
    return "ARRAY[" + ", ".join(repr(float(x)) for x in vector(spark, sf)) + "]"


def vector_sql(name: str, sql: str, duck: str) -> None:
    """A query through the engine's SQL; $q is the literal vector 0."""
    QUERIES[name] = lambda spark, sf: engine(spark, sf).sql(sql.replace("$q", _literal(spark, sf)))
    ORACLES[name] = duck


def _knn_duck(metric: str, cols: str = "vec_id, label", k: int = 10, where: str = "", tail: str = "") -> str:
    return f"SELECT {cols}, {_duck(metric)} AS dist FROM embeddings {_Q} {where} ORDER BY dist, vec_id LIMIT {k} {tail}"


def _register() -> None:
    for m, f in METRICS.items():
        short = {"l2sq": "l2", "cos": "cosine", "ip": "negdot"}[m]
        vector_sql(f"{f}_all", f"SELECT vec_id, {f}(embedding, $q) AS dist FROM embeddings", f"SELECT vec_id, {_duck(m)} AS dist FROM embeddings {_Q}")
        vector_sql(f"knn_{short}", f"SELECT vec_id, label, {f}(embedding, $q) AS dist FROM embeddings ORDER BY dist ASC NULLS LAST, vec_id LIMIT 10", _knn_duck(m))
    l2, d2 = "l2_distance(embedding, $q)", _duck("l2sq")
    inner = f"(SELECT *, {d2} AS dist FROM embeddings {_Q})"
    vector_sql("l2_self_zero", f"SELECT vec_id, {l2} AS dist FROM embeddings WHERE vec_id = 0", f"SELECT vec_id, dist FROM {inner} WHERE vec_id = 0")
    vector_sql("range_search_l2", f"SELECT vec_id, {l2} AS dist FROM embeddings WHERE {l2} < 1.5", f"SELECT vec_id, dist FROM {inner} WHERE dist < 1.5")
    vector_sql("knn_trimmed", f"SELECT vec_id, label FROM embeddings ORDER BY {l2} ASC NULLS LAST, vec_id LIMIT 10", f"SELECT vec_id, label FROM {inner} ORDER BY dist, vec_id LIMIT 10")
    vector_sql("knn_select_star", f"SELECT * FROM embeddings ORDER BY {l2} ASC NULLS LAST, vec_id LIMIT 5", f"SELECT vec_id, embedding, label FROM {inner} ORDER BY dist, vec_id LIMIT 5")
    vector_sql("knn_only_distance", f"SELECT {l2} AS d FROM embeddings ORDER BY d ASC NULLS LAST LIMIT 10", f"SELECT dist AS d FROM {inner} ORDER BY d LIMIT 10")
    vector_sql("knn_computed_projection", f"SELECT CAST(vec_id + 1 AS BIGINT) AS next_id, {l2} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 10", f"SELECT CAST(vec_id + 1 AS BIGINT) AS next_id, dist FROM {inner} ORDER BY dist, vec_id LIMIT 10")
    vector_sql("knn_desc", f"SELECT vec_id, {l2} AS dist FROM embeddings ORDER BY dist DESC, vec_id LIMIT 10", f"SELECT vec_id, dist FROM {inner} ORDER BY dist DESC, vec_id LIMIT 10")
    vector_sql("knn_no_limit", f"SELECT vec_id, {l2} AS dist FROM embeddings ORDER BY dist, vec_id", f"SELECT vec_id, dist FROM {inner}")
    vector_sql("knn_offset", f"SELECT vec_id, {l2} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 10 OFFSET 5", f"SELECT vec_id, dist FROM {inner} ORDER BY dist, vec_id LIMIT 10 OFFSET 5")
    vector_sql("knn_k_gt_n", f"SELECT vec_id, {l2} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 1000000", f"SELECT vec_id, dist FROM {inner}")
    vector_sql("knn_multi_distance", f"SELECT vec_id, {l2} AS d2, negative_dot_product(embedding, $q) AS nd FROM embeddings ORDER BY d2, vec_id LIMIT 10", f"SELECT vec_id, {d2} AS d2, {_duck('ip')} AS nd FROM embeddings {_Q} ORDER BY d2, vec_id LIMIT 10")
    vector_sql("knn_sort_label_first", f"SELECT vec_id, label, {l2} AS dist FROM embeddings ORDER BY label, {l2}, vec_id LIMIT 10", f"SELECT vec_id, label, dist FROM {inner} ORDER BY label, dist, vec_id LIMIT 10")
    for name, where in (
        ("eq", "label = 3"), ("neq", "label <> 3"), ("gt", "vec_id > 100"), ("like", "concat('class_', label) LIKE '%_3'"), ("empty", "label = 999"),
        ("low", "label = 1 AND vec_id < 100"), ("high", "label < 8"),
    ):
        full = {"low": "knn_low_selectivity", "high": "knn_high_selectivity"}.get(name, f"knn_where_{name}")
        vector_sql(full, f"SELECT vec_id, label, {l2} AS dist FROM embeddings WHERE {where} ORDER BY dist, vec_id LIMIT 10", f"SELECT vec_id, label, dist FROM {inner} WHERE {where} ORDER BY dist, vec_id LIMIT 10")
    vector_sql("knn_subquery_alias", f"SELECT t.vec_id, {l2.replace('embedding', 't.embedding')} AS dist FROM embeddings AS t ORDER BY dist, t.vec_id LIMIT 10", f"SELECT vec_id, dist FROM {inner} ORDER BY dist, vec_id LIMIT 10")
    vector_sql("knn_double_alias_where", f"SELECT vec_id, {l2} AS dist FROM (SELECT * FROM (SELECT * FROM embeddings WHERE label = 2) a) b ORDER BY dist, vec_id LIMIT 10", f"SELECT vec_id, dist FROM {inner} WHERE label = 2 ORDER BY dist, vec_id LIMIT 10")
    vector_sql("knn_qualified_table", f"SELECT vec_id, {l2} AS dist FROM main.public.embeddings ORDER BY dist, vec_id LIMIT 10", f"SELECT vec_id, dist FROM {inner} ORDER BY dist, vec_id LIMIT 10")
    vsv = "vector_search_vector('main.public.embeddings', 'embedding', $q, {})"
    near = f"(SELECT vec_id, label, dist FROM {inner} ORDER BY dist, vec_id LIMIT {{}})"
    vector_sql("vsv_basic", f"SELECT vec_id, label, _distance FROM {vsv.format(10)}", f"SELECT vec_id, label, dist AS _distance FROM {near.format(10)}")
    vector_sql("vsv_projection", f"SELECT label FROM {vsv.format(10)}", f"SELECT label FROM {near.format(10)}")
    vector_sql("vsv_k_gt_n", f"SELECT vec_id FROM {vsv.format(1000000)}", "SELECT vec_id FROM embeddings")
    vector_sql("vsv_post_filter", f"SELECT vec_id, _distance FROM {vsv.format(50)} WHERE label < 5", f"SELECT vec_id, dist AS _distance FROM {near.format(50)} WHERE label < 5")
    vector_sql("vsv_group_by", f"SELECT label, count(*) AS n, round(avg(CAST(_distance AS DOUBLE)), 6) AS mean FROM {vsv.format(100)} GROUP BY label", f"SELECT label, count(*) AS n, round(avg(dist::DOUBLE), 6) AS mean FROM {near.format(100)} GROUP BY label")

    host(
        "pairwise_distance",
        f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, {MACROS['l2_distance']('a.embedding', 'b.embedding')} AS dist FROM {{embeddings}} a JOIN {{embeddings}} b ON b.vec_id = a.vec_id + 1",
        f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, {_duck('l2sq', 'a.embedding', 'b.embedding')} AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    )
    _host_queries()


@add("knn_join_per_group", f"SELECT vec_id, label, dist FROM (SELECT vec_id, label, dist, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS r FROM (SELECT *, {_duck('l2sq')} AS dist FROM embeddings {_Q})) WHERE r <= 3")
def knn_join_per_group(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", "label", distance("l2sq", "embedding", vector(spark, sf)).alias("dist"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("dist", "vec_id"))).where("r <= 3").drop("r")


@add("knn_join_documents", f"SELECT d.doc_id, d.lang, d.n_chars, e.dist FROM (SELECT vec_id, {_duck('l2sq')} AS dist FROM embeddings {_Q} ORDER BY dist, vec_id LIMIT 20) e JOIN documents d ON d.doc_id = e.vec_id")
def knn_join_documents(spark, sf):
    near = nearest(table(spark, sf, "embeddings"), "embedding", vector(spark, sf), 20, key="vec_id").select(F.col("vec_id").alias("doc_id"), F.col("_distance").alias("dist"))
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(F.broadcast(near), "doc_id")


@add("knn_join", "SELECT q_id, vec_id, _distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY _distance, vec_id) AS r FROM (SELECT a.vec_id AS q_id, b.vec_id, " + _duck("l2sq", "b.embedding", "a.embedding") + " AS _distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE r <= 5")
def knn_join_query(spark, sf):
    e = table(spark, sf, "embeddings")
    return knn_join(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e, "q", "embedding", 5, "q_id", "vec_id")


@add("fetch_by_keys", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 5, 499)")
def fetch_by_keys(spark, sf):
    return Lookup(table(spark, sf, "embeddings"), "vec_id").fetch_by_keys([3, 5, 499], ["vec_id", "label"])


@add("fetch_missing_and_dup", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (7, 8)")
def fetch_missing_and_dup(spark, sf):
    return MemoryLookup(table(spark, sf, "embeddings"), "vec_id").fetch_by_keys([7, 7, 8, -1, 10**9], ["vec_id", "label"])


@add("fetch_projection_order", "SELECT label, vec_id FROM embeddings WHERE vec_id BETWEEN 10 AND 19")
def fetch_projection_order(spark, sf):
    return Lookup(table(spark, sf, "embeddings"), "vec_id").fetch_by_keys(spark.range(10, 20).toDF("k"), ["label", "vec_id"])


@add("packed_keys", "SELECT vec_id, (3::BIGINT << 48) | ((vec_id % 7) << 32) | vec_id AS key, 3::BIGINT AS f, vec_id % 7 AS g, vec_id AS o FROM embeddings")
def packed_keys(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", keys.pack_columns(F.lit(3), F.col("vec_id") % 7, F.col("vec_id")).alias("key"))
    f, g, o = keys.unpack_columns(F.col("key"))
    return e.select("vec_id", "key", f.alias("f"), g.alias("g"), o.alias("o"))


def _ivf(spark, sf, **config) -> Registry:
    e, r = table(spark, sf, "embeddings"), Registry()
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        path = work_path(spark, "ivf")
        IvfIndex.build(e, "vec_id", "embedding", IndexConfig(64), path)
        _STORED[at] = path
    index = IvfIndex.view(spark, _STORED[at])
    r.add("main::public::embeddings::embedding", e, e.select("vec_id", "label"), "vec_id", "embedding", IndexConfig(64), TableConfig(approximate=True, **config), index)
    return r


@add("ivf_knn_l2")
def ivf_knn_l2(spark, sf):
    return vector_search(_ivf(spark, sf), "main.public.embeddings", "embedding", vector(spark, sf), 10)


@add("ivf_knn_filtered")
def ivf_knn_filtered(spark, sf):
    entry = _ivf(spark, sf).get("main::public::embeddings::embedding")
    return KnnPlan("embeddings", entry, tuple(vector(spark, sf)), 10, ("label < 8",)).execute()


@add("ivf_all_lists", f"SELECT vec_id, label, {_duck('l2sq')} AS _distance FROM embeddings {_Q} ORDER BY _distance, vec_id LIMIT 10")
def ivf_all_lists(spark, sf):
    """With every list probed the index gives the exact answer."""
    return vector_search(_ivf(spark, sf, nprobe=10**6), "main.public.embeddings", "embedding", vector(spark, sf), 10)


@add("adaptive_low_selectivity", f"SELECT vec_id, label, {_duck('l2sq')} AS _distance FROM embeddings {_Q} WHERE label = 1 AND vec_id < 100 ORDER BY _distance, vec_id LIMIT 5")
def adaptive_low_selectivity(spark, sf):
    entry = _ivf(spark, sf).get("main::public::embeddings::embedding")
    return KnnPlan("embeddings", entry, tuple(vector(spark, sf)), 5, ("label = 1", "vec_id < 100")).execute()


def _sql_engine(spark, sf, **config) -> Engine:
    """An engine whose SQL searches the stored index."""
    r = _ivf(spark, sf, **config)
    e = Engine(spark, r)
    e.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    view = "embeddings"
    r.get("main::public::embeddings::embedding").scan.createOrReplaceTempView(view)
    e.views["main.public.embeddings"] = view
    return e


@add("ivf_sql_all_lists", f"SELECT vec_id, label, {_duck('l2sq')} AS dist FROM embeddings {_Q} WHERE label < 8 ORDER BY dist, vec_id LIMIT 10")
def ivf_sql_all_lists(spark, sf):
    """SQL with a filter that most rows pass, by the index with every list probed."""
    q = _literal(spark, sf)
    return _sql_engine(spark, sf, nprobe=10**6).sql(f"SELECT vec_id, label, l2_distance(embedding, {q}) AS dist FROM main.public.embeddings WHERE label < 8 ORDER BY dist, vec_id LIMIT 10")


@add("adaptive_sql_low_selectivity", f"SELECT vec_id, label, {_duck('l2sq')} AS dist FROM embeddings {_Q} WHERE label = 1 AND vec_id < 100 ORDER BY dist, vec_id LIMIT 5")
def adaptive_sql_low_selectivity(spark, sf):
    """SQL with a filter that few rows pass, which is answered exactly."""
    q = _literal(spark, sf)
    return _sql_engine(spark, sf).sql(f"SELECT vec_id, label, l2_distance(embedding, {q}) AS dist FROM main.public.embeddings WHERE label = 1 AND vec_id < 100 ORDER BY dist, vec_id LIMIT 5")


def _local(path: str) -> str:
    """A path of the shared folder as the file system knows it."""
    return path.removeprefix("file://").replace("file:", "", 1) if path.startswith("file:") else path


@add("sidecar_roundtrip", "SELECT vec_id, label FROM embeddings")
def sidecar_roundtrip(spark, sf):
    """Pushed in two batches, finished, and read again."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    with SidecarBuilder(spark, f"{work_path(spark, 'sidecar')}/kv", "vec_id") as b:
        b.push(e.where("label >= 5"))
        b.push(e.where("label < 5"))
        return b.finish().scan()


@add("sidecar_fetch", "SELECT label, vec_id FROM embeddings WHERE vec_id IN (0, 17, 499)")
def sidecar_fetch(spark, sf):
    with SidecarBuilder(spark, f"{work_path(spark, 'sidecar')}/kv", "vec_id") as b:
        b.push(table(spark, sf, "embeddings").select("vec_id", "label"))
        return b.finish().fetch_by_keys([17, 0, 499, -3, 17], ["label", "vec_id"])


@add("open_or_build", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS parts, 0::BIGINT AS lo, count(*) - 1 AS hi FROM part")
def open_or_build_query(spark, sf):
    """Built from Parquet files with keys by file and row, then opened without them."""
    path = f"{work_path(spark, 'store')}/kv"
    open_or_build(spark, path, "row_key", _files_of(spark, sf, "part"))
    rows = open_or_build(spark, path, "row_key", []).scan()
    return rows.agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"), F.min("row_key").alias("lo"), F.max("row_key").alias("hi"))


def _files_of(spark, sf, name: str) -> list[str]:
    return sorted(_local(f) for f in table(spark, sf, name).inputFiles())


_ROWS = (0, 1, 7, 99, 148, 100_000_000)


@add("parquet_packed_key", f"SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r IN {_ROWS}")
def parquet_packed_key(spark, sf):
    """Rows by file, row group and offset, from files of several row groups that hold the table in order."""
    path = f"{work_path(spark, 'packed')}/files"
    rows = table(spark, sf, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey")
    rows.write.option("parquet.block.row.count.limit", 40).parquet(path)
    layout = keys.DatasetLayout.from_files(sorted(_local(f) for f in spark.read.parquet(path).inputFiles()))
    return PackedParquetLookup(spark, layout).fetch_by_keys([layout.packed_key(r) for r in _ROWS if layout.packed_key(r) is not None], ["c_custkey", "c_name"])


def _sqlite(spark, sf) -> SqliteLookup:
    path = f"{_local(work_path(spark, 'sqlite'))}/suppliers.db"
    files.write_sqlite(table(spark, sf, "supplier"), path, "supplier of parts", "s_suppkey")
    return SqliteLookup(spark, path, "supplier of parts", "s_suppkey")


@add("sqlite_scan", "SELECT * FROM supplier")
def sqlite_scan(spark, sf):
    return _sqlite(spark, sf).scan()


@add("sqlite_fetch", "SELECT s_name, s_suppkey FROM supplier WHERE s_suppkey IN (2, 5, 9)")
def sqlite_fetch(spark, sf):
    return _sqlite(spark, sf).fetch_by_keys([9, 2, 5, 2, -1], ["s_name", "s_suppkey"])


@add("sqlite_types", "SELECT event_id, ts, value, event_type, ts::DATE AS day, value > 50 AS large FROM events")
def sqlite_types(spark, sf):
    """Timestamps, dates, booleans and doubles through SQLite cells."""
    rows = table(spark, sf, "events").select("event_id", "ts", "value", "event_type", F.to_date("ts").alias("day"), (F.col("value") > 50).alias("large"))
    path = f"{_local(work_path(spark, 'sqlite'))}/events.db"
    files.write_sqlite(rows, path, "events", "event_id")
    return SqliteLookup(spark, path, "events", "event_id").scan()


def _ipc(spark, sf) -> ArrowLookup:
    path = f"{_local(work_path(spark, 'ipc'))}/store"
    files.write_arrow_ipc(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), path, "o_orderkey")
    return ArrowLookup(spark, path, "o_orderkey")


@add("ipc_scan", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders")
def ipc_scan(spark, sf):
    return _ipc(spark, sf).scan()


@add("ipc_fetch", "SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderkey IN (1, 3, 7, 1000)")
def ipc_fetch(spark, sf):
    return _ipc(spark, sf).fetch_by_keys([1000, 7, 3, 1, 7, -5], ["o_orderstatus", "o_orderkey"])


@add("join_asof_two_tables", "SELECT p.event_id, l.ts AS last_signup FROM (SELECT * FROM events WHERE event_type <> 'signup') p ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') l ON p.user_id = l.user_id AND p.ts >= l.ts")
def join_asof_two_tables(spark, sf):
    """For each row of one table the latest row of another that is not later: both in one order, the last of the other's carried on."""
    e = table(spark, sf, "events")
    left = e.where("event_type <> 'signup'").select("user_id", "ts", "event_id", F.lit(None).cast("timestamp_ntz").alias("signup"), F.lit(1).alias("side"))
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), F.col("ts").alias("signup"), F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("last_signup", F.last("signup", ignorenulls=True).over(w)).where("side = 1").select("event_id", "last_signup")


@add("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events"), "ts", "1 hour", "10 minutes", "event_type")


@add("event_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf):
    return ingest.sessions(table(spark, sf, "events"))


def _host_queries() -> None:
    li, o, c, n, r, s, p, ev = ("{" + t + "}" for t in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part", "events"))
    host("scan_filter_project", f"SELECT l_orderkey, l_linenumber, l_quantity FROM {li} WHERE l_quantity < 5 AND l_returnflag = 'R'")
    host("pricing_summary", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {li} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
    host("join_inner", f"SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {o} JOIN {c} ON o_custkey = c_custkey JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name")
    host("join_left", f"SELECT c_custkey, count(o_orderkey) AS n FROM {c} LEFT JOIN {o} ON o_custkey = c_custkey GROUP BY c_custkey")
    host("join_right", f"SELECT n_name, s_name FROM {s} RIGHT JOIN {n} ON s_nationkey = n_nationkey")
    host("join_full", f"SELECT c_custkey, s_suppkey FROM {c} FULL OUTER JOIN {s} ON c_custkey = s_suppkey")
    host("join_semi", f"SELECT c_custkey, c_name FROM {c} WHERE EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
    host("join_anti", f"SELECT c_custkey, c_name FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey)")
    host("join_anti_large", f"SELECT c_custkey, c_name FROM {c} LEFT ANTI JOIN {o} ON o_custkey = c_custkey AND o_totalprice > 200000", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
    host("join_cross", f"SELECT r_name, n_name FROM {r} CROSS JOIN {n}")
    host("join_theta", f"SELECT a.n_name AS a_name, b.n_name AS b_name FROM {n} a JOIN {n} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
    # both sides meet by thirds, so that no row meets the whole other table
    host(
        "join_range",
        f"SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, explode(sequence(p_partkey div 3, (p_partkey + 2) div 3)) AS third FROM {p}) p JOIN {s} s ON s_suppkey div 3 = third AND s_suppkey BETWEEN p_partkey AND p_partkey + 2",
        f"SELECT p_partkey, s_suppkey FROM {p} JOIN {s} ON s_suppkey BETWEEN p_partkey AND p_partkey + 2",
    )
    host(
        "join_asof",
        f"SELECT event_id, last_signup FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS last_signup FROM {ev})",
    )
    host("agg_distinct", f"SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {o} GROUP BY o_orderpriority")
    host("agg_rollup", f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {li} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
    host("agg_cube", f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {li} GROUP BY CUBE (l_returnflag, l_linestatus)")
    host("agg_grouping_sets", f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {li} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
    host("distinct", f"SELECT DISTINCT c_mktsegment, c_nationkey FROM {c}")
    host(
        "window_ranks",
        f"SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS nxt FROM {o} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    )
    host("window_frames", f"SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_key FROM {o}")
    host("window_distribution", f"SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS cd FROM {s}")
    host("set_union", f"SELECT c_nationkey AS k FROM {c} UNION SELECT s_nationkey FROM {s}")
    host("set_union_all", f"SELECT c_nationkey AS k FROM {c} UNION ALL SELECT s_nationkey FROM {s}")
    host("set_intersect", f"SELECT c_nationkey AS k FROM {c} INTERSECT SELECT s_nationkey FROM {s}")
    host("set_except", f"SELECT n_nationkey AS k FROM {n} EXCEPT SELECT s_nationkey FROM {s}")
    host("set_intersect_all", f"SELECT c_nationkey AS k FROM {c} INTERSECT ALL SELECT s_nationkey FROM {s}")
    host("set_except_all", f"SELECT c_nationkey AS k FROM {c} EXCEPT ALL SELECT s_nationkey FROM {s}")
    host(
        "window_ranges",
        f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS near_total, count(*) OVER w AS near, nth_value(o_orderkey, 2) OVER v AS second, last_value(o_orderkey) OVER v AS last_key FROM {o} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), v AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    )
    host(
        "map_functions",
        f"SELECT n_nationkey, map(n_name, n_regionkey)[n_name] AS own, size(map(n_name, 1, 'x', 2)) AS n, array_join(map_keys(map(n_name, n_regionkey)), ',') AS ks, map_values(map(n_name, n_regionkey))[0] AS v FROM {n}",
        "SELECT n_nationkey, MAP {n_name: n_regionkey}[n_name] AS own, cardinality(MAP {n_name: 1, 'x': 2})::INTEGER AS n, array_to_string(map_keys(MAP {n_name: n_regionkey}), ',') AS ks, map_values(MAP {n_name: n_regionkey})[1] AS v FROM nation",
    )
    host("top_k", f"SELECT o_orderkey, o_totalprice FROM {o} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    host("string_functions", f"SELECT p_partkey, upper(p_name) AS up, substring(p_name, 2, 5) AS sub, length(p_name) AS len, replace(p_brand, '#', '-') AS rep, trim(concat('  ', p_type, ' ')) AS tr FROM {p}")
    host("math_functions", f"SELECT c_custkey, abs(c_acctbal) AS ab, floor(c_acctbal) AS fl, ceil(c_acctbal) AS ce, round(sqrt(abs(c_acctbal)), 6) AS sq, c_custkey % 7 AS md FROM {c}", f"SELECT c_custkey, abs(c_acctbal) AS ab, floor(c_acctbal)::BIGINT AS fl, ceil(c_acctbal)::BIGINT AS ce, round(sqrt(abs(c_acctbal)), 6) AS sq, c_custkey % 7 AS md FROM {c}")
    host("date_functions", f"SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM {o} GROUP BY year(o_orderdate), month(o_orderdate)")
    host("array_functions", "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 6) AS mx, size(filter(embedding, x -> x > 0)) AS pos FROM {embeddings}", "SELECT vec_id, len(embedding) AS n, round(list_max(embedding)::DOUBLE, 6) AS mx, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings")
    host("json_functions", f"SELECT event_id, get_json_object(props, '$.k') AS k FROM {ev}", f"SELECT event_id, json_extract_string(props, '$.k') AS k FROM {ev}")
    host("case_in_between", f"SELECT o_orderstatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 1 ELSE 0 END) AS mid FROM {o} GROUP BY o_orderstatus")
    host("subquery_scalar", f"SELECT s_suppkey, s_acctbal FROM {s} WHERE s_acctbal > (SELECT avg(s_acctbal) FROM {s})")


_register()
