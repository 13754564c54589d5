"""Stores and files: pushdown, types, several files and row groups, replays, streams."""

import datetime
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanvec.functions import keys
from spanvec.sources import files, workspace
from spanvec.sources.lookup import ArrowLookup, PackedParquetLookup, ParquetLookup, SidecarBuilder, SqliteLookup, open_or_build, open_or_build_sqlite
from spanvec.streaming import ingest


@pytest.fixture(scope="module")
def several(spark, tmp_path_factory):
    """Three files of several row groups; row i of the dataset has n = i."""
    path = f"{tmp_path_factory.mktemp('several')}/in"
    df = spark.range(1000).select(F.col("id").alias("n"), F.concat(F.lit("row "), "id").alias("name"))
    df.repartitionByRange(3, "n").sortWithinPartitions("n").write.option("parquet.block.row.count.limit", 100).parquet(path)
    return keys.DatasetLayout.from_files(sorted(f.removeprefix("file://").replace("file:", "") for f in spark.read.parquet(path).inputFiles()))


def test_packed_lookup_over_files_and_groups(spark, several):
    assert len(several.files) == 3 and all(len(g) > 1 for g in several.before_group) and several.rows == 1000
    rows = [0, 99, 100, 333, 334, 500, 999]
    packed = [several.packed_key(r) for r in rows]
    assert [several.row_number(k) for k in packed] == rows and several.packed_key(1000) is several.packed_key(-1) is None
    store = PackedParquetLookup(spark, several)
    assert [(r.row_key, r.n) for r in store.fetch_by_keys(packed[::-1] + packed[:2]).collect()] == sorted(zip(packed, rows))
    by_frame = store.fetch_by_keys(spark.createDataFrame([(k,) for k in [*packed, None]], "k long"), ["n"])
    assert [r.n for r in by_frame.collect()] == rows
    assert store.fetch_by_keys([keys.pack(0, 0, 10**6), keys.pack(0, 500, 0)]).count() == 0 and store.fetch_by_keys([]).count() == 0
    plan = store.fetch_by_keys(packed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    for bad in ([keys.pack(7, 0, 0)], spark.createDataFrame([(keys.pack(7, 0, 0),)], "k long")):
        with pytest.raises(Exception, match="file_idx=7"):
            store.fetch_by_keys(bad).collect()
    numbers = spark.createDataFrame([(k,) for k in [*packed, keys.pack(9, 0, 0)]], "k long").select(several.row_number_column(F.col("k")).alias("r")).collect()
    assert [r.r for r in numbers] == [*rows, None]
    with pytest.raises(IndexError, match="row group"):
        several.row_number(keys.pack(0, 99, 0))


def test_open_or_build_over_files(spark, several, tmp_path):
    for store in (open_or_build(spark, f"{tmp_path}/kv", "row_key", list(several.files)), open_or_build_sqlite(spark, f"{tmp_path}/kv.db", "kv", "row_key", list(several.files))):
        assert [(r.row_key, r.n) for r in store.fetch_by_keys([999, 0, 334, 1000]).collect()] == [(0, 0), (334, 334), (999, 999)]
    assert open_or_build_sqlite(spark, f"{tmp_path}/kv.db", "kv", "row_key", []).scan().count() == 1000


def test_lookup_only(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    store = ParquetLookup(spark, f"{tmp_path}/t", "id", lookup_only=True)
    assert store.fetch_by_keys([1]).count() == 1
    with pytest.raises(NotImplementedError, match="by key only"):
        store.scan()


TYPED = "id long, i8 byte, i16 short, i32 int, f float, x double, s string, flag boolean, b binary, day date, at timestamp, wall timestamp_ntz, tags array<string>, ns array<long>"
ROWS = [
    (1, 1, -2, 3, 0.5, 1e-300, 'quote " here', True, bytearray(b"\x00\xff"), datetime.date(1969, 12, 31), datetime.datetime(2024, 2, 29, 23, 59, 59, 999999, datetime.timezone.utc), datetime.datetime(1960, 1, 1, 1, 1, 1, 7), ["a", None], [1, -(2**60)]),
    (2, *[None] * 13),
    (3, -128, 32767, -(2**31), -0.25, float("inf"), "", False, bytearray(b""), datetime.date(9999, 12, 31), datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc), datetime.datetime(2000, 1, 1), [], []),
]


def plain(rows):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows]


def test_types_through_sqlite_and_ipc(spark, tmp_path):
    df = spark.createDataFrame(ROWS, TYPED)
    want = plain(df.orderBy("id").collect())
    files.write_sqlite(df, f"{tmp_path}/t.db", "typed", "id")
    files.write_arrow_ipc(df, f"{tmp_path}/t", "id")
    for store in (SqliteLookup(spark, f"{tmp_path}/t.db", "typed", "id"), ArrowLookup(spark, f"{tmp_path}/t", "id")):
        assert [f.dataType for f in store.schema] == [f.dataType for f in df.schema]
        assert plain(store.scan().orderBy("id").collect()) == want
        assert plain(store.fetch_by_keys([3, 1, 3, 9]).collect()) == [want[0], want[2]]
        assert [r.s for r in store.fetch_by_keys([3, 1], ["s"]).collect()] == ['quote " here', ""]


def test_sqlite_pushdown(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    files.write_sqlite(spark.range(5000).select("id", (F.col("id") % 7).alias("m"), F.concat(F.lit("n"), "id").alias("name")), path, "a table", "id")
    store = SqliteLookup(spark, path, "a table", "id")
    for where, n in (("id = 17", 1), ("id IN (1, 2, 9999)", 2), ("id > 4990 AND m = 0", None), ("name = 'n44'", 1), ("name LIKE 'n44%'", 111), ("id <= 3 OR m = 6", None)):
        want = spark.range(5000).selectExpr("id", "id % 7 AS m", "concat('n', id) AS name").where(where).count()
        assert store.scan().where(where).count() == want and n in (None, want)
    reader = files.SqliteReader({"path": path, "table": "a table"}, store.schema)
    left = list(reader.pushFilters([files.In(("id",), (4, 5)), files.EqualTo(("name",), "n4"), files.IsNotNull(("id",))]))
    assert left == [] and [(p.low, p.high) for p in reader.partitions()] == [(4, 5)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_key_index(spark, tmp_path):
    path = f"{tmp_path}/old.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE old (k INTEGER, v TEXT)")
        db.execute("INSERT INTO old VALUES (5, 'five')")
    db.close()
    store = SqliteLookup(spark, path, "old", "k")
    assert store.ensure_key_index() and not store.ensure_key_index()
    assert [tuple(r) for r in store.fetch_by_keys([5, 6]).collect()] == [(5, "five")]
    files.write_sqlite(spark.range(2), f"{tmp_path}/new.db", "new", "id")
    assert not SqliteLookup(spark, f"{tmp_path}/new.db", "new", "id").ensure_key_index()


def test_ipc_reads_batches_that_can_hold_the_keys(tmp_path):
    table = pa.table({"k": list(range(100)), "v": [f"v{i}" for i in range(100)]})
    with pa.ipc.new_file(f"{tmp_path}/f.arrow", table.schema) as w:
        w.write_table(table, max_chunksize=10)
    reader = files.ArrowIpcReader(f"{tmp_path}/f.arrow", files.from_arrow_schema(table.schema))
    assert list(reader.pushFilters([files.In(("k",), (3, 55, 200)), files.EqualTo(("v",), "x")])) == [files.EqualTo(("v",), "x")]
    got = [b.to_pydict() for p in reader.partitions() for b in reader.read(p)]
    assert got == [{"k": [3], "v": ["v3"]}, {"k": [55], "v": ["v55"]}]


def test_builder_tells_sorted_input(spark, tmp_path):
    for name, parts, want in (("up", [[1, 2, 3], [4, 9]], True), ("over", [[1, 5], [4, 9]], False), ("down", [[3, 2, 1]], False)):
        b = SidecarBuilder(spark, f"{tmp_path}/{name}", "k")
        for ids in parts:
            b.push(spark.createDataFrame([(i,) for i in ids], "k long").coalesce(1))
        assert b.input_was_sorted() == want
        assert [r.k for r in b.finish().scan().collect()] == sorted(sum(parts, []))


def test_replayed_batch_counts_once(spark, tmp_path):
    b = SidecarBuilder(spark, f"{tmp_path}/kv", "id")
    b.push(spark.range(5), 0)
    b.push(spark.range(5, 8), 1)
    b.push(spark.range(5), 0)
    assert b.finish().scan().count() == 8


def streamed(spark, tmp_path, make):
    schema = "user_id long, ts timestamp, value double, event_type string"
    rows = [(u, datetime.datetime(2024, 1, 1, h, m), float(u), "click") for u, h, m in ((1, 1, 0), (1, 1, 10), (2, 1, 59), (1, 3, 0), (2, 6, 0), (1, 9, 0))]
    rows.append((9, datetime.datetime(2024, 1, 3), 0.0, "end"))
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    name = f"out_{abs(hash(str(tmp_path)))}"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = make(spark.createDataFrame(rows[:-1], schema))
    return sorted(map(str, spark.table(name).collect())), sorted(map(str, batch.collect()))


def test_windows_on_a_stream(spark, tmp_path):
    got, want = streamed(spark, tmp_path, lambda df: ingest.windowed_counts(df, "ts", "1 hour", "10 minutes", "event_type"))
    assert got == want and len(want) == 4


def test_sessions_on_a_stream(spark, tmp_path):
    got, want = streamed(spark, tmp_path, ingest.sessions)
    assert got == want and len(want) == 5


def test_work_folder():
    """A cluster without spark.checkpoint.dir is refused."""
    sc = type("C", (), {"master": "local-cluster[2,1,1024]", "getConf": lambda self: {}, "getCheckpointDir": lambda self: None})()
    fake = type("S", (), {"sparkContext": sc, "conf": type("R", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.work_dir(fake)
