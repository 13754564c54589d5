"""Python data sources for SQLite tables and Arrow IPC files, and writers for both.

``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``
``spark.read.format("arrow_ipc").option("path", ...)``

Files are opened by the executors, so they must be at a path that all share.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import shutil
import sqlite3
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

BATCH = 1024
_STORED = {T.BooleanType: "INTEGER", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB", T.DateType: "INTEGER", T.TimestampType: "INTEGER", T.TimestampNTZType: "INTEGER"}
_LIST_OF = (T.StringType, T.IntegerType, T.LongType)


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(field: T.StructField) -> str:
    """How a column is stored; types that a SQLite cell cannot hold without loss are refused."""
    t = field.dataType
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, _LIST_OF):
        return "TEXT"
    for kind, stored in _STORED.items():
        if type(t) is kind:
            return stored
    raise TypeError(f"column {field.name!r} of type {t.simpleString()} cannot be stored in SQLite")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Ranges of rowid, with the conditions that SQLite can judge by itself."""

    _OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", 4)), schema
        self.where, self.values = [], []

    def pushFilters(self, filters):
        """Comparisons of whole numbers and texts, and tests for null, go to SQLite; the others stay with Spark."""
        kinds = {f.name: type(f.dataType) for f in self.schema}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = kinds.get(name) in (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType)
            if plain and type(f) in self._OPERATORS:
                self.where.append(f"{quote_ident(name)} {self._OPERATORS[type(f)]} ?")
                self.values.append(f.value)
            elif plain and isinstance(f, In) and len(f.value) <= MOST_VALUES:
                self.where.append(f"{quote_ident(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif name in kinds and isinstance(f, IsNotNull):
                self.where.append(f"{quote_ident(name)} IS NOT NULL")
            else:
                yield f

    def _select(self, db, what: str, *more: str):
        where = " AND ".join([*self.where, *more])
        return f"SELECT {what} FROM {quote_ident(self.table)}" + (f" WHERE {where}" if where else "")

    def partitions(self):
        with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            low, high = db.execute(self._select(db, "min(rowid), max(rowid)"), self.values).fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part):
        schema = T.StructType([*self.schema])
        names = ", ".join(quote_ident(f.name) for f in schema)
        arrow = pa.schema([(f.name, _arrow_of(f.dataType)) for f in schema])
        with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            rows = db.execute(self._select(db, names, "rowid >= ?", "rowid < ?"), [*self.values, part.low, part.high])
            while batch := rows.fetchmany(BATCH):
                cols = [pa.array([_from_cell(v, f.dataType) for v in c], arrow.field(i).type) for i, (c, f) in enumerate(zip(zip(*batch), schema))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)


def _arrow_of(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _from_cell(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        return json.loads(v)
    if isinstance(t, T.DateType):
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=v)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=v)
        return at.replace(tzinfo=datetime.timezone.utc) if isinstance(t, T.TimestampType) else at
    return bool(v) if isinstance(t, T.BooleanType) else v


#: Table that keeps the types of the tables written here.
TYPES = "_column_types"
#: Values of a condition that SQLite takes at once.
MOST_VALUES = 900


def has_table(path: str, table: str) -> bool:
    if not os.path.exists(path):
        return False
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone() is not None


def ensure_key_index(path: str, table: str, key: str) -> bool:
    """Makes an index on ``key`` unless it is the primary key or leads an index; whether one was made."""
    with contextlib.closing(sqlite3.connect(path)) as db, db:
        if any(c[1] == key and c[5] == 1 for c in db.execute(f"PRAGMA table_info({quote_ident(table)})")):
            return False
        for i in db.execute(f"PRAGMA index_list({quote_ident(table)})").fetchall():
            leads = db.execute(f"PRAGMA index_info({quote_ident(i[1])})").fetchone()
            if leads and leads[2] == key:
                return False
        db.execute(f"CREATE INDEX {quote_ident(f'{table}_{key}')} ON {quote_ident(table)} ({quote_ident(key)})")
        return True


class SqliteTable(DataSource):
    """Types are those the table was written with here, or follow from SQLite's own."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self):
        if has_table(self.options["path"], TYPES):
            with contextlib.closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)) as db:
                known = db.execute(f"SELECT types FROM {TYPES} WHERE name = ?", [self.options["table"]]).fetchone()
            if known:
                return T.StructType.fromJson(json.loads(known[0]))
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cols = db.execute(f"PRAGMA table_info({quote_ident(self.options['table'])})").fetchall()
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        return T.StructType([T.StructField(c[1], kinds.get(c[2].upper(), T.StringType())) for c in cols])

    def reader(self, schema):
        return SqliteReader(dict(self.options), schema)


def write_sqlite(df: DataFrame, path: str, table: str, key: str) -> None:
    """A SQLite table with ``key`` as its primary key, in one transaction on a temporary file that is then renamed.

    One file has one writer: rows come to the driver partition by partition.
    """
    kinds = {f.name: affinity(f) for f in df.schema}
    cols = ", ".join(f"{quote_ident(n)} {k}" + (" PRIMARY KEY NOT NULL" if n == key else "") for n, k in kinds.items())
    temp = f"{path}.building"
    if os.path.exists(temp):
        os.remove(temp)
    db = sqlite3.connect(temp)
    try:
        with db:
            db.execute(f"CREATE TABLE {quote_ident(table)} ({cols})")
            db.execute(f"CREATE TABLE IF NOT EXISTS {TYPES} (name TEXT PRIMARY KEY, types TEXT)")
            db.execute(f"INSERT INTO {TYPES} VALUES (?, ?)", [table, df.schema.json()])
            marks = ", ".join("?" * len(kinds))
            db.executemany(f"INSERT INTO {quote_ident(table)} VALUES ({marks})", (tuple(_to_cell(v) for v in r) for r in _without_zones(df).toLocalIterator()))
        db.close()
        os.replace(temp, path)
    except BaseException:
        db.close()
        os.remove(temp)
        raise


def _without_zones(df: DataFrame) -> DataFrame:
    """Instants as microseconds since 1970, which no time zone of a driver moves."""
    return df.select(*(F.unix_micros(F.col(f"`{f.name.replace('`', '``')}`")).alias(f.name) if type(f.dataType) is T.TimestampType else F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema))


def _to_cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, list):
        return json.dumps(v)
    if isinstance(v, datetime.datetime):
        return (v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    if isinstance(v, datetime.date):
        return (v - datetime.date(1970, 1, 1)).days
    return bytes(v) if isinstance(v, bytearray) else v


class _Batch(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


def _ipc_files(path: str) -> list[str]:
    """The file, or the files of a folder in order."""
    return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".arrow")) if os.path.isdir(path) else [path]


class ArrowIpcReader(DataSourceReader):
    """One task for each record batch, in file order. Of a batch that no row passes, only the columns of the conditions are read."""

    _COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.conditions = path, schema, []

    def pushFilters(self, filters):
        """Conditions on columns of whole numbers are judged here; the others stay with Spark."""
        whole = {f.name for f in self.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}
        for f in filters:
            if (type(f) in self._COMPARE or isinstance(f, (In, IsNotNull))) and len(f.attribute) == 1 and f.attribute[0] in whole:
                self.conditions.append(f)
            else:
                yield f

    def partitions(self):
        found = []
        for path in _ipc_files(self.path):
            with pa.memory_map(path) as source:
                found += [_Batch(path, i) for i in range(pa.ipc.open_file(source).num_record_batches)]
        return found or [_Batch("", 0)]

    def _passing(self, batch):
        mask = None
        for f in self.conditions:
            column = batch.column(f.attribute[0])
            if isinstance(f, IsNotNull):
                one = pc.is_valid(column)
            elif isinstance(f, In):
                one = pc.is_in(column, pa.array(f.value, column.type))
            else:
                one = self._COMPARE[type(f)](column, pa.scalar(f.value, column.type))
            mask = one if mask is None else pc.and_(mask, one)
        return mask

    def read(self, part):
        if part.path:
            with pa.memory_map(part.path) as source:
                batch = pa.ipc.open_file(source).get_batch(part.index)
                mask = self._passing(batch)
                if mask is None:
                    yield batch
                elif pc.any(mask).as_py():
                    yield batch.filter(mask)


class ArrowIpc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        with pa.memory_map(_ipc_files(self.options["path"])[0]) as source:
            return from_arrow_schema(pa.ipc.open_file(source).schema, prefer_timestamp_ntz=True)

    def reader(self, schema):
        return ArrowIpcReader(self.options["path"], schema)


def unsigned_order(key: str) -> list[Column]:
    """Sort keys that put a signed key in the order of its 64-bit pattern read as unsigned: negative keys come last."""
    return [(F.col(key) < 0).asc(), F.col(key).asc()]


def write_arrow_ipc(df: DataFrame, path: str, key: str) -> None:
    """A folder of Arrow IPC files, sorted by key in unsigned order within and across files.

    Every task writes the files of its range into a staging folder; only those
    of attempts that succeeded are kept, and one rename publishes them.  Null
    and repeated keys are refused.  No row reaches the driver.
    """
    if os.path.exists(path):
        raise FileExistsError(path)
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).orderBy(key).first()
    if bad is not None:
        raise ValueError(f"key {bad[0]} is null or repeated")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    os.makedirs(staging)

    def store(batches):
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow"
        writer = None
        for b in batches:
            if b.num_rows:
                writer = writer or pa.ipc.new_file(os.path.join(staging, name), b.schema)
                writer.write_batch(b)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    try:
        ranges = df.repartitionByRange(*unsigned_order(key)).sortWithinPartitions(*unsigned_order(key))
        kept = {r["name"] for r in ranges.mapInArrow(store, "name string").collect()}
        for left in set(os.listdir(staging)) - kept:
            os.remove(os.path.join(staging, left))
        if not kept:
            pa.ipc.new_file(os.path.join(staging, "part-00000.arrow"), to_arrow_schema(df.schema)).close()
        os.rename(staging, path)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def check_ascending(df: DataFrame, key: str) -> None:
    """Fails unless the keys of a table of IPC files are not null and strictly rise in unsigned order. The driver gets one row for each batch."""

    def ends(batches):
        for b in batches:
            k = b.column(0)
            if b.num_rows and not k.null_count:
                v = k.cast(pa.int64()).to_numpy().view("u8")
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [int(v[0]) - 2**63], "last": [int(v[-1]) - 2**63], "ok": [bool((v[1:] > v[:-1]).all())]})
            elif k.null_count:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [0], "last": [0], "ok": [False]})

    found = df.select(key).mapInArrow(ends, "part long, first long, last long, ok boolean").collect()
    if not all(r["ok"] for r in found) or any(a["last"] >= b["first"] for a, b in zip(found, found[1:])):
        raise ValueError(f"keys of column {key!r} are null or do not rise")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    spark.dataSource.register(ArrowIpc)
