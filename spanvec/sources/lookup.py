"""Point-lookup stores: rows by key. Missing keys are left out, repeated keys count once.

All hand back DataFrames.  ``fetch_by_keys`` takes a list of keys (pushed down
to the scan as IN) or a DataFrame with one key column (joined).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .workspace import hadoop_fs

KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def check_key(df: DataFrame, key: str) -> None:
    found = next((f for f in df.schema.fields if f.name == key), None)
    if found is None:
        raise ValueError(f"key column {key!r} is not in the schema")
    if not isinstance(found.dataType, KEY_TYPES):
        raise TypeError(f"key column {key!r} must be an integer of at most 64 bits, not {found.dataType.simpleString()}")


class Lookup:
    """A table with a key column."""

    def __init__(self, df: DataFrame, key: str):
        check_key(df, key)
        self.df, self.key = df, key

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def scan(self, columns: list[str] | None = None) -> DataFrame:
        return self.df.select(*columns) if columns else self.df

    def fetch_by_keys(self, keys: Iterable[int] | DataFrame, columns: list[str] | None = None) -> DataFrame:
        if isinstance(keys, DataFrame):
            wanted = keys.select(F.col(keys.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
            found = self.df.join(wanted, self.key, "left_semi")
        else:
            found = self.df.where(F.col(self.key).isin([int(k) for k in {*keys}]))
        return found.select(*columns) if columns else found

    def __len__(self) -> int:
        return self.df.where(F.col(self.key).isNotNull()).select(self.key).distinct().count()

    @property
    def is_empty(self) -> bool:
        return self.df.where(F.col(self.key).isNotNull()).isEmpty()


class MemoryLookup(Lookup):
    """Rows in order; the last of a repeated key wins a fetch, rows with null keys are only scanned."""

    def __init__(self, df: DataFrame, key: str, order: str | None = None):
        super().__init__(df, key)
        last = Window.partitionBy(key).orderBy(F.desc(order or "_at"))
        rows = df if order else df.withColumn("_at", F.monotonically_increasing_id())
        self._last = rows.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(last)).where("_rank = 1").select(df.columns)

    def fetch_by_keys(self, keys, columns=None):
        return Lookup(self._last, self.key).fetch_by_keys(keys, columns)


class ParquetLookup(Lookup):
    """A keyed Parquet table; ``lookup_only`` refuses full scans."""

    def __init__(self, spark: SparkSession, path: str, key: str, lookup_only: bool = False):
        super().__init__(spark.read.parquet(path), key)
        self.path, self.lookup_only = path, lookup_only

    def scan(self, columns=None):
        if self.lookup_only:
            raise NotImplementedError("this store serves lookups by key only")
        return super().scan(columns)

    def fetch_by_keys(self, keys, columns=None):
        found = super().fetch_by_keys(keys, columns)
        return found.orderBy(self.key) if columns is None or self.key in columns else found


class ArrowLookup(Lookup):
    """A folder of Arrow IPC files (or one file) sorted by key; rows come back in unsigned key order."""

    def __init__(self, spark: SparkSession, path: str, key: str, check: bool = True):
        files.register(spark)
        super().__init__(spark.read.format("arrow_ipc").option("path", path).load(), key)
        if check:
            files.check_ascending(self.df, key)

    def fetch_by_keys(self, keys, columns=None):
        found = super().fetch_by_keys(keys).orderBy(*files.unsigned_order(self.key))
        return found.select(*columns) if columns else found


class SqliteLookup(Lookup):
    """A SQLite table with a key column. Conditions on columns, keys among them, are pushed into SQLite; rows come back in key order."""

    def __init__(self, spark: SparkSession, path: str, table: str, key: str):
        files.register(spark)
        super().__init__(spark.read.format("sqlite_table").option("path", path).option("table", table).load(), key)
        self.path, self.table = path, table

    def fetch_by_keys(self, keys, columns=None):
        found = super().fetch_by_keys(keys).orderBy(self.key)
        return found.select(*columns) if columns else found

    def ensure_key_index(self) -> bool:
        """Makes an index on the key unless the table has one; whether one was made."""
        return files.ensure_key_index(self.path, self.table, self.key)


def _layout_table(spark: SparkSession, layout) -> DataFrame:
    """(file, path, rows before the file, rows before each row group, rows) of a dataset: a row for each file, whose number its footers bound."""
    paths = [str(hadoop_fs(spark, f)[0].makeQualified(hadoop_fs(spark, f)[1]).toUri()) for f in layout.files]
    columns = {"_file": pa.array(range(len(paths)), pa.int32()), "_path": pa.array([_plain(p) for p in paths], pa.string()), "_before": pa.array(layout.before_file, pa.int64()), "_groups": pa.array([list(g) for g in layout.before_group], pa.list_(pa.int64()))}
    return spark.createDataFrame(pa.table(columns))


def _plain(path: str) -> str:
    return path.replace("file:///", "file:/")


def _numbered(spark: SparkSession, files_: Iterable[str]) -> DataFrame:
    """All rows of Parquet files, in one scan, with ``_path`` and ``_row`` (its number in the file)."""
    return spark.read.parquet(*files_).withColumns({"_path": F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/")), "_row": F.col("_metadata.row_index")})


class PackedParquetLookup:
    """Rows of Parquet files by packed key (file, row group, offset); see ``functions.keys``."""

    def __init__(self, spark: SparkSession, layout, key: str = "row_key"):
        self.spark, self.layout, self.key = spark, layout, key

    def fetch_by_keys(self, keys: Iterable[int] | DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows in key order, by one scan of the files that a list of keys names (or of all, if keys are a DataFrame).

        Offsets beyond a row group are left out, an unknown file is an error.
        """
        from ..functions.keys import unpack, unpack_columns

        files_ = range(len(self.layout.files))
        if not isinstance(keys, DataFrame):
            wanted = sorted({*keys})
            files_ = sorted({unpack(k)[0] for k in wanted})
            if bad := [f for f in files_ if f >= len(self.layout.files)]:
                raise IndexError(f"file_idx={bad[0]} is not in the dataset of {len(self.layout.files)} files")
            keys = self.spark.createDataFrame(pa.table({"k": pa.array(wanted, pa.int64())}))
        file, group, offset = unpack_columns(F.col(self.key))
        n = len(self.layout.files)
        unknown = F.raise_error(F.concat(F.lit("file_idx="), file.cast("string"), F.lit(f" is not in the dataset of {n} files")))
        at = keys.select(F.col(keys.columns[0]).cast("long").alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        at = at.withColumns({"_file": F.when(file >= n, unknown.cast("int")).otherwise(file.cast("int")), "_group": group.cast("int"), "_offset": offset})
        at = at.join(F.broadcast(_layout_table(self.spark, self.layout)), "_file")
        start, stop = F.get("_groups", F.col("_group")), F.get("_groups", F.col("_group") + 1)
        at = at.where(start.isNotNull() & (stop.isNull() | (F.col("_offset") < stop - start))).select(self.key, "_path", (start + F.col("_offset")).alias("_row"))
        rows = _numbered(self.spark, [self.layout.files[f] for f in files_] or self.layout.files[:1])
        out = rows.join(at, ["_path", "_row"]).drop("_path", "_row")
        names = [self.key, *(c for c in out.columns if c != self.key)]
        return out.orderBy(self.key).select(*(columns or names))


class SidecarBuilder:
    """begin / push / finish of a keyed Parquet table, sorted by key, published by one rename.

    Keys must not be null or repeated.  Nothing can be seen at ``path`` before
    ``finish``; ``abort`` (or leaving the ``with`` block by an error) removes
    what was pushed.  A batch pushed again under the same number takes the place of the first.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, overwrite: bool = False):
        self.spark, self.path, self.key, self.overwrite = spark, path, key, overwrite
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"
        self.pushed = 0

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind:
            self.abort()

    def push(self, df: DataFrame, batch: int | None = None) -> None:
        check_key(df, self.key)
        at = f"push={self.pushed}" if batch is None else f"batch={batch}"
        df.write.mode("overwrite").parquet(f"{self.staging}/pushed/{at}")
        self.columns = df.columns
        self.pushed += 1

    def input_was_sorted(self) -> bool:
        """Whether the keys rose from row to row, over all pushes in turn, so that finishing only copies. Read from the files' bounds and rows."""
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.staging}/pushed")
        rows = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), F.col(self.key).alias("k"))
        falls = rows.withColumn("last", F.lag("k").over(Window.partitionBy("f").orderBy("i"))).where("last >= k").isEmpty()
        push = F.regexp_extract("f", r"(?:push|batch)=([0-9]+)", 1).cast("int")
        ends = rows.groupBy(push.alias("p"), "f").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("p", "f").select("a", "b").toLocalIterator()
        before = None
        for r in ends:
            if before is not None and r["a"] <= before:
                return False
            before = r["b"]
        return falls

    def abort(self) -> None:
        fs, p = hadoop_fs(self.spark, self.staging)
        fs.delete(p, True)

    def finish(self) -> ParquetLookup:
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.staging}/pushed")
        bad = rows.groupBy(self.key).count().where((F.col("count") > 1) | F.col(self.key).isNull()).orderBy(self.key).first()
        if bad is not None:
            self.abort()
            raise ValueError(f"key {bad[0]} is null or repeated")
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.staging}/sorted")
        fs, to = hadoop_fs(self.spark, self.path)
        if fs.exists(to):
            if not self.overwrite:
                self.abort()
                raise FileExistsError(self.path)
            fs.delete(to, True)
        fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.staging}/sorted"), to)
        self.abort()
        return ParquetLookup(self.spark, self.path, self.key)


def rows_in_order(spark: SparkSession, key: str, parquet_files: list[str]) -> DataFrame:
    """Rows of Parquet files with keys 0, 1, ... in file and row order, by one scan."""
    from ..functions.keys import DatasetLayout

    layout = DatasetLayout.from_files(parquet_files)
    rows = _numbered(spark, layout.files).join(F.broadcast(_layout_table(spark, layout).select("_path", "_before")), "_path")
    rows = rows.withColumn(key, F.col("_before") + F.col("_row")).drop("_path", "_row", "_before")
    return rows.select(key, *(c for c in rows.columns if c != key))


def open_or_build(spark: SparkSession, path: str, key: str, parquet_files: list[str]) -> ParquetLookup:
    """The table at ``path``; built from Parquet files if it is missing, with keys 0, 1, ... in file and row order."""
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        with SidecarBuilder(spark, path, key) as b:
            b.push(rows_in_order(spark, key, parquet_files))
            return b.finish()
    return ParquetLookup(spark, path, key)


def open_or_build_sqlite(spark: SparkSession, path: str, table: str, key: str, parquet_files: list[str]) -> SqliteLookup:
    """As ``open_or_build``, for a table of a SQLite file."""
    if not files.has_table(path, table):
        files.write_sqlite(rows_in_order(spark, key, parquet_files), path, table, key)
    return SqliteLookup(spark, path, table, key)
