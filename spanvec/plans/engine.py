"""The engine: a Spark session, a registry, and SQL with vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as distances
from ..operators.knn import use_index, vector_search
from ..sources import files
from . import dialect, matcher
from .registry import Registry, RegisteredTable, Resolver

#: Keys of an index search that go into a scan's filter; a query for more rows runs exactly.
MOST_KEYS = 1_000


class Engine:
    """``register_all``: distance functions, data sources, and a registry under one roof."""

    def __init__(self, spark: SparkSession, registry: Resolver | None = None):
        self.spark, self.registry = spark, registry or Registry()
        self.views: dict[str, str] = {}
        self.last_query_stats: dict = {}
        distances.register(spark)
        files.register(spark)

    def add_table(self, name: str, vector: str, entry: RegisteredTable | None = None, **given) -> RegisteredTable:
        """Registers ``connection.schema.table``; the SQL may use that name or its last part."""
        key = "::".join([*name.split(".", 2), vector])
        made = self.registry.add(key, vector=vector, **given)
        view = name.split(".")[-1]
        made.scan.createOrReplaceTempView(view)
        self.views[name] = view
        return made

    def vector_search(self, table: str, column: str, q, k: int) -> DataFrame:
        self.last_query_stats = {}
        return vector_search(self.registry, table, column, q, k, self.last_query_stats)

    def sql(self, text: str) -> DataFrame:
        """Runs a query. Exact, unless it has the k-NN shape over a table registered for approximate search."""
        self.last_query_stats = {"path": "exact"}

        def resolve(table: str, column: str, q: list[float], k: int) -> str:
            view = f"_search_{uuid.uuid4().hex}"
            self.vector_search(table, column, q, k).createOrReplaceTempView(view)
            return view

        text = dialect.tables(dialect.table_functions(text, resolve), self.views)
        text = dialect.arrays(text)
        pruned = self._pruned(text)
        return self.spark.sql(dialect.expand_distances(text)) if pruned is None else pruned

    def plan(self, text: str) -> matcher.Match | None:
        """The k-NN search that a query amounts to if its table is registered with the same metric, else None."""
        found = matcher.match(self.spark.sql(dialect.arrays(dialect.tables(text, self.views))))
        name = self._name(found)
        return found if name and self.registry.peek(name).config.metric == found.metric else None

    def _name(self, found: matcher.Match | None) -> str | None:
        return found and next((n for n in self.registry.names() if n.split("::")[-2:] == [found.table, found.column]), None)

    def _pruned(self, text: str) -> DataFrame | None:
        """The same query over only the rows that the stored index finds; None if it is to run exactly.

        The index gives the keys of the k nearest, among those that pass the
        query's filter if it has one and enough rows pass; the scan then reads these rows.
        """
        if not any((m := self.registry.peek(n)) and m.table.approximate for n in self.registry.names()):
            return None
        found = self.plan(text)
        if found is None or found.k > MOST_KEYS:
            return None
        entry = self.registry.prepare(self._name(found))
        if not entry.table.approximate or len(found.query) != entry.config.dimensions:
            return None
        stats: dict = {}
        rows = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, found.valid), self.spark) if found.filtered else None
        indexed = use_index(entry, rows, stats)
        self.last_query_stats = stats | {"filtered": found.filtered}
        if not indexed:
            return None
        near = entry.index.search(self.spark, found.query, found.k, entry.table.nprobe, rows, stats)
        self.last_query_stats |= stats
        keys = [r[0] for r in near.select(entry.key).collect()]
        view = f"_near_{uuid.uuid4().hex}"
        entry.scan.where(F.col(entry.key).isin(keys)).createOrReplaceTempView(view)
        return self.spark.sql(dialect.expand_distances(dialect.tables(text, {found.table: view})))


def register_all(spark: SparkSession, registry: Registry | None = None) -> Engine:
    return Engine(spark, registry)
