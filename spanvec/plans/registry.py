"""Registered vector tables: what an index needs to know, and where its rows come from."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.distance import METRICS
from ..sources.lookup import Lookup


@dataclass(frozen=True)
class IndexConfig:
    dimensions: int
    metric: str = "l2sq"
    lists: int = 16

    def __post_init__(self):
        if self.dimensions < 1 or self.lists < 1:
            raise ValueError("dimensions and lists must be above zero")
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")


@dataclass(frozen=True)
class TableConfig:
    #: Lists probed by an approximate search before it widens; random vectors need most of them for a recall of 0.9.
    nprobe: int = 12
    #: At most this share of rows passing a filter are searched exactly.
    brute_force_selectivity: float = 0.05
    #: Exact search unless an index is registered and this is set.
    approximate: bool = False


@dataclass(frozen=True)
class RegisteredTable:
    scan: DataFrame
    lookup: Lookup
    key: str
    vector: str
    config: IndexConfig
    table: TableConfig = field(default_factory=TableConfig)
    index: object | None = None

    @property
    def schema(self) -> T.StructType:
        """Of a search: the lookup's columns and ``_distance``."""
        return T.StructType([*self.lookup.schema.fields, T.StructField("_distance", T.FloatType())])


@dataclass(frozen=True)
class IndexMeta:
    """What a planner needs to know of a table before its index is loaded."""

    config: IndexConfig
    table: TableConfig
    key: str
    vector: str
    schema: T.StructType


class Resolver(Protocol):
    """Finds registered tables by ``connection::schema::table::column``."""

    def peek(self, name: str) -> IndexMeta | None:
        """What is known without reading anything; None if there is no such table."""

    def resolve(self, name: str) -> RegisteredTable | None:
        """The table if it is loaded, else None."""

    def prepare(self, name: str) -> RegisteredTable:
        """The table, loaded if need be; a query keeps this one whatever is registered meanwhile."""

    def names(self) -> list[str]:
        """Names of all tables known."""


class Registry:
    """Tables by ``connection::schema::table::column``; snapshots are immutable, so a query keeps what it began with."""

    def __init__(self):
        self._tables: dict[str, RegisteredTable] = {}
        self._lock = threading.RLock()

    def add(self, name: str, scan: DataFrame, lookup: Lookup | DataFrame, key: str, vector: str, config: IndexConfig, table: TableConfig | None = None, index=None) -> RegisteredTable:
        if isinstance(lookup, DataFrame):
            if key not in lookup.columns:
                raise ValueError(f"key column {key!r} is not in the lookup schema")
            lookup = Lookup(lookup, key)
        if key not in lookup.schema.fieldNames():
            raise ValueError(f"key column {key!r} is not in the lookup schema")
        if key not in scan.columns:
            raise ValueError(f"key column {key!r} is not in the scan schema")
        if vector not in scan.columns:
            raise ValueError(f"vector column {vector!r} is not in the scan schema")
        made = RegisteredTable(scan, lookup, key, vector, config, table or TableConfig(), index)
        with self._lock:
            self._tables[name] = made
        return made

    def configure(self, name: str, **changes) -> None:
        with self._lock:
            self._tables[name] = replace(self._tables[name], table=replace(self._tables[name].table, **changes))

    def get(self, name: str) -> RegisteredTable | None:
        with self._lock:
            return self._tables.get(name)

    def peek(self, name: str) -> IndexMeta | None:
        e = self.get(name)
        return IndexMeta(e.config, e.table, e.key, e.vector, e.schema) if e else None

    def resolve(self, name: str) -> RegisteredTable | None:
        return self.get(name)

    def prepare(self, name: str) -> RegisteredTable:
        found = self.get(name)
        if found is None:
            raise LookupError(f"table {name!r} is not loaded")
        return found

    def remove_by_prefix(self, prefix: str) -> int:
        with self._lock:
            gone = [k for k in self._tables if k.startswith(prefix)]
            for k in gone:
                del self._tables[k]
            return len(gone)

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._tables)


class LoadingResolver:
    """Tables whose indexes are loaded when a query first needs them.

    ``known`` has the metadata of each table, ``load(name)`` gives the table.
    """

    def __init__(self, known: dict[str, IndexMeta], load: Callable[[str], RegisteredTable]):
        self._known, self._load, self._loaded, self._lock = dict(known), load, {}, threading.RLock()

    def peek(self, name: str) -> IndexMeta | None:
        return self._known.get(name)

    def resolve(self, name: str) -> RegisteredTable | None:
        return self._loaded.get(name)

    def prepare(self, name: str) -> RegisteredTable:
        with self._lock:
            if name not in self._loaded:
                if name not in self._known:
                    raise LookupError(f"table {name!r} is not loaded")
                self._loaded[name] = self._load(name)
            return self._loaded[name]

    def names(self) -> list[str]:
        return sorted(self._known)
