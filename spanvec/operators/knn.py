"""k nearest neighbours: exact top-k, filtered search with a path chosen by selectivity, search by lookup key."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS, distance
from ..plans.registry import RegisteredTable, Resolver

log = logging.getLogger(__name__)

#: Rows of a query set, and of the table it is held against, that meet in one piece of work.
QUERY_BLOCK, ROW_BLOCK = 256, 2048


def nearest(df: DataFrame, vector: str, q, k: int, metric: str = "l2sq", key: str | None = None, where: Column | str | None = None) -> DataFrame:
    """Rows of df with the k least ``_distance``, ties by key; null and NaN distances are left out.

    One scan with the filter and the columns pushed down; each task keeps its
    own k rows before they meet (TakeOrderedAndProject).  NaN and null sort
    last, so they are left out of the k rows, not of the scan, where a filter
    would work out each distance once more.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    rows = df.where(where) if where is not None else df
    rows = rows.withColumn("_distance", distance(metric, f"`{vector}`", q))
    return rows.orderBy(F.col("_distance").asc_nulls_last(), *([F.col(key).asc()] if key else [])).limit(k).where("_distance is not null and not isnan(_distance)")


@dataclass(frozen=True)
class KnnPlan:
    """One search over a registered table."""

    table: str
    entry: RegisteredTable
    query: tuple[float, ...]
    k: int
    filters: tuple[str, ...] = ()

    def explain(self) -> str:
        c = self.entry.config
        text = f"KnnSearch: table={self.table}, col={self.entry.vector}, k={self.k}, dist={METRICS[c.metric]}"
        return text + (f", filters=[{' AND '.join(self.filters)}]" if self.filters else "")

    def candidates(self, stats: dict) -> DataFrame:
        """(key, _distance) of the k nearest, by the path that the filter's selectivity asks for."""
        e = self.entry
        rows = e.scan
        for f in self.filters:
            rows = rows.where(f)
        if use_index(e, rows if self.filters else None, stats):
            return e.index.search(e.scan.sparkSession, self.query, self.k, e.table.nprobe, rows if self.filters else None, stats)
        return nearest(rows.select(e.key, e.vector), e.vector, self.query, self.k, e.config.metric, e.key).select(e.key, "_distance")

    def execute(self, stats: dict | None = None) -> DataFrame:
        """The lookup's columns and ``_distance``; keys that the lookup lacks are left out."""
        stats = {} if stats is None else stats
        if len(self.query) != self.entry.config.dimensions:
            raise ValueError(f"vector dimensions must match: {len(self.query)} and {self.entry.config.dimensions}")
        found = self.candidates(stats)
        log.info("%s: %s", self.explain(), stats)
        # k rows at most, which the query states: small enough to send to every task unless k is huge
        side = F.broadcast(found) if self.k <= 100_000 else found
        return self.entry.lookup.scan().join(side, self.entry.key).select(*self.entry.lookup.schema.fieldNames(), "_distance")


def use_index(entry: RegisteredTable, valid: DataFrame | None, stats: dict) -> bool:
    """Whether the stored index is to be searched; with a filter only if it passes enough rows (``valid``). Tells in ``stats``."""
    stats |= {"path": "exact"}
    if entry.index is None or entry.index.path is None or not entry.table.approximate:
        return False
    if valid is not None:
        n, total = valid.count(), max(1, entry.index.size)
        stats |= {"valid_rows": n, "total_rows": total, "selectivity": n / total}
        if n / total <= entry.table.brute_force_selectivity:
            return False
    stats["path"] = "index"
    return True


def vector_search(resolver: Resolver, table: str, column: str, q, k: int, stats: dict | None = None) -> DataFrame:
    """``vector_search_vector('connection.schema.table', 'column', ARRAY[...], k)`` as a DataFrame; order is not promised."""
    parts = table.split(".", 2)
    if len(parts) < 3:
        raise ValueError(f"Expected 'connection.schema.table', got {table!r}")
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must be an integer, not below zero")
    entry = resolver.resolve("::".join([*parts, column]))
    if entry is None:
        raise LookupError(f"no loaded vector index for {table}.{column}")
    return KnnPlan(table, entry, tuple(float(x) for x in q), k).execute(stats)


def _packed(df: DataFrame, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows put together: keys, their vectors one after the other, and the vectors' length. Vectors that are null or have a null or NaN are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        keys, parts, dims = [], [], None
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32) if v.is_valid else None
                if x is None or np.isnan(x).any():
                    continue
                if dims is not None and len(x) != dims:
                    raise ValueError(f"vector dimensions must match: {len(x)} and {dims}")
                dims = len(x)
                keys.append(k)
                parts.append(x)
                if len(keys) == size:
                    yield block(keys, parts, dims)
                    keys, parts = [], []
        if keys:
            yield block(keys, parts, dims)

    def block(keys, parts, dims):
        return pa.RecordBatch.from_pydict({f"{prefix}_keys": [keys], f"{prefix}_flat": [np.concatenate(parts)], f"{prefix}_dims": pa.array([dims], pa.int32())})

    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, f"{prefix}_keys array<{kind}>, {prefix}_flat array<float>, {prefix}_dims int")


def knn_join(left: DataFrame, right: DataFrame, left_vector: str, right_vector: str, k: int, left_key: str, right_key: str, metric: str = "l2sq") -> DataFrame:
    """(left_key, right_key, _distance): the k nearest rows of ``right`` for each row of ``left``, a stated query set.

    Blocks of queries meet blocks of rows; of each meeting only k rows a query
    go on, and each task keeps k of them before the shuffle.  Blocks of queries are
    sent to every task if Spark finds them small, else the blocks are dealt
    out in pairs; nothing is gathered on the driver.  Ties go to the least key.
    Vectors that are null or hold a null or NaN have no neighbours and are
    none; different lengths are an error ("must match").
    """
    of = METRICS[metric]
    types = {"q": left.schema[left_key].dataType.simpleString(), "r": right.schema[right_key].dataType.simpleString()}

    def meet(batches):
        for b in batches:
            for qk, qf, qd, rk, rf, rd in zip(*(b.column(i) for i in range(6))):
                if qd.as_py() != rd.as_py():
                    raise ValueError(f"vector dimensions must match: {qd.as_py()} and {rd.as_py()}")
                yield from _meeting(of, k, qk.values, np.asarray(qf.values), rk.values, np.asarray(rf.values), qd.as_py())

    pairs = _packed(right, right_key, right_vector, ROW_BLOCK, "r").crossJoin(_packed(left, left_key, left_vector, QUERY_BLOCK, "q")).select("q_keys", "q_flat", "q_dims", "r_keys", "r_flat", "r_dims")
    out = pairs.mapInArrow(meet, f"q {types['q']}, r {types['r']}, _distance float")
    w = Window.partitionBy("q").orderBy("_distance", "r")
    best = out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return best.select(F.col("q").alias(left_key), F.col("r").alias(right_key), "_distance")


def _meeting(of: str, k: int, q_keys, q_flat, r_keys, r_flat, dims: int):
    """Record batches (q, r, _distance): the k nearest of a block of rows for each of a block of queries. Sums run from left to right."""
    q, v = (x.astype(np.float64).reshape(-1, dims) for x in (q_flat, r_flat))
    order = np.argsort(np.asarray(r_keys), kind="stable")
    add = lambda x: np.add.accumulate(x, axis=1)[:, -1] if dims else np.zeros(len(x))
    norms = np.sqrt(add(v * v)) if of == "cosine_distance" else None
    for i, x in enumerate(q):
        if of == "l2_distance":
            d = add((v - x) ** 2)
        elif of == "negative_dot_product":
            d = -add(v * x)
        else:
            both = norms * np.sqrt(add(x[None] * x[None]))
            d = np.where(both == 0, 1.0, 1 - add(v * x) / np.where(both == 0, 1, both))
        d = d.astype(np.float32)
        take = order[np.argsort(d[order], kind="stable")[:k]]
        take = take[~np.isnan(d[take])]
        yield pa.RecordBatch.from_arrays([pa.array([q_keys[i].as_py()] * len(take), q_keys.type), r_keys.take(pa.array(take)), pa.array(d[take], pa.float32())], ["q", "r", "_distance"])
