"""An inverted-file index: vectors by nearest of a few centroids.

Centroids are fitted on a bounded sample; every row is indexed.  An index is
stored as a folder: the rows (key, vector) in a folder for each list, and a
description with the centroids.  A search reads the lists nearest to the query
and widens to all of them while it has fewer than k rows, so a filter never
costs results.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import sql_negative_dot, vector_literal
from ..plans.registry import IndexConfig
from .knn import nearest

#: Rows that the centroids are fitted on, about.
SAMPLE = 100_000
#: A search of at most so many rows brings them to the driver, so that it is not run again by what follows.
COLLECTED = 100_000


def _fit(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(1))
    centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        own = ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)
        centroids = np.stack([points[own == i].mean(0) if (own == i).any() else centroids[i] for i in range(len(centroids))])
    return centroids


@dataclass
class IvfIndex:
    config: IndexConfig
    key: str
    vector: str
    centroids: np.ndarray
    size: int
    path: str | None = None
    lists: DataFrame | None = None

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, config: IndexConfig, path: str | None = None, sample: int = SAMPLE) -> IvfIndex:
        """Without a path the lists are not stored, and searches of a registered table stay exact."""
        rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
        n = rows.count()
        some = rows if n <= sample else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) < sample)
        points = np.array([r[0] for r in some.select(vector).toLocalIterator()], float).reshape(-1, config.dimensions)
        if config.metric == "cos" and len(points):
            points = points / np.maximum(1e-12, np.linalg.norm(points, axis=1, keepdims=True))
        centroids = _fit(points, config.lists) if len(points) else np.zeros((1, config.dimensions))
        made = cls(config, key, vector, centroids, n)
        return made.save(rows, path) if path else made

    def save(self, rows: DataFrame, path: str) -> IvfIndex:
        """Stores lists and description; a list that is large is cut by a hash of the key, so that no task writes it alone."""
        spread = F.pmod(F.xxhash64(self.key), F.lit(max(1, self.size // (SAMPLE * len(self.centroids)) + 1)))
        listed = self.assigned(rows.select(self.key, self.vector))
        listed.repartition("list_id", spread).sortWithinPartitions("list_id", self.key).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        about = {"config": asdict(self.config), "key": self.key, "vector": self.vector, "size": self.size, "centroids": self.centroids.tolist()}
        rows.sparkSession.createDataFrame(pa.table({"value": [json.dumps(about)]})).coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return self.view(rows.sparkSession, path)

    @classmethod
    def view(cls, spark: SparkSession, path: str) -> IvfIndex:
        """A stored index; searches read what they need from its folder."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        made = cls(IndexConfig(**about["config"]), about["key"], about["vector"], np.array(about["centroids"]), about["size"], path)
        made.lists = spark.read.parquet(f"{path}/lists") if made.size else None
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        """A stored index whose lists the executors keep once they have read them."""
        made = cls.view(spark, path)
        made.lists = made.lists.cache() if made.lists is not None else None
        return made

    def assigned(self, df: DataFrame) -> DataFrame:
        """df with ``list_id``; the centroids, whose number is a parameter, are literals of the plan."""
        norm = [float(x) for x in (self.centroids**2).sum(1)]
        lists = F.array(*(F.expr(f"{norm[i]!r}D + 2 * CAST({sql_negative_dot(f'`{self.vector}`', vector_literal(c))} AS DOUBLE)") for i, c in enumerate(self.centroids)))
        return df.withColumn("list_id", F.transform(F.array(lists), lambda x: F.array_position(x, F.array_min(x)))[0].cast("int") - 1)

    def order(self, q) -> list[int]:
        q = np.asarray(q, float)
        if self.config.metric == "cos":
            q = q / max(1e-12, np.linalg.norm(q))
        score = -(self.centroids @ q) if self.config.metric == "ip" else ((self.centroids - q) ** 2).sum(1)
        return np.argsort(score, kind="stable").tolist()

    def search(self, spark: SparkSession, q, k: int, nprobe: int, valid: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
        """(key, _distance) of about the k nearest, among the rows of ``valid`` if given, by the stored lists."""
        if self.path is None:
            raise ValueError("the index is not stored: build it with a path, or search exactly")
        stats = {} if stats is None else stats
        order, probes = self.order(q), max(1, nprobe)
        pool = self.lists if self.lists is not None else spark.range(0).select(F.col("id").alias(self.key), F.array().cast("array<float>").alias(self.vector), F.lit(0).alias("list_id"))
        if valid is not None:
            pool = pool.join(valid.select(self.key), self.key, "left_semi")
        while True:
            found = nearest(pool.where(F.col("list_id").isin(order[:probes])), self.vector, q, k, self.config.metric, self.key).select(self.key, "_distance")
            stats |= {"lists_read": min(probes, len(order)), "lists": len(order)}
            if k <= COLLECTED:
                rows = found.toArrow()
                if probes >= len(order) or rows.num_rows >= k:
                    return spark.createDataFrame(rows)
            elif probes >= len(order) or found.count() >= k:
                return found
            probes *= 2


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    n = exact.count()
    return found.join(exact.select(key), key, "left_semi").count() / n if n else 1.0
