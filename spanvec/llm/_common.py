"""Helpers shared by the operators: words, work folders, worker set-up."""

from __future__ import annotations

import gc
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import work_path

#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
NULL_KEY = -(2**63)
#: A key with more than one row in HOT_SHARE is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def session_ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small.

    Texts may be megabytes long, so a batch is cut at a number of rows and of bytes.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, so that it is computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def byte_words(text: bytes | None) -> list[bytes]:
    """Words of a text given in UTF-8, A-Z in lower case. bytes.split() breaks at just the six bytes of WORD_BREAK."""
    return text.lower().split() if text else []


def per_batch(work):
    """For mapInArrow: ``work`` on each record batch, with Python's cycle collector off meanwhile.

    Tables of seen fragments hold hundreds of thousands of tuples, which it
    would walk again and again; none of them is part of a cycle.
    """

    def run(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            for b in batches:
                yield work(b)
        finally:
            if was:
                gc.enable()

    return run
