"""Where intermediate tables go: the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only if none is named and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = sc.getCheckpointDir()
    if found is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/spanvec")
        found = sc.getCheckpointDir()
    return found


def hadoop_fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = hadoop_fs(spark, path)
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    return path
