"""Folders that driver and executors share, and files that Spark's readers pass over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def visible(spark: SparkSession, path: str, name: str, depth: int = 3) -> str:
    """A shared folder with copies of the files ``name``, one a run, at most ``depth`` folders below a path, each in a folder named as its own was.

    Spark's readers pass over names that begin with an underscore; copies lose it. They are streamed one by one and never held in memory.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out = folder(spark, "runs")
    target = hadoop.Path(out).getFileSystem(conf)
    target.mkdirs(hadoop.Path(out))
    source = hadoop.Path(path).getFileSystem(conf)
    for d in range(depth + 1):
        for n, status in enumerate(source.globStatus(hadoop.Path(f"{path}/{'*/' * d}{name}")) or ()):
            at = status.getPath()
            hadoop.FileUtil.copy(source, at, target, hadoop.Path(f"{out}/{d}-{n}/{at.getParent().getName()}/{name.lstrip('_')}"), False, conf)
    return out
