"""The cluster's shared folder: cutting lineage, small files, folders that go when the session ends."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a folder of its own, which goes by in that setting from then on;
    on a cluster that is an error, as executors see no folder of another machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", at)
        _goes_at_the_end(spark, at)
    return at


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own type."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def _goes_at_the_end(spark: SparkSession, path: str) -> None:
    fs, own = _file_system(spark, path)
    fs.mkdirs(own)
    fs.deleteOnExit(own)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it is deleted when the session's process ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _goes_at_the_end(spark, at)
    return at


_passing = threading.local()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which is deleted when the process ends, or with
    the block of ``passing`` that it is made in."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
        _goes_at_the_end(spark, sc.getCheckpointDir())
    out = df.checkpoint()
    for made in getattr(_passing, "blocks", [])[-1:]:
        made.append(out)
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is cut inside the block is deleted at its end, so nothing of it may be read later."""
    blocks = _passing.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for df in blocks.pop():
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                fs, own = _file_system(spark, file.get())
                fs.delete(own, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file by any path that Spark can write."""
    fs, own = _file_system(spark, path)
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _file_system(spark, path)
    return bool(fs.exists(own))
