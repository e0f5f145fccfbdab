"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Without that setting only a local master, whose one machine holds all, gets a temporary folder;
    a cluster would lose what it writes there, so it must name one.
    """
    sc = spark.sparkContext
    place = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="sluicewire-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever Spark's file systems keep it."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
