"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_cleaned: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir, or in one set here for a local session; it goes when Python ends."""
    set_in = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_in is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_in = tempfile.mkdtemp(prefix="keytide-")
        spark.sparkContext.setCheckpointDir(set_in)
        set_in = spark.sparkContext.getCheckpointDir()
    top = f"{set_in.rstrip('/')}/keytide-{spark.sparkContext.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(lambda: spark.sparkContext._jsc is not None and remove(spark, top))
    return top


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"
