"""A folder that driver and executors share, for what one job writes and another reads."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that is unset, a local master gets a temporary folder of its own; on a cluster it is an error, as executors
    would not see the driver's disk.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if here:
        return here
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    here = tempfile.mkdtemp(prefix="rangeloom-")
    spark.sparkContext.setCheckpointDir(here)
    atexit.register(shutil.rmtree, here, True)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the application's part of the shared folder, which goes when the application ends."""
    top = f"{shared_dir(spark).rstrip('/')}/rangeloom-{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        atexit.register(_sweep, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop(spark, top)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
