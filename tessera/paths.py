"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Scratch that this process made and that may still be read, with the JVM that can delete it.
_MADE: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of our own where that is unset and everything runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is still there when the process ends is deleted then."""
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    _MADE[path] = spark._jvm
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.pop(path, None)


@atexit.register
def _clear() -> None:
    for path, jvm in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    _MADE.clear()
