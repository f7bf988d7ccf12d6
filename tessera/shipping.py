"""Send this package to the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package as a zip file, so that workers import it from any folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    here, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="tessera-code-")
    archive = shutil.make_archive(f"{folder}/tessera_code", "zip", root_dir=here.parent, base_dir=here.name)
    sc.addPyFile(archive)
    _SENT.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small: at most this many rows each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def ready_for_python(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)
