"""Workbook snapshots and a versioned store with optimistic commits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sheet import Sheet, Workbook

SCHEMA_VERSION = 1


def save_snapshot(spark: SparkSession, book: Workbook, path: str) -> None:
    """Each sheet as Parquet, and the workbook's description as one line of JSON."""
    about = {"schemaVersion": SCHEMA_VERSION, "sheets": [{"name": n, "columns": s.columns} for n, s in book.sheets.items()], "names": book.names, "sheetNames": [[a, b, v] for (a, b), v in book.sheet_names.items()]}
    for i, s in enumerate(book.sheets.values()):
        s.df.write.mode("overwrite").parquet(f"{path}/sheet{i}")
    spark.range(1).select(F.lit(json.dumps(about)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/workbook")


def load_snapshot(spark: SparkSession, path: str) -> Workbook:
    about = json.loads(spark.read.text(f"{path}/workbook").first()[0])
    if about["schemaVersion"] != SCHEMA_VERSION:
        raise ValueError(f"snapshot version {about['schemaVersion']}")
    sheets = {s["name"]: Sheet(spark.read.parquet(f"{path}/sheet{i}"), s["columns"]) for i, s in enumerate(about["sheets"])}
    return Workbook(sheets, about["names"], {(a, b): v for a, b, v in about["sheetNames"]})


class VersionedStore:
    """Versions of a table as folders v0, v1, ...; a commit names the version it builds on and a mutation id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        p = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version; -1 before the first commit."""
        root = self._at("")
        names = [str(s.getPath().getName()) for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return max([int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()], default=-1)

    def load(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def commit(self, df: DataFrame, base: int, mutation: str) -> str:
        """applied, duplicate (this mutation is in already) or conflict (someone else was first)."""
        if self.fs.exists(self._at(f"m-{mutation}")):
            return "duplicate"
        if self.version() != base:
            return "conflict"
        df.write.parquet(f"{self.path}/tmp-{mutation}")
        # a rename onto an existing folder would nest, so the marker file decides between two writers
        if not self.fs.createNewFile(self._at(f"lock-{base + 1}")):
            return "conflict"
        self.fs.rename(self._at(f"tmp-{mutation}"), self._at(f"v{base + 1}"))
        self.fs.createNewFile(self._at(f"m-{mutation}"))
        return "applied"
