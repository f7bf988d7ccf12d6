"""Columnar ingest, paged scans and overlays of edited cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.rows import BUCKET, ROW


def from_columns(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    """A sheet of equally long columns given in memory; numbers become doubles."""
    import pyarrow as pa

    table = pa.table({ROW: pa.array(range(len(next(iter(columns.values()), []))), pa.int64()), **{k: pa.array([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in v]) for k, v in columns.items()}})
    return spark.createDataFrame(table)


def write_pages(df: DataFrame, path: str, bucket: int = BUCKET) -> None:
    """Store a sheet so that a range of rows reads only its pages: partitioned by row bucket, sorted by position."""
    df.withColumn("_page", F.floor(F.col(ROW) / bucket)).repartition("_page").sortWithinPartitions(ROW).write.mode("overwrite").partitionBy("_page").parquet(path)


def read_page(spark: SparkSession, path: str, first: int, last: int, columns: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """Rows [first, last) of some columns: the page filter prunes partitions, the row filter reaches the scan."""
    pages = spark.read.parquet(path)
    return pages.where(F.col("_page").between(first // bucket, max(first, last - 1) // bucket) & (F.col(ROW) >= first) & (F.col(ROW) < last)).select(ROW, *columns)


def overlay(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited cells win over loaded pages. edits: _row, column, value (text), seq; the latest edit of a cell counts,
    and one with a null value clears it. Rows past the end appear."""
    cols = [c for c in base.columns if c != ROW]
    kinds = dict(base.dtypes)
    last = edits.groupBy(ROW, "column").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    wide = last.groupBy(ROW).agg(*[F.max(F.when(F.col("column") == c, F.col("v"))).alias(f"_e_{i}") for i, c in enumerate(cols)])
    j = base.join(wide, ROW, "full")
    return j.select(ROW, *[F.when(F.col(f"_e_{i}").isNotNull(), F.col(f"_e_{i}.value").try_cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(cols)])


def set_block(df: DataFrame, first_row: int, values: dict[str, Sequence]) -> DataFrame:
    """Write a small rectangle of literals."""
    n = len(next(iter(values.values())))
    at = (F.col(ROW) - first_row).cast("int")
    inside = F.col(ROW).between(first_row, first_row + n - 1)
    return df.withColumns({c: F.when(inside, F.get(F.array(*[F.lit(x) for x in v]), at).cast(dict(df.dtypes)[c])).otherwise(F.col(f"`{c}`")) for c, v in values.items()})


def clear_range(df: DataFrame, first: int, last: int, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(ROW).between(first, last), F.col(f"`{c}`")) for c in columns})


def add_rows(df: DataFrame, at: int, count: int) -> DataFrame:
    """Insert empty rows before row `at`."""
    moved = df.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) + count).otherwise(F.col(ROW)))
    new = df.sparkSession.range(at, at + count).select(*[F.col("id").alias(ROW) if c == ROW else F.lit(None).cast(k).alias(c) for c, k in df.dtypes])
    return moved.unionByName(new)


def remove_rows(df: DataFrame, at: int, count: int) -> DataFrame:
    kept = df.where(~F.col(ROW).between(at, at + count - 1))
    return kept.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) - count).otherwise(F.col(ROW)))


def move_rows(df: DataFrame, at: int, count: int, to: int) -> DataFrame:
    """Move rows so that the first of them lands on `to`, a position counted after they are taken out."""
    r = F.col(ROW)
    closed = F.when(r >= at + count, r - count).otherwise(r)
    return df.withColumn(ROW, F.when(r.between(at, at + count - 1), r - at + to).otherwise(closed + F.when(closed >= to, count).otherwise(0)))


def move_columns(df: DataFrame, name: str, to: int) -> DataFrame:
    cols = [c for c in df.columns if c != name]
    cols.insert(to, name)
    return df.select(*cols)


def latest(edits: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last edit per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return edits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
