"""Row positions without single-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..paths import scratch

ROW = "_row"
BUCKET = 1 << 16


def number_rows(df: DataFrame, *keys: str | Column, path: str | None = None) -> DataFrame:
    """Add _row: dense positions from 0 in key order. Rows are range-partitioned and sorted in place; each partition's
    first position is the count of those before it. The partitions are written once, because the sampled bounds of a
    range partitioning differ from run to run."""
    order = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch(spark, "rows")
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(ROW, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_part", "_start", "_at")


_SNAPSHOTS: dict[tuple, tuple[str, DataFrame]] = {}


def numbered_table(spark: SparkSession, path: str, keys: tuple[str, ...], columns: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table with _row, numbered once per session and state of its files, and only the columns that are read."""
    place, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    status = place(path).getFileSystem(conf).getFileStatus(place(path))
    key = (spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen(), keys, columns, spark.conf.get("spark.sql.shuffle.partitions"))
    held = _SNAPSHOTS.get(key)
    if held is None or not place(held[0]).getFileSystem(conf).exists(place(held[0])):
        df, copy = spark.read.parquet(path), scratch(spark, "rows")
        held = _SNAPSHOTS[key] = copy, number_rows(df.select(*columns) if columns else df, *keys, path=copy)
    return held[1]


def running(df: DataFrame, sums: dict[str, Column], bucket: int = BUCKET, how: dict[str, str] | None = None, by: tuple[str, ...] = (), backwards: bool = False) -> DataFrame:
    """Running totals in _row order: inside buckets of rows, plus the totals of the buckets before.

    how: "min" or "max" for names that aren't sums; by: columns within whose values totals run; backwards: from the
    last row up.
    """
    how = how or {}
    fold = lambda n: {"sum": F.sum, "min": F.min, "max": F.max}[how.get(n, "sum")]
    sort = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    cut = df.withColumn("_b", F.floor(F.col(ROW) / bucket))
    for name, c in sums.items():
        cut = cut.withColumn(f"_v_{name}", c)
    totals = cut.groupBy(*by, "_b").agg(*[fold(n)(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy(sort("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", *[fold(n)(f"_s_{n}").over(before).alias(f"_p_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(sort(ROW)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(totals, [*by, "_b"])
    for n in sums:
        own, earlier = fold(n)(f"_v_{n}").over(inside), F.col(f"_p_{n}")
        both = {"sum": lambda: F.coalesce(own, F.lit(0)) + F.coalesce(earlier, F.lit(0)), "min": lambda: F.least(own, earlier), "max": lambda: F.greatest(own, earlier)}
        joined = joined.withColumn(n, both[how.get(n, "sum")]())
    return joined.drop("_b", *[f"_v_{n}" for n in sums], *[f"_p_{n}" for n in sums])


def neighbourhood(df: DataFrame, low: int, high: int, made: dict, bucket: int = BUCKET) -> DataFrame:
    """Window expressions over rows low..high around each row (made: name -> function of a window). Rows near the edge
    of a bucket are copied into the next one, so that every bucket is a window partition of its own."""
    bucket = max(bucket, high - low + 1)
    b = F.floor(F.col(ROW) / bucket)
    reach = F.array_distinct(F.array(b, F.floor((F.col(ROW) - high) / bucket), F.floor((F.col(ROW) - low) / bucket)))
    spread = df.withColumn("_b", F.explode(reach))
    frame = Window.partitionBy("_b").orderBy(ROW).rowsBetween(low, high)
    for name, f in made.items():
        spread = spread.withColumn(name, f(frame))
    return spread.where(F.col("_b") == F.floor(F.col(ROW) / bucket)).drop("_b")
