"""Dynamic arrays over DataFrames with _row: the relational algebra of formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CALC, VALUE
from ..plans.rows import ROW, number_rows
from .ordering import formula_order


class ArrayError(ValueError):
    """An array formula's error value, known when the plan is built."""


def filter_rows(df: DataFrame, include: Column, if_empty: dict | None = None) -> DataFrame:
    """FILTER by a row mask. With if_empty a row of those values appears when nothing is included."""
    kept = df.where(F.coalesce(include, F.lit(False)))
    if if_empty is None:
        return kept
    none = kept.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(*[F.lit(if_empty.get(c)).cast(dict(df.dtypes)[c]).alias(c) for c in df.columns])
    return kept.unionByName(none)


def filter_columns(df: DataFrame, mask: Sequence[bool]) -> DataFrame:
    cols = [c for c in df.columns if c != ROW]
    kept = [c for c, m in zip(cols, mask) if m]
    if not kept:
        raise ArrayError(CALC)
    return df.select(*kept, *[ROW] * (ROW in df.columns))


def sort_rows(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """SORT: stable, renumbered."""
    kinds = dict(df.dtypes)
    return number_rows(df.withColumnRenamed(ROW, "_old"), formula_order(F.col(f"`{col}`"), kinds[col], descending), F.col("_old").asc()).drop("_old")


def unique(df: DataFrame, cols: Sequence[str], exactly_once: bool = False) -> DataFrame:
    """UNIQUE in order of first appearance; text ignores case and the two zeros are one."""
    kinds = dict(df.dtypes)
    keys = [(F.lower(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`") + 0.0 if kinds[c] == "double" else F.col(f"`{c}`")).alias(f"_k{i}") for i, c in enumerate(cols)]
    out = df.select(ROW, *cols, *keys).groupBy(*[f"_k{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(ROW, *cols)).alias("_f"))
    out = out.where("_n = 1") if exactly_once else out
    return out.select("_f.*")


def transpose(df: DataFrame, rows: int) -> DataFrame:
    """TRANSPOSE of the first `rows` rows: one row per column, cells r0, r1, ..."""
    cols = [c for c in df.columns if c != ROW]
    cells = df.where(F.col(ROW) < rows).select(ROW, F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("col", "v"))
    return cells.groupBy("col").agg(*[F.max(F.when(F.col(ROW) == r, F.col("v"))).alias(f"r{r}") for r in range(rows)]).withColumnRenamed("col", ROW)


def sequence(spark, rows: int, cols: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE, row by row."""
    if rows < 1 or cols < 1:
        raise ArrayError(CALC if rows == 0 or cols == 0 else VALUE)
    return spark.range(rows).select(F.col("id").alias(ROW), *[(F.lit(float(start)) + F.lit(float(step)) * (F.col("id") * cols + c)).alias(f"c{c}") for c in range(cols)])


def _slice(n: int, size: Column, keep: bool) -> Column:
    r = F.col(ROW)
    if keep:
        return r < n if n > 0 else r >= size + n
    return r >= n if n > 0 else r < size + n


def take(df: DataFrame, n: int) -> DataFrame:
    """TAKE rows from the start (n > 0) or the end; 0 is #CALC!."""
    return _cut(df, n, True)


def drop(df: DataFrame, n: int) -> DataFrame:
    """DROP rows from the start (n > 0) or the end."""
    return _cut(df, n, False)


def _cut(df: DataFrame, n: int, keep: bool) -> DataFrame:
    if n == 0:
        raise ArrayError(CALC)
    if n > 0:
        return df.where(_slice(n, F.lit(0), keep))
    size = df.agg((F.coalesce(F.max(ROW), F.lit(-1)) + 1).alias("_size"))
    return df.join(F.broadcast(size), how="cross").where(_slice(n, F.col("_size"), keep)).drop("_size")


def choose_columns(df: DataFrame, at: Sequence[int]) -> DataFrame:
    """CHOOSECOLS by 1-based places, from the end if negative; a repeated column gets a numbered name."""
    cols, out, seen = [c for c in df.columns if c != ROW], [], {}
    for i in at:
        if i == 0 or abs(i) > len(cols):
            raise ArrayError(VALUE)
        c = cols[i - 1 if i > 0 else i]
        seen[c] = seen.get(c, 0) + 1
        out.append(F.col(f"`{c}`").alias(c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return df.select(*out, *[ROW] * (ROW in df.columns))


def choose_rows(df: DataFrame, at: Sequence[int]) -> DataFrame:
    """CHOOSEROWS by 1-based places, from the end if negative, repeats allowed; the list is part of the formula."""
    if not at or 0 in at:
        raise ArrayError(VALUE)
    spark = df.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in at])).alias("_new", "_at"))
    size = df.agg((F.coalesce(F.max(ROW), F.lit(-1)) + 1).alias("_size"))
    places = wanted.join(F.broadcast(size), how="cross").select("_new", F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(F.col("_size") + F.col("_at")).alias(ROW))
    return df.join(F.broadcast(places), ROW).drop(ROW).withColumn(ROW, F.col("_new").cast("long")).drop("_new")


def shape(df: DataFrame) -> DataFrame:
    """ROWS and COLUMNS."""
    return df.agg(F.count(F.lit(1)).cast("double").alias("n_rows")).withColumn("n_columns", F.lit(float(len([c for c in df.columns if c != ROW]))))
