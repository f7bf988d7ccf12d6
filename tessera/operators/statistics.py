"""Order statistics and divisors over columns of any size: no task holds all values, distinct or not."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rows import ROW, number_rows, running
from ..shipping import ready_for_python

#: Beyond this a least common multiple is no number any more.
MOST = 10**308


def quantiles(df: DataFrame, x: Column, ps: list[float]) -> DataFrame:
    """One row (n, q0, q1, ...): exact percentiles by linear interpolation, null where there are no numbers.

    Values are counted, the counts sorted by range and summed up; the rows that hold the wanted ranks remain.
    """
    counts = df.select(x.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(number_rows(counts, F.col("_v").asc()), {"_upto": F.col("_c")}).drop(ROW)
    total = placed.agg(F.coalesce(F.max("_upto"), F.lit(0)).alias("n"))
    made, out = [], [F.col("n")]
    for i, p in enumerate(ps):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            made.append(F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v"))).alias(f"_{side}{i}"))
        share = at - F.floor(at)
        out.append(((1 - share) * F.col(f"_l{i}") + share * F.col(f"_h{i}")).alias(f"q{i}"))
    return placed.join(F.broadcast(total), how="cross").agg(F.max("n").alias("n"), *made).select(*[F.coalesce(c, F.lit(0)).alias("n") if i == 0 else c for i, c in enumerate(out)])


def ranked(df: DataFrame, x: Column, descending: bool = False) -> DataFrame:
    """(_at, v): the numbers by their position from 0 in order."""
    order = F.col("v").desc() if descending else F.col("v").asc()
    return number_rows(df.select(x.alias("v")).where("v is not null"), order).select(F.col(ROW).alias("_at"), "v")


def _gcd(values: np.ndarray) -> int:
    return int(np.gcd.reduce(values)) if len(values) else 0


def _lcm(values) -> int:
    out = 1
    for v in values:
        out = math.lcm(out, int(v))
        if out == 0 or out > MOST:
            break
    return out


def divisor(df: DataFrame, x: Column, lcm: bool) -> DataFrame:
    """One row (value, bad): GCD or LCM of the whole parts; a negative number is bad, and so is a result beyond doubles.

    Every task folds its own numbers into one, and one task folds those.
    """
    ready_for_python(df.sparkSession)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = 1 if lcm else 0
        for b in batches:
            v = np.unique(b.v.to_numpy(np.int64))
            out = _lcm([out, *v]) if lcm else math.gcd(out, _gcd(v))
        yield pd.DataFrame({"v": [str(out)]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [int(v) for b in batches for v in b.v]
        out = _lcm(parts) if lcm else math.gcd(*parts)
        yield pd.DataFrame({"value": [float(out) if out <= MOST else math.inf]})

    whole_parts = df.select(F.floor(x).cast("long").alias("v")).where("v is not null")
    bad = df.agg(F.coalesce(F.min(x) < 0, F.lit(False)).alias("_neg"))
    one = whole_parts.mapInPandas(part, "v string").repartition(1).mapInPandas(whole, "value double")
    return one.join(F.broadcast(bad), how="cross").select("value", (F.col("_neg") | (F.col("value") == math.inf)).alias("bad"))
