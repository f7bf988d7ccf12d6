"""Lookups as joins: a column of lookup formulas becomes one join against the deduplicated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import NA
from ..plans.rows import BUCKET, ROW, number_rows
from .criteria import wildcard as pattern_of


def _key(df: DataFrame, col: str):
    return F.lower(F.col(f"`{col}`")) if dict(df.dtypes)[col] == "string" else F.col(f"`{col}`").cast("double")


def exact(probe: DataFrame, key: str, table: DataFrame, table_key: str, results: dict[str, str], last: bool = False, found: str = "_found") -> DataFrame:
    """VLOOKUP(..., FALSE), XLOOKUP, MATCH(..., 0) for every probe row: the first (or last) match wins.

    results: output name -> column of the table; `found` tells whether there was a match. Text ignores case.
    """
    pick = F.max_by if last else F.min_by
    # the table's own position, under a name that cannot meet the probe's
    best = table.where(F.col(f"`{table_key}`").isNotNull()).groupBy(_key(table, table_key).alias("_k")).agg(*[pick(F.col(f"`{c}`"), F.col(ROW)).alias(n) for n, c in results.items()])
    out = probe.withColumn("_k", _key(probe, key)).join(best.withColumn(found, F.lit(True)), "_k", "left").drop("_k")
    return out.withColumn(found, F.coalesce(F.col(found), F.lit(False)))


def semi(probe: DataFrame, key: str, table: DataFrame, table_key: str, anti: bool = False) -> DataFrame:
    """COUNTIF(range, key) > 0, or = 0."""
    keys = table.select(_key(table, table_key).alias("_k")).distinct()
    return probe.withColumn("_k", _key(probe, key)).join(keys, "_k", "left_anti" if anti else "left_semi").drop("_k")


def is_sorted(table: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """One row (sorted): whether the column never goes against the order along _row. Blank cells are passed over."""
    cells = table.select(F.col(ROW), _key(table, col).alias("_x")).where("_x is not null")
    up = Window.partitionBy("_b").orderBy(ROW)
    bad = (lambda x, y: x < y) if descending else (lambda x, y: x > y)
    # neighbours inside buckets of rows, then the edges of the buckets in order
    steps = cells.withColumn("_b", F.floor(F.col(ROW) / BUCKET)).withColumn("_y", F.lag("_x").over(up))
    edges = steps.groupBy("_b").agg(F.count_if(bad(F.col("_y"), F.col("_x"))).alias("n"), F.min_by("_x", ROW).alias("_first"), F.max_by("_x", ROW).alias("_last"))
    joined = edges.withColumn("_y", F.lag("_last").over(Window.orderBy("_b")))
    return joined.agg(F.coalesce(F.sum(F.col("n") + F.coalesce(bad(F.col("_y"), F.col("_first")), F.lit(False)).cast("int")), F.lit(0)).alias("n")).select((F.col("n") == 0).alias("sorted"))


def nearest(probe: DataFrame, key: str, table: DataFrame, table_key: str, results: dict[str, str], larger: bool = False, first: bool = True, validate: bool | None = None, found: str = "_found") -> DataFrame:
    """Approximate lookup of numbers or of text (case ignored): an equal key, else the largest smaller (or smallest larger).

    An as-of join without a theta join: probe and table rows are put in one sequence, ordered and numbered together, so
    that tasks are cut by the amount of data and not by the table's keys. In buckets of that sequence a window carries
    the nearest table row along; a bucket starts with the one carried over from the buckets before. Of equal keys the
    first row wins (`first`; else the last). With `validate` (as MATCH and VLOOKUP do when sorted data is expected) an
    unsorted table finds nothing; so does a key of another kind than the table's.
    """
    pick = F.min_by if first else F.max_by
    kinds = [dict(d.dtypes)[c] == "string" for d, c in ((table, table_key), (probe, key))]
    t = table.where(F.col(f"`{table_key}`").isNotNull()).groupBy(_key(table, table_key).alias("_k")).agg(*[pick(F.col(f"`{c}`"), F.col(ROW)).alias(n) for n, c in results.items()])
    carried = t.select("_k", F.lit(0).alias("_side"), F.struct(F.col("_k").alias("_at"), *[F.col(n) for n in results]).alias("_t"))
    own = _key(probe, key) if kinds[0] == kinds[1] else F.lit(None).cast("string" if kinds[0] else "double")
    asks = probe.select(own.alias("_k"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in probe.columns]).alias("_p"))
    both = carried.unionByName(asks, allowMissingColumns=True)
    line = number_rows(both, F.col("_k").desc() if larger else F.col("_k").asc(), F.col("_side").asc(), F.monotonically_increasing_id().asc())
    line = line.withColumn("_b", F.floor(F.col(ROW) / BUCKET))
    tops = line.where("_side = 0").groupBy("_b").agg(F.max_by("_t", ROW).alias("_top"))
    every = line.select("_b").distinct().join(tops, "_b", "left")
    before = every.select("_b", F.last("_top", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))
    run = Window.partitionBy("_b").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    hit = line.withColumn("_hit", F.last("_t", ignorenulls=True).over(run)).where("_side = 1").join(before, "_b")
    hit = hit.withColumn("_hit", F.when(F.col("_k").isNotNull(), F.coalesce("_hit", "_top")))
    if validate:
        hit = hit.join(F.broadcast(is_sorted(table, table_key, descending=larger)), how="cross").withColumn("_hit", F.when(F.col("sorted"), F.col("_hit")))
    return hit.select(*[F.col(f"_p.`{c}`").alias(c) for c in probe.columns], *[F.col(f"_hit.{n}").alias(n) for n in results], F.col("_hit").isNotNull().alias(found))


def wildcard_first(table: DataFrame, table_key: str, pattern: str, results: dict[str, str], last: bool = False) -> DataFrame:
    """XLOOKUP(..., 2) for one pattern: one row with the first (or last) matching row's results, null without a match."""
    pick = F.max_by if last else F.min_by
    hit = table.where(F.col(f"`{table_key}`").rlike(pattern_of(pattern)))
    return hit.agg(*[pick(F.col(f"`{c}`"), F.col(ROW)).alias(n) for n, c in results.items()])


def wildcard(probe: DataFrame, key: str, table: DataFrame, table_key: str, results: dict[str, str], last: bool = False, found: str = "_found", block: int = 256) -> DataFrame:
    """XLOOKUP(..., 2) with a cell as the key: plain keys are joined, and patterns are run over the table in blocks."""
    if dict(probe.dtypes)[key] != "string" or dict(table.dtypes)[table_key] != "string":
        return exact(probe, key, table, table_key, results, last, found)
    special = F.col(f"`{key}`").rlike(r"[*?]|~[*?~]")
    patterns = [r[0] for r in probe.where(special).select(F.col(f"`{key}`")).distinct().toLocalIterator()]
    out = exact(probe, key, table, table_key, results, last, found)
    if not patterns:
        return out
    pick, hits = F.max_by if last else F.min_by, None
    for a in range(0, len(patterns), block):
        some = patterns[a : a + block]
        at = F.explode(F.array_compact(F.array(*[F.when(F.col(f"`{table_key}`").rlike(pattern_of(p)), F.lit(a + i)) for i, p in enumerate(some)])))
        one = table.select(at.alias("_i"), ROW, *{c: F.col(f"`{c}`") for c in results.values() if c != ROW}.values()).groupBy("_i").agg(*[pick(F.col(f"`{c}`"), F.col(ROW)).alias(f"_w_{n}") for n, c in results.items()])
        hits = one if hits is None else hits.unionByName(one)
    named = probe.sparkSession.createDataFrame(list(enumerate(patterns)), "_i int, _pat string").join(hits, "_i").drop("_i").withColumn("_wild", F.lit(True))
    out = out.join(named, (F.col(f"`{key}`") == F.col("_pat")) & special, "left")
    for n in results:
        out = out.withColumn(n, F.when(special, F.col(f"_w_{n}")).otherwise(F.col(n)))
    return out.withColumn(found, F.when(special, F.coalesce("_wild", F.lit(False))).otherwise(F.col(found))).drop("_pat", "_wild", *[f"_w_{n}" for n in results])


def with_fallback(df: DataFrame, result: str, found: str = "_found", spare=None) -> DataFrame:
    """A value or error column pair: a miss is the fallback, or #N/A without one."""
    if spare is not None:
        return df.withColumn(result, F.when(F.col(found), F.col(result)).otherwise(F.lit(spare)))
    return df.withColumn(f"{result}_err", F.when(~F.col(found), F.lit(NA)))


def index_rows(df: DataFrame, at: DataFrame, position: str, col: str, out: str) -> DataFrame:
    """INDEX(range, position) for a column of 1-based positions; outside the range is #REF!, below 1 #VALUE!."""
    cells = df.select((F.col(ROW) + 1).alias("_at"), F.col(f"`{col}`").alias(out), F.lit(True).alias("_in"))
    j = at.withColumn("_at", F.floor(F.col(position)).cast("long")).join(cells, "_at", "left")
    err = F.when(F.col("_at") < 1, F.lit("#VALUE!")).when(F.col("_in").isNull(), F.lit("#REF!"))
    return j.withColumn(f"{out}_err", err).drop("_at", "_in")


def across(df: DataFrame, columns: list[str], key_row: int, result_row: int, text_keys: bool, text_results: bool) -> DataFrame:
    """Two rows of a sheet turned into a table: _row (the column's place), key, result. Keys of the other kind are blank."""
    kinds = dict(df.dtypes)

    def cell(c: str, text: bool, strict: bool) -> Column:
        if (kinds[c] == "string") != text and strict:
            return F.lit(None).cast("string" if text else "double")
        return F.col(f"`{c}`").cast("string" if text else "double")

    cells = F.array(*[F.struct(cell(c, text_keys, True).alias("k"), cell(c, text_results, False).alias("r")) for c in columns])
    lines = df.where(F.col(ROW).isin(key_row, result_row)).select(ROW, F.posexplode(cells).alias("_c", "_v"))
    return lines.groupBy(F.col("_c").cast("long").alias("_c")).agg(F.max(F.when(F.col(ROW) == key_row, F.col("_v.k"))).alias("key"), F.max(F.when(F.col(ROW) == result_row, F.col("_v.r"))).alias("result")).withColumnRenamed("_c", ROW)


def horizontal(df: DataFrame, key_row: int, key, result_row: int) -> DataFrame:
    """HLOOKUP(key, range, ...): search one row of the columns, take another row of the column found first."""
    cols = [c for c in df.columns if c != ROW]
    lines = df.where(F.col(ROW).isin(key_row, result_row)).select(ROW, F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("col", "v"))
    keyed = lines.groupBy("col").agg(F.max(F.when(F.col(ROW) == key_row, F.col("v"))).alias("k"), F.max(F.when(F.col(ROW) == result_row, F.col("v"))).alias("r"))
    return keyed.where(F.col("k") == float(key)).agg(F.min_by("r", "col").alias("result"), F.min("col").alias("col"))
