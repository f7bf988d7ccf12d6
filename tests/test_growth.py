"""What keeps time in proportion to the rows, and results at sizes beyond the small tables."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import view
from tessera.plans.rows import ROW

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["date_parts", "date_fraction", "fin_annuity", "text_codes"])
def test_formulas_compile_to_few_projections_over_all_cores(spark, name):
    """Interpreted lambdas and trees that multiply made rows cost milliseconds; one file was one task."""
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert plan.count("Project [") < 30
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_product_beyond_the_largest_number(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit(2.0).alias("p_retailprice"), F.lit(50).alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["fn_geomean_product"](spark, str(tmp_path)).first()
    assert got.geomean == 2.0
    assert got.product == math.inf


@pytest.mark.parametrize("up", [False, True])
def test_jumps_fold_frames_once(spark, up):
    """No window frame runs to the last row: Spark computes such a frame anew for every row."""
    n = 150_000
    df = spark.range(n).select(F.col("id").alias(ROW), F.when((F.col("id") % 70_000 > 3) & (F.col("id") % 70_000 < 69_000), 1).alias("v"))
    edges = view.data_edges(df, "v", up)
    assert "RowFrame, 1, unboundedfollowing" not in edges._jdf.queryExecution().optimizedPlan().toString()
    filled = [3 < i % 70_000 < 69_000 for i in range(n)]
    step, end = (-1, 0) if up else (1, n - 1)
    want, nxt = {}, {True: None, False: None}
    for i in range(end, -1 if not up else n, -step):
        gap = end if nxt[False] is None else nxt[False] - step
        want[i] = gap if filled[i] and gap != i else end if nxt[True] is None else nxt[True]
        nxt[filled[i]] = i
    assert {r[ROW]: r.edge for r in edges.collect()} == want


def test_remembered_mutations_are_looked_up_not_searched():
    """A mutation's echo costs the same however many are remembered, and only the last ones are."""
    from tessera.streaming import oplog

    class Counted(str):
        compared = 0
        __hash__ = str.__hash__

        def __eq__(self, other):
            Counted.compared += 1
            return str.__eq__(self, other)

    n, acks = 6_000, []
    version, out = oplog.advance(0, {}, acks, [(i + 1, Counted(f"m{i}"), "op") for i in range(n)])
    assert version == n and {o[3] for o in out} == {"applied"}
    assert acks == [f"m{i}" for i in range(n - oplog.MOST_ACKS, n)]
    assert Counted.compared < 20 * n
    assert [o[3] for o in oplog.advance(version, {}, acks, [(1, "m0", "op"), (n, f"m{n - 1}", "op")])[1]] == ["stale", "echo"]
