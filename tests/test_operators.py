import pytest
from pyspark.sql import functions as F

from tessera.operators import arrays, lookups, view
from tessera.operators.criteria import matches, parse_criterion
from tessera.operators.ordering import MIXED, view_order
from tessera.operators.sheet import Sheet, Workbook, cell_val
from tessera.operators.view import Compare, Contains, Values, View
from tessera.plans.rows import ROW, neighbourhood, number_rows, running
from tessera.sources import delimited, paged, snapshot, xlsx
from tessera.streaming.oplog import MOST_PENDING, advance, rebase_index


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(0, 30.0, "b"), (1, 10.0, "A"), (2, None, None), (3, 20.0, ""), (4, 10.0, "a")], "_row long, n double, t string")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_sort_is_stable_and_descending_puts_blanks_first(cells):
    assert rows(View(sort=(("n", False),)).plan(cells), ROW) == [1, 4, 3, 0, 2]
    assert rows(View(sort=(("n", True),)).plan(cells), ROW) == [2, 0, 3, 1, 4]


def test_mixed_cells_follow_view_order(spark):
    data = [(0, (5, None, None, None, "#DIV/0!")), (1, (2, None, "beta", None, None)), (2, (3, None, None, True, None)), (3, (2, None, "alpha", None, None)), (4, (1, 7.0, None, None, None)), (5, (0, None, None, None, None))]
    df = spark.createDataFrame(data, f"_row long, v {MIXED}")
    assert rows(df.orderBy(view_order(F.col("v"), mixed=True), ROW), ROW) == [4, 0, 3, 1, 2, 5]
    assert rows(df.orderBy(view_order(F.col("v"), True, mixed=True), ROW), ROW) == [5, 2, 1, 3, 0, 4]


def test_filters(cells):
    keep = lambda c, f: sorted(rows(cells.where(f.predicate(cells, c)), ROW))
    assert keep("t", Contains("a")) == [1, 4]
    assert keep("t", Contains("a", True)) == [4]
    assert keep("t", Contains("")) == [0, 1, 3, 4]
    assert keep("n", Contains("0")) == [0, 1, 3, 4]
    assert keep("n", Compare("neq", 10.0)) == [0, 3]
    assert keep("t", Compare("neq", 10.0)) == []
    assert keep("t", Values(("b", None))) == [0, 2]
    assert keep("n", Values(("10",))) == []


def test_filter_and_sort_commute(cells):
    v = View({"n": Compare("gte", 10.0)}, (("t", False),))
    assert rows(v.plan(cells), ROW) == [r for r in rows(View(sort=v.sort).plan(cells), ROW) if r != 2]


def test_search_edges_and_distinct(cells):
    assert rows(view.search(cells, "a", ["n", "t"]), ROW, "col") == [(1, 1), (4, 1)]
    assert view.search(cells, "", ["t"]).count() == 0
    assert dict(rows(view.data_edges(cells, "n"), ROW, "edge")) == {0: 1, 1: 3, 2: 3, 3: 4, 4: 4}
    assert rows(view.distinct_values(cells, "n"), "value") == [30.0, 10.0, None, 20.0]


def test_criteria(spark):
    df = spark.createDataFrame([(0, "Alpha"), (1, "a*"), (2, "ax"), (3, "a~b")], "_row long, t string")
    v = cell_val(df, "t")
    count = lambda c: df.where(matches(v, parse_criterion(c))).count()
    assert [count(c) for c in ("a?", "a~*", "a~b", "a*", "<>a*", "=AX", "<>zzz", ">b")] == [2, 1, 1, 4, 0, 1, 4, 0]
    assert df.where(matches(v, parse_criterion(2))).count() == 0


def test_lookups(spark):
    t = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "b"), (2, 2.0, "c"), (3, 4.0, "d")], "_row long, k double, r string")
    p = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, 3.0), (3, 9.0), (4, None)], "_row long, x double")
    near = lambda **k: {r[ROW]: r.r for r in lookups.nearest(p, "x", t, "k", {"r": "r"}, **k).collect()}
    assert near() == {0: None, 1: "b", 2: "b", 3: "d", 4: None}
    assert near(larger=True) == {0: "a", 1: "b", 2: "d", 3: None, 4: None}
    assert near(validate=True)[1] == "b"
    unsorted = t.withColumn("k", -F.col("k"))
    assert {r.r for r in lookups.nearest(p, "x", unsorted, "k", {"r": "r"}, validate=True).collect()} == {None}
    last = lookups.exact(p, "x", t, "k", {"r": "r"}, last=True)
    assert {r[ROW]: r.r for r in last.collect()} == {0: None, 1: "c", 2: None, 3: None, 4: None}


def test_nearest_over_many_ranges_matches_a_scan(spark):
    t = spark.range(500).select(F.col("id").alias(ROW), (F.col("id") * 7 % 1000).cast("double").alias("k"), F.col("id").alias("r"))
    p = spark.range(1200).select(F.col("id").alias(ROW), (F.col("id") - 100).cast("double").alias("x"))
    got = {r[ROW]: r.r for r in lookups.nearest(p, "x", t, "k", {"r": "r"}).collect()}
    keys = sorted((i * 7 % 1000, i) for i in range(500))
    for i in range(0, 1200, 7):
        below = [x for x in keys if x[0] <= i - 100]
        assert got[i] == (min(j for k, j in below if k == below[-1][0]) if below else None)


def test_arrays(spark, cells):
    assert rows(arrays.unique(cells, ["t"]).orderBy(ROW), ROW) == [0, 1, 2, 3]
    assert rows(arrays.unique(cells, ["n"], exactly_once=True).orderBy(ROW), ROW) == [0, 2, 3]
    assert rows(arrays.take(cells, -2).orderBy(ROW), ROW) == [3, 4]
    assert rows(arrays.choose_rows(cells, [-1, 1, 1]).orderBy(ROW), "n") == [10.0, 30.0, 30.0]
    with pytest.raises(arrays.ArrayError):
        arrays.take(cells, 0)
    with pytest.raises(arrays.ArrayError):
        arrays.choose_columns(cells, [3])
    assert arrays.filter_rows(cells, F.col("n") > 99, {"n": -1.0, "t": "none", ROW: 0}).first().t == "none"


def test_row_positions_survive_partitions(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"))
    got = number_rows(df, "k").orderBy("k").select(ROW).collect()
    assert [r[0] for r in got] == list(range(20_000))


def test_windows_cross_buckets(spark):
    df = spark.range(100).select(F.col("id").alias(ROW), F.col("id").cast("double").alias("v"))
    got = neighbourhood(df, -2, 3, {"s": lambda w: F.sum("v").over(w)}, bucket=8)
    assert {r[ROW]: r.s for r in got.collect()} == {i: float(sum(range(max(0, i - 2), min(99, i + 3) + 1))) for i in range(100)}
    got = running(df, {"s": F.col("v")}, bucket=8)
    assert {r[ROW]: r.s for r in got.collect()} == {i: float(sum(range(i + 1))) for i in range(100)}


def test_row_edits(cells):
    assert sorted(rows(paged.add_rows(cells, 1, 2), ROW)) == list(range(7))
    assert dict(rows(paged.move_rows(cells, 0, 2, 3), ROW, "n")) == {3: 30.0, 4: 10.0, 0: None, 1: 20.0, 2: 10.0}
    assert dict(rows(paged.remove_rows(cells, 1, 2), ROW, "n")) == {0: 30.0, 1: 20.0, 2: 10.0}


def test_csv_hardening_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(0, '=cmd("x")', 1.5), (1, "two\nlines, quoted", None), (2, None, 3.0)], "_row long, t string, n double")
    delimited.write_csv(df, str(tmp_path / "c"))
    back = delimited.read_delimited(spark, str(tmp_path / "c" / "body"), [("t", "text", True), ("n", "number", True), ("h", "number", False)], header=False)
    assert sorted(back.collect(), key=str) == sorted([("'=cmd(\"x\")", 1.5, None), ("two\nlines, quoted", None, None), (None, 3.0, None)], key=str)


def test_typed_input(spark):
    df = spark.createDataFrame([("$1,200.50",), ("(5)",), ("12%",), ("x",)], "s string")
    assert rows(df.select(delimited.parse_input(F.col("s"), "currency").alias("v")), "v") == [1200.5, -5.0, 0.12, None]


def test_xlsx_and_snapshot_round_trip(spark, cells, tmp_path):
    xlsx.write_xlsx(cells, str(tmp_path / "a.xlsx"))
    back = xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx")).orderBy(ROW)
    assert rows(back, "n") == [30.0, 10.0, None, 20.0, 10.0]
    snapshot.save_snapshot(spark, Workbook({"S": Sheet(cells)}, {"K": "$A$1"}), str(tmp_path / "s"))
    again = snapshot.load_snapshot(spark, str(tmp_path / "s"))
    assert again.names == {"K": "$A$1"} and again.sheets["S"].df.count() == 5


def test_versioned_commits(spark, cells, tmp_path):
    store = snapshot.VersionedStore(spark, str(tmp_path / "v"))
    assert store.commit(cells, -1, "a") == "applied"
    assert store.commit(cells, -1, "b") == "conflict"
    assert store.commit(cells, 0, "a") == "duplicate"
    assert store.commit(cells.limit(2), 0, "c") == "applied"
    assert store.load().count() == 2 and store.load(0).count() == 5


def test_operation_log():
    pending, acks = {}, []
    version, out = advance(0, pending, acks, [(2, "b", "y"), (1, "a", "x"), (1, "a", "x"), (1, "z", "q"), (99_999, "f", "far")])
    assert version == 2
    assert [(o[0], o[3]) for o in out] == [(1, "applied"), (2, "applied"), (1, "echo"), (1, "stale"), (99_999, "reload")]
    version, out = advance(2, pending, acks, [(i, f"m{i}", "o") for i in range(4, 6 + MOST_PENDING)])
    assert [o[3] for o in out] == ["reload", "reload"] and len(pending) == MOST_PENDING
    assert rebase_index(5, [("insert", 2, 3), ("remove", 0, 1)]) == 7
    assert rebase_index(5, [("remove", 4, 2)]) is None


def test_documents_beyond_the_gap_buffer_are_completed(spark, tmp_path):
    from tessera.queries import QUERIES

    spark.range(3_000).selectExpr("id as event_id", "if(id < 2900, 1, 2) as user_id", "'click' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["oplog_gap_dedup"](spark, str(tmp_path)).collect()
    want = [("d1", i + 1, f"m{i}", "click") for i in range(2900)] + [("d2", i + 1, f"m{i + 2900}", "click") for i in range(100)]
    assert sorted(tuple(r) for r in got) == sorted(want)
