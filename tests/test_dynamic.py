"""Array formulas, lookups and criteria from cells, running ranges, and WORKDAY without limits."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import edits, statistics, view
from tessera.operators.sheet import Sheet, Workbook
from tessera.plans.rows import ROW


@pytest.fixture(scope="module")
def book(spark):
    rows = [(3.0, "T", "a*", 1.0, 0.5), (1.0, "T", "ab", 2.0, 0.0), (3.0, "F", ">1", 3.0, 1.0), (2.0, "T", "x", 1.0, 0.25), (4.0, "F", "b", 9.0, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long, A double, B string, C string, D double, E double")
    return Workbook({"S": Sheet(df)})


def column(book, formula, base=0):
    """The formula's values by row: an error code where there is one; tuples for several columns."""
    s = book.with_formula("S", "o", formula, base).sheets["S"]
    names = [c for c in s.columns if c == "o" or c.startswith("o_")]
    cell = lambda r, c: r[c + "_err"] if c + "_err" in s.df.columns and r[c + "_err"] is not None else r[c]
    rows = [tuple(cell(r, c) for c in names) for r in s.df.orderBy(ROW).collect()]
    return [r[0] for r in rows] if len(names) == 1 else rows


SPILLS = {
    '=FILTER(A1:A5,B1:B5="T")': [3, 1, 2, None, None],
    '=FILTER(A1:B5,(A1:A5>1)*(B1:B5="T"))': [(3, "T"), (2, "T"), (None, None), (None, None), (None, None)],
    '=FILTER(A1:A5,A1:A5>9,"none")': ["none", None, None, None, None],
    "=FILTER(A1:A5,A1:A5>9)": ["#CALC!", None, None, None, None],
    "=SORT(A1:A5)": [1, 2, 3, 3, 4],
    "=UNIQUE(A1:A5)": [3, 1, 2, 4, None],
    "=TAKE(SORT(UNIQUE(A1:A5)),-2)": [3, 4, None, None, None],
    "=DROP(A1:C5,3,1)": [("T", "x"), ("F", "b"), (None, None), (None, None), (None, None)],
    "=SEQUENCE(3,2)": [(1, 2), (3, 4), (5, 6), (None, None), (None, None)],
    "=SEQUENCE(7)": [1, 2, 3, 4, 5, 6, 7],
    "=TRANSPOSE(A1:A3)": [(3, 1, 3), *[(None, None, None)] * 4],
    "=CHOOSECOLS(A1:C5,3,-2)": [("a*", "T"), ("ab", "T"), (">1", "F"), ("x", "T"), ("b", "F")],
    "=CHOOSEROWS(A1:A5,2,-1)": [1, 4, None, None, None],
    "=A1:B2": [(3, "T"), (1, "T"), (None, None), (None, None), (None, None)],
    "=TAKE(A1:A5,0)": ["#CALC!", None, None, None, None],
    "=SORT(A1:A5,3)": ["#VALUE!", None, None, None, None],
}
ALIKE = {
    '=SUM(FILTER(A1:A5,B1:B5="T"))': 6, "=COUNTA(UNIQUE(B1:B5))": 2, "=ROWS(FILTER(A1:A5,A1:A5>2))": 3, "=INDEX(SORT(A1:A5),2)": 2, "=MEDIAN(FILTER(A1:A5,A1:A5>1))": 3, "=MAX(SEQUENCE(4))+1": 5, "=COLUMNS(TRANSPOSE(A1:A4))": 4, "=SUM(FILTER(A1:A5,A1:A5>9))": "#CALC!",
    '=COUNTIF($C$1:$C$5,"a*"&"")': 2, '=COUNTIF($A$1:$A$5,">"&2)': 3, "=SMALL($A$1:$A$5,1+1)": 2, "=MEDIAN($A$1:$A$5)": 3, "=GCD($A$1:$A$5)": 1, "=LCM($A$1:$A$5)": 12, '=XLOOKUP("aa",$C$1:$C$5,$A$1:$A$5,0,-1)': 3, '=HLOOKUP("T",$A$1:$E$5,4,FALSE)': "T", "=HLOOKUP(9,$A$1:$E$5,2,FALSE)": "#N/A", "=HLOOKUP(3,$A$1:$E$5,6,FALSE)": "#REF!", "=MATCH(2.5,$D$1:$D$3,1)": 2, "=MATCH(2.5,$D$1:$D$5,1)": "#N/A", "=COUNTIF($A$1:$A$5,$C$3)": 4,
}
BY_ROW = {
    "=COUNTIF($C$1:$C$5,C1)": [2, 1, 0, 1, 1], "=COUNTIF($A$1:$A$5,C1)": [0, 0, 4, 0, 0], "=LARGE($A$1:$A$5,D1)": [4, 3, 3, 4, "#NUM!"], "=PERCENTILE.INC($A$1:$A$5,E1)": [3, 1, 4, 2, "#NUM!"], "=QUARTILE.INC($A$1:$A$5,D1)": [2, 3, 3, 2, "#NUM!"], "=XLOOKUP(C1,$C$1:$C$5,$A$1:$A$5,-1,2)": [3, 1, 3, 2, 4],
    "=MAX($A$1:A1)": [3, 3, 3, 3, 4], "=MIN($A$1:A1)": [3, 1, 1, 1, 1], "=SUM($A$2:A1)": [4, 1, 4, 6, 10], "=SUM($A$2:A2)": [1, 4, 6, 10, 10], "=COUNTIF($A$1:A1,A1)": [1, 1, 2, 1, 1], "=COUNTIF($A$1:A1,D1)": [0, 0, 2, 1, 0], '=COUNTIF($A$1:A1,">1")': [1, 1, 2, 3, 4], "=SUMIF($B$1:B1,B1,$A$1:A1)": [3, 4, 3, 6, 7],
}


@pytest.mark.parametrize("formula", SPILLS)
def test_arrays_spill(book, formula):
    assert column(book, formula) == SPILLS[formula]


def test_arrays_spill_from_their_own_row(book):
    assert column(book, "=SORT($A$1:$A$2)", base=3) == [None, None, None, 1, 3]


def test_single_values(book):
    wrong = {f: column(book, f) for f, want in ALIKE.items() if column(book, f) != [want] * 5}
    assert not wrong


def test_values_by_row(book):
    wrong = {f: got for f, want in BY_ROW.items() if (got := column(book, f)) != want}
    assert not wrong


def test_workdays_of_any_distance(spark):
    base = datetime.date(1899, 12, 30)
    day = lambda s: np.datetime64(base + datetime.timedelta(days=s))
    rng, rows = np.random.default_rng(4), []
    for i in range(200):
        n = int(rng.integers(-60, 60)) if i % 2 else int(rng.integers(-200_000, 200_000))
        rows.append((i, float(rng.integers(300_000, 301_000)), float(n), *[float(x) for x in rng.integers(299_950, 301_050, 3)]))
    rows.append((200, 45292.0, 1_000_000.0, 1.0, 2.0, 3.0))
    df = spark.createDataFrame(rows, "_row long, A double, B double, C double, D double, E double")
    made = Workbook({"S": Sheet(df)}).with_formula("S", "x", "=WORKDAY(A1,B1,C1:E1)").with_formula("S", "y", "=WORKDAY(A1,B1)").sheets["S"].df.orderBy(ROW).collect()
    for r in made:
        roll = "backward" if r.B > 0 else "forward"
        for got, free in ((r.x, [day(int(h)) for h in (r.C, r.D, r.E)]), (r.y, [])):
            want = r.A if r.B == 0 else float((np.busday_offset(day(int(r.A)), int(r.B), roll=roll, holidays=free) - np.datetime64(base)).astype(int))
            assert got == want, r


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.integers(1, 60, 500)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in x], "v double").repartition(5)
    clean = [v for v in x if v is not None]
    row = statistics.quantiles(df, F.col("v"), [0, 0.1, 0.5, 0.77, 1]).first()
    assert row.n == 500 and np.allclose(row[1:], np.quantile(clean, [0, 0.1, 0.5, 0.77, 1]))
    assert statistics.divisor(df, F.col("v") * 6, False).first().value == 6 * np.gcd.reduce([int(v) for v in clean])
    import math

    assert statistics.divisor(df, F.col("v"), True).first().value == float(math.lcm(*[int(v) for v in clean]))
    empty = statistics.quantiles(df.limit(0), F.col("v"), [0.5]).first()
    assert empty.n == 0 and empty.q0 is None
    assert statistics.divisor(df, -F.col("v"), False).first().bad


def test_tables_over_blocks(book):
    b = edits.add_table(book, "T", "S", ("A", "B"), 1, 3, ("Amount", "Kind"))
    assert column(b, "=SUM(T[Amount])") == [6] * 5
    assert column(edits.update_table(b, "T", "U", first=0, headers=("X", "Kind")), "=SUM(U[X])") == [9] * 5
    assert column(edits.remove_table(b, "T"), "=SUM(T[Amount])") == ["#NAME?"] * 5
    for bad in (("t", "S", ("A",), 0, 1), ("V", "S", ("A",), 3, 4), ("V", "S", ("nope",), 0, 1), ("S", "S", ("E",), 0, 1)):
        with pytest.raises(ValueError):
            edits.add_table(b, *bad)
    assert set(edits.add_table(b, "V", "S", ("A",), 4, 4).tables) == {"T", "V"}


def test_protected_ranges(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 5, 9, 1, 1), (3, 2, 5, 3, 4), (4, 6, 6, 2, 8)], "op int, first_row int, last_row int, first_col int, last_col int")
    ranges = [view.ProtectedRange("head", 0, 0, 0, 9), view.ProtectedRange("sum", 5, 6, 2, 3)]
    kept, refused = view.protected(df, ranges)
    assert sorted(r.op for r in kept.collect()) == [2] and {r.op: r.denied for r in refused.collect()} == {1: ["head"], 3: ["sum"], 4: ["sum"]}
    assert sorted(r.op for r in view.protected(df, ranges, ("sum",))[0].collect()) == [2, 3, 4]
    assert view.protected(df, ranges, mode="atomic")[0].count() == 0 and view.protected(df, [], mode="atomic")[0].count() == 4


def test_workbooks_round_trip(spark, book, tmp_path):
    from tessera.sources import xlsx

    other = spark.createDataFrame([(0, 1.0, "x", "y"), (1, None, "<&>", None)], "_row long, a double, b string, `odd name` string")
    path = str(tmp_path / "w.xlsx")
    xlsx.write_workbook({"Zeta": other, "S": book.sheets["S"].df}, path, {"Total": "S!$A$1:$A$5"})
    sheets, names = xlsx.read_workbook(spark, path)
    assert list(sheets) == ["Zeta", "S"] and names == {"Total": "S!$A$1:$A$5"}
    rows = lambda df: [tuple(r) for r in df.orderBy(ROW).select(*[f"`{c}`" for c in df.columns if c != ROW]).collect()]
    assert rows(sheets["Zeta"]) == rows(other) and rows(sheets["S"]) == rows(book.sheets["S"].df)
    assert rows(xlsx.read_xlsx(spark, path)) == rows(other)


def test_replaced_numbers_are_read_again(spark):
    df = spark.createDataFrame([(0, 110.5), (1, 12.0), (2, None), (3, 1.0)], "_row long, n double")
    got = [r.n for r in view.replace_text(df, "n", "1", "2").orderBy(ROW).collect()]
    assert got == [220.5, 22, None, 2]
    assert [r.n for r in view.replace_text(df, "n", "1", "x").orderBy(ROW).collect()] == [110.5, 12, None, 1]


def test_fill_series_goes_by_the_largest_value(spark):
    df = spark.range(4).select(F.col("id").alias(ROW))
    big = [1e9, 1e9 + 1, 1e9 + 2.5]
    assert [r.v for r in df.select(view.fill_series(big, 4, df).alias("v")).collect()] == [1e9, 1e9 + 1, 1e9 + 2, 1e9 + 3]
    assert [r.v for r in df.select(view.fill_series([1.0, 2.0, 4.0], 4, df).alias("v")).collect()] == [1, 2, 4, 1]
