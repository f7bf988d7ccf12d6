import math

import pytest
from pyspark.sql import functions as F

from tessera.operators.sheet import Sheet, Workbook
from tessera.plans.rows import ROW
from tessera.shipping import ready_for_python

GOLDEN = {
    "=SUM(A1:A4)": 10, "=AVERAGE(A1:A4)": 2.5, '=COUNTIF($A$1:$A$4,">2")': 2, "=ROUND(PI(),3)": 3.142, '=IFERROR(1/0,"fallback")': "fallback", "=-2^2": 4, "=2^-2": 0.25, "=2^3^2": 64, "=50%": 0.5, "=200*10%": 20, '="A"&1+2': "A3",
    "=ROUND(1.005,2)": 1.0, "=MOD(7,-3)": -2, "=DATE(1900,3,1)": 61, "=TEXT(60,\"yyyy-mm-dd\")": None, "=EVEN(-1.5)": -2, "=ODD(0)": 1, "=QUOTIENT(-7,2)": -3, "=FLOOR(7.5,2)": 6, "=CEILING(7.5,2)": 8, "=MROUND(7,2)": 8, "=TRUNC(-2.7)": -2,
    '=SUBSTITUTE("a.b.c",".","-",2)': "a.b-c", '=SEARCH("b?d","aabcdBxd")': 3, '=SEARCH("c*","abcd")': 3, '=FIND("","abc",2)': 2, '=REPLACE("abcdef",2,3,"#")': "a#ef", '=PROPER("o\'neil mc-x")': "O'Neil Mc-X", '=TEXTJOIN(",",TRUE,"a","",3)': "a,3", '=NUMBERVALUE("1.234,5%",",",".")': 12.345, '=UNICHAR(128512)': "😀",
    '=LEN("😀é")': 2, "=ADDRESS(2,28)": "$AB$2", '=DATEVALUE("13/2/2024")': 45335, '=TIMEVALUE("1:05 pm")': 47100 / 86400, "=WEEKNUM(45292,21)": 1, "=NETWORKDAYS(45292,45322)": 23, "=WORKDAY(45292,10)": 45306, "=WEEKDAY(1)": 1, "=DAYS360(45351,45382)": 30, "=EOMONTH(45292,1)": 45351, "=YEARFRAC(45500,45000,0)": None,
    "=IF(FALSE,1)": 0, "=SWITCH(2,1,\"a\",2,\"b\")": "b", "=XOR(TRUE,TRUE)": False, "=1=1": True, '="a"="A"': True, '=1<"a"': True, "=TYPE(1/0)": 16, "=LET(x,2,x*x)": 4, "=MEDIAN(1,3,2)": 2, "=GEOMEAN(4,9)": 6, "=VAR.S(1,2,3,4)": 5 / 3, "=1E21&\"\"": "1000000000000000000000", '=0.000015&""': "0.000015",
}
ERRORS = {"=1/0": "#DIV/0!", "=0^-1": "#DIV/0!", "=SQRT(-1)": "#NUM!", '=VALUE("x")': "#VALUE!", "=NOSUCH(1)": "#NAME?", "=NA()+1": "#N/A", "=IFS(FALSE,1)": "#N/A", '=FIND("z","abc")': "#VALUE!", "=LOG(5,1)": "#NUM!", "=MOD(1,0)": "#DIV/0!", '="x"+1': "#VALUE!", "=1+": "#NAME?", "=A1:B2": None, '=DATEVALUE("2023-02-29")': "#VALUE!", "=IPMT(0.1,9,3,100)": "#NUM!", "=MROUND(5,-2)": "#NUM!", "=CHAR(0)": "#VALUE!"}


@pytest.fixture(scope="module")
def book(spark):
    ready_for_python(spark)
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "_row long, n double")
    return Workbook({"S": Sheet(df)})


def one(book, formula):
    df = book.with_formula("S", "r", formula).sheets["S"].df.where(F.col(ROW) == 0)
    row = df.first()
    return row["r"], row["r_err"] if "r_err" in df.columns else None


def test_golden_values(book):
    wrong = {}
    for f, want in GOLDEN.items():
        if want is None:
            continue
        got, err = one(book, f)
        same = math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12) if isinstance(want, (int, float)) and not isinstance(want, bool) and isinstance(got, float) else got == want
        if err is not None or not same:
            wrong[f] = (got, err, want)
    assert not wrong


def test_error_values(book):
    wrong = {f: one(book, f) for f, e in ERRORS.items() if e is not None and one(book, f)[1] != e}
    assert not wrong


def test_cycle_and_dependency_order(book):
    made = book.with_formulas("S", {"c": "=[@b]+1", "b": "=[@n]*2"}).sheets["S"].df
    assert [r.c for r in made.orderBy(ROW).collect()] == [3, 5, 7, 9]
    made = book.with_formulas("S", {"x": "=[@y]", "y": "=[@x]"}).sheets["S"].df
    assert {r.x_err for r in made.collect()} == {"#CYCLE!"}


def test_annuities_invert(book):
    got, _ = one(book, "=PV(0.01,24,PMT(0.01,24,1000))")
    assert math.isclose(got, 1000, rel_tol=1e-9)
    assert math.isclose(one(book, "=IPMT(0.01,3,24,1000)+PPMT(0.01,3,24,1000)")[0], one(book, "=PMT(0.01,24,1000)")[0], rel_tol=1e-12)
    assert math.isclose(one(book, "=RATE(24,PMT(0.01,24,1000),1000)")[0], 0.01, rel_tol=1e-6)


def test_filled_down_references(book):
    df = book.with_formulas("S", {"next": "=A2", "run": "=SUM($A$1:A1)", "slide": "=SUM(A1:A2)", "share": "=A1/SUM(S[n])"}).sheets["S"].df.orderBy(ROW)
    rows = df.collect()
    assert [r["next"] for r in rows] == [2, 3, 4, None]
    assert [r.run for r in rows] == [1, 3, 6, 10]
    assert [r.slide for r in rows] == [3, 5, 7, 4]
    assert [r.share for r in rows] == [0.1, 0.2, 0.3, 0.4]


def test_named_ranges_prefer_the_sheet(spark, book):
    b = Workbook(book.sheets, {"K": "S!$A$2"}, {("S", "K"): "S!$A$3"})
    assert one(b, "=K*10")[0] == 30
