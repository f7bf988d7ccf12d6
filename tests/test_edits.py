"""Structural edits of workbooks, undo and redo."""

import pytest

from tessera.operators import edits
from tessera.operators.edits import History
from tessera.operators.sheet import Sheet, Workbook
from tessera.sources.paged import from_columns


@pytest.fixture
def book(spark):
    one, two = from_columns(spark, {"n": [1.0, 2.0, 3.0]}), from_columns(spark, {"m": [10.0, 20.0, 30.0]})
    return Workbook({"One": Sheet(one, ["n"]), "Two": Sheet(two, ["m"])}, {"TOPS": "One!$A$1:$A$2"}, {("Two", "OWN"): "One!$A$1"})


def total(book, source):
    made = book.with_formula("Two", "f", source).sheets["Two"].df
    return [(r["f"], r["f_err"] if "f_err" in made.columns else None) for r in made.orderBy("_row").collect()][0]


def test_names_follow_a_renamed_sheet(book):
    after = edits.rename_sheet(book, "one", "First")
    assert list(after.sheets) == ["First", "Two"]
    assert after.names["TOPS"].replace("'", "") == "First!$A$1:$A$2"
    assert total(after, "=SUM(Tops)")[0] == 3.0 == total(book, "=SUM(Tops)")[0]


def test_names_of_a_removed_sheet(book):
    after = edits.remove_sheet(book, "One")
    assert list(after.sheets) == ["Two"] and after.names == {"TOPS": "#REF!"} and after.sheet_names == {("Two", "OWN"): "#REF!"}
    assert edits.remove_sheet(book, "Two").sheet_names == {}


def test_sheets_move_and_clash(book):
    assert list(edits.move_sheet(book, "Two", 0).sheets) == ["Two", "One"]
    with pytest.raises(ValueError):
        edits.rename_sheet(book, "One", "two")
    with pytest.raises(ValueError):
        edits.add_sheet(book, "ONE", book.sheets["One"])


def test_columns(book):
    wide = edits.add_column(book.sheets["One"], "t", "string", 0)
    assert wide.columns == ["t", "n"] and wide.df.select("t").distinct().collect()[0][0] is None
    assert edits.remove_columns(wide, "N").columns == ["t"]
    with pytest.raises(ValueError):
        edits.add_column(wide, "T", "double")


def test_undo_and_redo(book):
    h = History(book).apply(edits.set_name, "All", "One!$A$1:$A$3").apply(edits.remove_name, "Tops")
    assert set(h.book.names) == {"ALL"}
    back = h.undo()
    assert set(back.book.names) == {"ALL", "TOPS"} and set(back.redo().book.names) == {"ALL"}
    assert back.undo().undo().book is book
    assert back.apply(edits.remove_name, "All").redo().book.names == {"TOPS": "One!$A$1:$A$2"}
