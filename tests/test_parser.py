import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.plans.formula import Area, Binary, Call, Cell, Columns, ErrorLiteral, FormulaError, Literal, Name, Unary, after_row_edit, column_index, column_letters, parse, shifted, to_source


def test_signs_bind_tighter_than_powers():
    assert parse("=-2^2") == Binary("^", Unary("-", Literal(2.0)), Literal(2.0))
    assert parse("=2^3^2") == Binary("^", Binary("^", Literal(2.0), Literal(3.0)), Literal(2.0))
    assert parse("=200*10%") == Binary("*", Literal(200.0), Unary("%", Literal(10.0)))


def test_references():
    assert parse("=$A1") == Cell(0, 0, True, False)
    assert parse("='My Sheet'!B$2:C3") == Area(Cell(1, 1, False, True, "My Sheet"), Cell(2, 2, False, False, "My Sheet"))
    assert parse("=T[[a]:[b]]") == Columns("T", "a", "b")
    assert parse("=[@x]") == Columns(None, "x", "x", True)
    assert parse("=#N/A") == ErrorLiteral("#N/A")
    assert parse('="a""b"') == Literal('a"b')


@pytest.mark.parametrize("bad", ["=1+", "=(1", "=SUM(1,", "=1 2", "=[a", "=LET(1,2,3)"])
def test_bad_formulas(bad):
    with pytest.raises(FormulaError):
        parse(bad)


def test_let_substitutes_earlier_bindings_only():
    assert parse("=LET(x,1,y,x+1,y*x)") == Binary("*", Binary("+", Literal(1.0), Literal(1.0)), Literal(1.0))


def test_filling_down_and_row_edits():
    assert to_source(shifted(parse("=A1+$A$1"), 2)) == "A3+$A$1"
    assert to_source(after_row_edit(parse("=SUM(A1:A9)+A5"), 4, 2)) == "SUM(A1:A11)+A7"
    assert to_source(after_row_edit(parse("=A5+A1:A9"), 4, -1)) == "#REF!+A1:A8"


@given(st.integers(0, 20_000))
def test_column_letters_round_trip(i):
    assert column_index(column_letters(i)) == i


def trees():
    leaves = st.one_of(st.floats(0, 1e6).map(lambda x: Literal(round(x, 3))), st.text("ab\" ", max_size=4).map(Literal), st.builds(Cell, st.integers(0, 700), st.integers(0, 999), st.booleans(), st.booleans()), st.sampled_from([Literal(True), Name("rate"), ErrorLiteral("#DIV/0!")]))
    return st.recursive(leaves, lambda t: st.one_of(st.builds(Binary, st.sampled_from(["+", "-", "*", "/", "^", "&", "=", "<>", "<="]), t, t), st.builds(Unary, st.sampled_from(["-", "%"]), t), st.builds(lambda a, b: Call("SUM", (a, b)), t, t)), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(trees())
def test_source_round_trip(tree):
    assert parse("=" + to_source(tree)) == tree
