"""Formula text to a syntax tree.

From loosest to tightest: comparison, &, + and -, * and /, ^ (left to right), the suffix %, and the signs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

MOST_DEPTH = 64


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass(frozen=True)
class Literal:
    value: object  # float, str, bool or None for an omitted argument


@dataclass(frozen=True)
class ErrorLiteral:
    code: str


@dataclass(frozen=True)
class Cell:
    """Zero-based column and row; row 0 is the first data row. The flags tell whether a part is absolute."""

    col: int
    row: int
    col_abs: bool = False
    row_abs: bool = False
    sheet: str | None = None


@dataclass(frozen=True)
class Area:
    first: Cell
    last: Cell


@dataclass(frozen=True)
class Columns:
    """A table's columns: T[Col], T[[A]:[B]], [@Col] (this_row)."""

    table: str | None
    first: str
    last: str
    this_row: bool = False
    part: str = "#Data"


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"]|"")*")|(?P<err>\#(?:CYCLE!|DIV/0!|REF!|NUM!|VALUE!|NAME\?|N/A|SPILL!|CALC!|LOADING!))
    |(?P<sheet>(?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)|(?P<cell>\$?[A-Za-z]{1,3}\$?[1-9]\d*(?![\w(.]))|(?P<name>[A-Za-z_\\][\w.]*)|(?P<bracket>\[)|(?P<op><>|<=|>=|[-+*/^&=<>%():,{}])""",
    re.X,
)


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_cell(text: str, sheet: str | None = None) -> Cell:
    m = re.fullmatch(r"(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d*)", text)
    if not m:
        raise FormulaError(f"not a cell: {text}")
    return Cell(column_index(m[2]), int(m[4]) - 1, bool(m[1]), bool(m[3]), sheet)


def cell_text(c: Cell) -> str:
    return f"{'$' * c.col_abs}{column_letters(c.col)}{'$' * c.row_abs}{c.row + 1}"


def _bracketed(source: str, at: int) -> int:
    """The end of the bracket that opens at `at`."""
    depth = 0
    for i in range(at, len(source)):
        depth += (source[i] == "[") - (source[i] == "]")
        if depth == 0:
            return i + 1
    raise FormulaError("unclosed [")


def tokenize(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected {source[at]!r} at {at}")
        kind, at = m.lastgroup, m.end()
        if kind == "bracket":
            end = _bracketed(source, m.start())
            out.append(("struct", source[m.start() : end]))
            at = end
        elif kind != "space":
            out.append((kind, m[0]))
    return out


_LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if text is not None and got[1] != text:
            raise FormulaError(f"expected {text!r}, found {got[1]!r}")
        self.at += 1
        return got

    def level(self, i: int = 0):
        if i == len(_LEVELS):
            return self.percent()
        left = self.level(i + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[i]:
            op = self.take()[1]
            left = Binary(op, left, self.level(i + 1))
        return left

    def percent(self):
        node = self.sign()
        while self.peek() == ("op", "%"):
            self.take()
            node = Unary("%", node)
        return node

    def sign(self):
        if self.peek() in (("op", "-"), ("op", "+")):
            return Unary(self.take()[1], self.nested(self.sign))
        return self.primary()

    def nested(self, f):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise FormulaError("nested too deeply")
        node = f()
        self.depth -= 1
        return node

    def area(self, first: Cell):
        if self.peek() == ("op", ":"):
            self.take()
            kind, text = self.take()
            if kind != "cell":
                raise FormulaError("expected a cell after ':'")
            last = parse_cell(text, first.sheet)
            return Area(first, last)
        return first

    def primary(self):
        kind, text = self.take()
        if kind == "num":
            return Literal(float(text))
        if kind == "str":
            return Literal(text[1:-1].replace('""', '"'))
        if kind == "err":
            return ErrorLiteral(text)
        if kind == "sheet":
            name = text[:-1]
            name = name[1:-1].replace("''", "'") if name.startswith("'") else name
            kind, text = self.take()
            if kind != "cell":
                raise FormulaError("expected a cell after a sheet name")
            return self.area(parse_cell(text, name))
        if kind == "cell":
            return self.area(parse_cell(text))
        if kind == "struct":
            return structured(None, text)
        if kind == "name":
            if self.peek() == ("op", "("):
                self.take()
                return Call(text.upper(), self.nested(self.arguments))
            if self.peek()[0] == "struct":
                return structured(text, self.take()[1])
            if text.upper() in ("TRUE", "FALSE"):
                return Literal(text.upper() == "TRUE")
            return Name(text)
        if (kind, text) == ("op", "("):
            node = self.nested(self.level)
            self.take(")")
            return node
        raise FormulaError(f"unexpected {text!r}")

    def arguments(self) -> tuple:
        args: list = []
        if self.peek() == ("op", ")"):
            self.take()
            return ()
        while True:
            args.append(Literal(None) if self.peek() in (("op", ","), ("op", ")")) else self.level())
            if self.take()[1] == ")":
                return tuple(args)
            if self.tokens[self.at - 1] != ("op", ","):
                raise FormulaError("expected ',' or ')'")


def structured(table: str | None, text: str) -> Columns:
    inner = text[1:-1].strip()
    if inner.startswith("@"):
        name = inner[1:].strip()
        name = name[1:-1] if name.startswith("[") else name
        return Columns(table, name, name, this_row=True)
    if not inner.startswith("["):
        return Columns(table, "", "", part=inner) if inner.startswith("#") else Columns(table, inner, inner)
    parts = re.findall(r"\[([^\]]*)\]", inner)
    special = [p for p in parts if p.startswith("#")]
    names = [p for p in parts if not p.startswith("#")]
    row = "#This Row" in special
    return Columns(table, names[0] if names else "", names[-1] if names else "", this_row=row, part=next((s for s in special if s != "#This Row"), "#Data"))


def parse(source: str):
    """The tree of a formula, with or without its leading =."""
    p = _Parser(tokenize(source[1:] if source.startswith("=") else source))
    node = p.level()
    if p.peek()[0] != "end":
        raise FormulaError(f"unexpected {p.peek()[1]!r}")
    return expand_let(node)


def substitute(node, names: dict):
    if isinstance(node, Name):
        return names.get(node.name.upper(), node)
    if isinstance(node, Unary):
        return replace(node, arg=substitute(node.arg, names))
    if isinstance(node, Binary):
        return replace(node, left=substitute(node.left, names), right=substitute(node.right, names))
    if isinstance(node, Call):
        return replace(node, args=tuple(substitute(a, names) for a in node.args))
    return node


def expand_let(node):
    """LET by substitution: a binding sees only earlier ones, and an unused one vanishes."""
    if isinstance(node, Call) and node.name == "LET":
        if len(node.args) < 3 or len(node.args) % 2 == 0:
            raise FormulaError("LET takes pairs and a result")
        names: dict = {}
        for key, value in zip(node.args[:-1:2], node.args[1::2]):
            if not isinstance(key, Name):
                raise FormulaError("LET binds names")
            names[key.name.upper()] = expand_let(substitute(value, names))
        return expand_let(substitute(node.args[-1], names))
    if isinstance(node, Unary):
        return replace(node, arg=expand_let(node.arg))
    if isinstance(node, Binary):
        return replace(node, left=expand_let(node.left), right=expand_let(node.right))
    if isinstance(node, Call):
        return replace(node, args=tuple(expand_let(a) for a in node.args))
    return node


def shifted(node, rows: int, cols: int = 0):
    """The tree as it reads after copying its cell by so many rows and columns: relative parts move."""
    if isinstance(node, Cell):
        r, c = node.row + (0 if node.row_abs else rows), node.col + (0 if node.col_abs else cols)
        return replace(node, row=r, col=c) if r >= 0 and c >= 0 else ErrorLiteral("#REF!")
    if isinstance(node, Area):
        a, b = shifted(node.first, rows, cols), shifted(node.last, rows, cols)
        return a if isinstance(a, ErrorLiteral) else b if isinstance(b, ErrorLiteral) else Area(a, b)
    return _mapped(node, lambda x: shifted(x, rows, cols))


def _mapped(node, f):
    if isinstance(node, Unary):
        return replace(node, arg=f(node.arg))
    if isinstance(node, Binary):
        return replace(node, left=f(node.left), right=f(node.right))
    if isinstance(node, Call):
        return replace(node, args=tuple(f(a) for a in node.args))
    return node


def after_row_edit(node, at: int, count: int):
    """References after `count` rows are inserted before row `at` (negative: removed from it on)."""
    if isinstance(node, Cell):
        if count >= 0:
            return replace(node, row=node.row + count) if node.row >= at else node
        gone = at - count
        return node if node.row < at else ErrorLiteral("#REF!") if node.row < gone else replace(node, row=node.row + count)
    if isinstance(node, Area):
        lo, hi = node.first.row, node.last.row
        if count >= 0:
            return Area(after_row_edit(node.first, at, count), after_row_edit(node.last, at, count))
        gone = at - count
        if lo >= at and hi < gone:
            return ErrorLiteral("#REF!")
        lo = lo if lo < at else at if lo < gone else lo + count
        hi = hi if hi < at else at - 1 if hi < gone else hi + count
        return Area(replace(node.first, row=lo), replace(node.last, row=hi))
    return _mapped(node, lambda x: after_row_edit(x, at, count))


def after_sheet_edit(node, old: str, new: str | None):
    """References to a sheet after it is renamed, or removed (new is None)."""
    if isinstance(node, Cell):
        named = node.sheet is not None and node.sheet.upper() == old.upper()
        return node if not named else ErrorLiteral("#REF!") if new is None else replace(node, sheet=new)
    if isinstance(node, Area):
        first = after_sheet_edit(node.first, old, new)
        return first if isinstance(first, ErrorLiteral) else replace(node, first=first)
    return _mapped(node, lambda x: after_sheet_edit(x, old, new))


def to_source(node) -> str:
    """Formula text of a tree, with parentheses around every operation inside another."""
    def inner(x):
        return f"({to_source(x)})" if isinstance(x, (Binary, Unary)) else to_source(x)

    if isinstance(node, Literal):
        v = node.value
        return "" if v is None else str(v).upper() if isinstance(v, bool) else '"' + v.replace('"', '""') + '"' if isinstance(v, str) else repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(node, ErrorLiteral):
        return node.code
    if isinstance(node, Cell):
        return (f"'{node.sheet}'!" if node.sheet else "") + cell_text(node)
    if isinstance(node, Area):
        return to_source(node.first) + ":" + cell_text(node.last)
    if isinstance(node, Columns):
        if node.this_row:
            return f"{node.table or ''}[@[{node.first}]]"
        return f"{node.table or ''}[[{node.first}]:[{node.last}]]" if node.first != node.last else f"{node.table or ''}[{node.first or node.part}]"
    if isinstance(node, Name):
        return node.name
    if isinstance(node, Unary):
        return inner(node.arg) + "%" if node.op == "%" else node.op + inner(node.arg)
    if isinstance(node, Binary):
        return inner(node.left) + node.op + inner(node.right)
    return f"{node.name}({','.join(to_source(a) for a in node.args)})"
