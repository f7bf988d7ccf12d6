"""Structural edits of a workbook, and undo and redo.

Workbooks are values over lazy plans, so an edit makes a new one, and a history only keeps the earlier ones: no data
is copied, and undoing reads what the earlier plan reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..plans import formula as tree
from ..plans.rows import ROW
from .sheet import Block, Sheet, Workbook

#: Fixed value: entries that a history holds.
MOST_ENTRIES = 200


def _key(book: Workbook, sheet: str) -> str:
    for name in book.sheets:
        if name.upper() == sheet.upper():
            return name
    raise KeyError(sheet)


def add_sheet(book: Workbook, name: str, sheet: Sheet) -> Workbook:
    if name.upper() in map(str.upper, book.sheets):
        raise ValueError(f"there is a sheet {name} already")
    return replace(book, sheets={**book.sheets, name: sheet})


def rename_sheet(book: Workbook, old: str, new: str) -> Workbook:
    """Names that refer to the sheet follow it; the order of sheets stays."""
    own = _key(book, old)
    if new.upper() != own.upper() and new.upper() in map(str.upper, book.sheets):
        raise ValueError(f"there is a sheet {new} already")
    sheets = {new if n == own else n: s for n, s in book.sheets.items()}
    return _renamed(replace(book, sheets=sheets), own, new)


def remove_sheet(book: Workbook, name: str) -> Workbook:
    """Names that refer to the sheet become #REF!; its own names go."""
    own = _key(book, name)
    return _renamed(replace(book, sheets={n: s for n, s in book.sheets.items() if n != own}), own, None)


def move_sheet(book: Workbook, name: str, to: int) -> Workbook:
    own = _key(book, name)
    order = [n for n in book.sheets if n != own]
    order.insert(to, own)
    return replace(book, sheets={n: book.sheets[n] for n in order})


def _renamed(book: Workbook, old: str, new: str | None) -> Workbook:
    moved = lambda source: tree.to_source(tree.after_sheet_edit(tree.parse(source), old, new))
    scoped = {(new if s.upper() == old.upper() else s, n): moved(x) for (s, n), x in book.sheet_names.items() if new is not None or s.upper() != old.upper()}
    return replace(book, names={n: moved(x) for n, x in book.names.items()}, sheet_names=scoped)


def add_column(sheet: Sheet, name: str, kind: str, at: int | None = None) -> Sheet:
    """An empty column, last or at a position."""
    if name.upper() in map(str.upper, sheet.columns):
        raise ValueError(f"there is a column {name} already")
    columns = list(sheet.columns)
    columns.insert(len(columns) if at is None else at, name)
    return Sheet(sheet.df.withColumn(name, F.lit(None).cast(kind)), columns)


def remove_columns(sheet: Sheet, *names: str) -> Sheet:
    gone = {n.upper() for n in names}
    return Sheet(sheet.df.drop(*[c for c in sheet.columns if c.upper() in gone]), [c for c in sheet.columns if c.upper() not in gone])


def set_name(book: Workbook, name: str, source: str, sheet: str | None = None) -> Workbook:
    """A named range or formula: workbook-wide, or of one sheet. Names ignore case and are held in capitals."""
    tree.parse(source)
    if sheet is None:
        return replace(book, names={**book.names, name.upper(): source})
    return replace(book, sheet_names={**book.sheet_names, (_key(book, sheet), name.upper()): source})


def remove_name(book: Workbook, name: str, sheet: str | None = None) -> Workbook:
    if sheet is None:
        return replace(book, names={n: x for n, x in book.names.items() if n != name.upper()})
    return replace(book, sheet_names={k: x for k, x in book.sheet_names.items() if k != (_key(book, sheet), name.upper())})


def _taken(book: Workbook, name: str, but: str | None = None) -> bool:
    low = name.upper()
    return any(n.upper() == low for n in [*book.sheets, *book.names] if but is None or n.upper() != but.upper())


def _cells_of(book: Workbook, b: Block) -> Sheet:
    df = book.sheets[b.sheet].df.where(F.col(ROW).between(b.first, b.last))
    cells = [F.col(f"`{c}{end}`").alias(f"{h}{end}") for c, h in zip(b.columns, b.headers) for end in ("", "_err") if f"{c}{end}" in df.columns]
    return Sheet(df.select((F.col(ROW) - b.first).alias(ROW), *cells), list(b.headers))


def _checked(book: Workbook, b: Block, but: str | None = None) -> Block:
    sheet = book.sheets[b.sheet]
    if not b.columns or any(c not in sheet.columns for c in b.columns) or not 0 <= b.first <= b.last:
        raise ValueError("a table covers columns of its sheet and at least one row")
    if len({h.upper() for h in b.headers}) != len(b.headers) or len(b.headers) != len(b.columns):
        raise ValueError("a table has one header for each column, all different")
    for name, other in book.tables.items():
        if name != but and other.sheet == b.sheet and set(other.columns) & set(b.columns) and other.first <= b.last and b.first <= other.last:
            raise ValueError(f"table {name} lies there already")
    return b


def add_table(book: Workbook, name: str, sheet: str, columns: tuple[str, ...], first: int, last: int, headers: tuple[str, ...] | None = None) -> Workbook:
    """A table over a block of a sheet: T[Header] in formulas. Names are unique among sheets, names and tables."""
    if _taken(book, name):
        raise ValueError(f"the name {name} is taken")
    b = _checked(book, Block(_key(book, sheet), tuple(columns), tuple(headers or columns), first, last))
    return replace(book, sheets={**book.sheets, name: _cells_of(book, b)}, tables={**book.tables, name: b})


def update_table(book: Workbook, name: str, new_name: str | None = None, **changes) -> Workbook:
    """Another name, place or other headers (columns, headers, first, last)."""
    to = new_name or name
    if _taken(book, to, but=name):
        raise ValueError(f"the name {to} is taken")
    b = _checked(book, replace(book.tables[name], **changes), but=name)
    sheets = {to if n == name else n: _cells_of(book, b) if n == name else s for n, s in book.sheets.items()}
    return replace(book, sheets=sheets, tables={to if n == name else n: b if n == name else t for n, t in book.tables.items()})


def remove_table(book: Workbook, name: str) -> Workbook:
    """The cells stay in their sheet."""
    return replace(book, sheets={n: s for n, s in book.sheets.items() if n != name}, tables={n: t for n, t in book.tables.items() if n != name})


@dataclass(frozen=True)
class History:
    """A workbook with what undo and redo lead to; a new edit forgets what was undone."""

    book: Workbook
    past: tuple[Workbook, ...] = ()
    future: tuple[Workbook, ...] = ()

    def apply(self, edit: Callable[..., Workbook], *args) -> History:
        return History(edit(self.book, *args), (*self.past, self.book)[-MOST_ENTRIES:])

    def undo(self) -> History:
        return History(self.past[-1], self.past[:-1], (self.book, *self.future)) if self.past else self

    def redo(self) -> History:
        return History(self.future[0], (*self.past, self.book)[-MOST_ENTRIES:], self.future[1:]) if self.future else self
