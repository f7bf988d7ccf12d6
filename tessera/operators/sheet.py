"""Sheets, workbooks and the formula compiler: a formula filled down a column becomes a DataFrame plan.

What a formula reads decides how it is lifted:

* cells of its own row: plain column expressions;
* cells of another row at a fixed distance, and sliding ranges: windows over buckets of neighbouring rows;
* ranges anchored at the top that grow with the row: running totals;
* fixed cells and ranges: aggregates, all of one sheet in a single pass, joined as one row;
* lookups and criteria on a cell of the row: one join against the grouped table;
* array functions: grids that spill over rows or feed an aggregate (`spill`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry, values
from ..functions.dates import serial_of
from ..functions.values import NA, NAME, REF, VALUE, Val, arithmetic, blank, compare, concat, constant, error, first_error, to_num
from ..plans import formula as tree
from ..plans.rows import ROW, neighbourhood, number_rows, running
from . import aggregates as agg
from . import lookups, statistics
from .criteria import SPECIAL, criterion_key, join_key, matches, parse_criterion
from .spill import ArrayError, Arrays, is_array

registry.load()
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
RANGE_FUNCTIONS = {*agg.NUMERIC, "COUNTA", "COUNTBLANK", "AND", "OR", "XOR"}
CONDITIONAL = {"COUNTIF", "COUNTIFS", "SUMIF", "SUMIFS", "AVERAGEIF", "AVERAGEIFS", "MAXIFS", "MINIFS"}


def cell_val(df: DataFrame, col: str, dtype: str | None = None) -> Val:
    """A typed column as a formula value; dates become serials; a column `<col>_err` carries its errors."""
    dtype, c = dtype or dict(df.dtypes)[col], F.col(f"`{col}`")
    err = F.col(f"`{col}_err`") if f"{col}_err" in df.columns else None
    if dtype == "string":
        return Val("text", c, err)
    if dtype == "boolean":
        return Val("bool", c, err)
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return Val("num", serial_of(c), err)
    return Val("num", c.cast("double"), err)


@dataclass
class Sheet:
    """A DataFrame with dense positions in _row and an order of columns."""

    df: DataFrame
    columns: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.columns = self.columns or [c for c in self.df.columns if c != ROW and not c.endswith("_err")]

    @classmethod
    def of(cls, df: DataFrame, *keys: str) -> Sheet:
        """Rows in the order of the keys, which should be unique together."""
        return cls(number_rows(df, *keys), list(df.columns))

    def window(self, first: int, count: int, columns: list[str] | None = None) -> DataFrame:
        """Rows first..first+count-1 of some columns."""
        return self.df.where(F.col(ROW).between(first, first + count - 1)).select(ROW, *(columns or self.columns)).orderBy(ROW)

    def cell(self, row: int, column: str) -> DataFrame:
        return self.df.where(F.col(ROW) == row).select(column)


@dataclass(frozen=True)
class Block:
    """A table's place: rows first..last of some columns of a sheet, under headers of its own."""

    sheet: str
    columns: tuple[str, ...]
    headers: tuple[str, ...]
    first: int
    last: int


@dataclass
class Workbook:
    """Sheets and tables by name, and named ranges: workbook-wide or of one sheet (which come first)."""

    sheets: dict[str, Sheet]
    names: dict[str, str] = field(default_factory=dict)
    sheet_names: dict[tuple[str, str], str] = field(default_factory=dict)
    #: Where the tables lie that are blocks of a sheet; their cells are among the sheets.
    tables: dict[str, Block] = field(default_factory=dict)

    def with_formula(self, sheet: str, name: str, source: str, base_row: int = 0) -> Workbook:
        """The workbook with a derived column: the formula as it reads in row base_row, filled over all rows."""
        made = compile_formula(self, sheet, name, source, base_row)
        return replace(self, sheets={**self.sheets, sheet: made})

    def with_formulas(self, sheet: str, formulas: dict[str, str], base_row: int = 0) -> Workbook:
        """Several derived columns that may read each other: in dependency order; a cycle gives #CYCLE!."""
        needs = {n: {d.upper() for d in _reads(tree.parse(f))} for n, f in formulas.items()}
        done: set[str] = set()
        book, left = self, dict(formulas)
        while left:
            ready = [n for n in left if not (needs[n] & {m.upper() for m in left if m != n}) and n.upper() not in needs[n]]
            if not ready:
                s = book.sheets[sheet]
                df = s.df
                for n in left:
                    df = df.withColumn(n, F.lit(None).cast("double")).withColumn(f"{n}_err", F.lit(values.CYCLE))
                return replace(book, sheets={**book.sheets, sheet: Sheet(df, [*s.columns, *left])})
            book = replace(book, sheets={**book.sheets, sheet: compile_formulas(book, sheet, {n: left.pop(n) for n in ready}, base_row)})
            done.update(ready)
        return book


def _reads(node) -> set[str]:
    if isinstance(node, tree.Columns):
        return {node.first, node.last}
    if isinstance(node, tree.Unary):
        return _reads(node.arg)
    if isinstance(node, tree.Binary):
        return _reads(node.left) | _reads(node.right)
    if isinstance(node, tree.Call):
        return set().union(*[_reads(a) for a in node.args]) if node.args else set()
    return set()


@dataclass
class _Span:
    """A range: columns of a sheet and the rows it covers; low and high bound a window around the row."""

    sheet: str
    columns: list[str]
    kind: str  # whole, fixed, running, sliding, row
    low: int = 0
    high: int = 0


class Compiler:
    def __init__(self, book: Workbook, sheet: str, base_row: int):
        self.book, self.sheet, self.base = book, sheet, base_row
        self.here = book.sheets[sheet]
        self.scalars: dict[str, list[tuple[str, Val]]] = {}
        self.windows: list[tuple[int, int, dict]] = []
        self.runs: list[tuple[_Span, dict[str, Column], dict[str, str]]] = []
        self.steps: list = []
        self.n = 0

    def alias(self) -> str:
        self.n += 1
        return f"_x{self.n}"

    def stage(self, col: Column) -> Column:
        """An expression that its function uses several times, as a column of its own."""
        name = self.alias()
        self.steps.append({name: col})
        return F.col(name)

    def scalar_call(self, f, *args) -> Val:
        """f over values of the row, with what it uses several times as columns."""
        with values.staged(self.stage):
            return f(*args)

    def constant_of(self, node):
        """The value of an expression that reads no cell; an error is one too."""
        if isinstance(node, tree.Literal):
            return node.value
        one = Sheet(self.here.df.sparkSession.range(1).select(F.col("id").alias(ROW), F.lit(0.0).alias("z")), ["z"])
        made = Compiler(Workbook({"One": one}), "One", 0)
        row = made.apply(made.val(node), "v").df.first()
        if "v_err" in row and row["v_err"] is not None:
            raise ArrayError(row["v_err"])
        return row["v"]

    def is_constant(self, node) -> bool:
        """Whether the expression reads no cell and no place."""
        if isinstance(node, tree.Literal):
            return True
        if isinstance(node, tree.Unary):
            return self.is_constant(node.arg)
        if isinstance(node, tree.Binary):
            return self.is_constant(node.left) and self.is_constant(node.right)
        return isinstance(node, tree.Call) and node.name in registry.FUNCTIONS and not hasattr(self, "fn_" + node.name.lower().replace(".", "_")) and all(self.is_constant(a) for a in node.args)

    # references

    def name_of(self, col: int, sheet: str) -> str | None:
        cols = self.book.sheets[sheet].columns
        return cols[col] if col < len(cols) else None

    def span(self, node) -> _Span | None:
        if isinstance(node, tree.Name):
            source = self.book.sheet_names.get((self.sheet, node.name.upper())) or self.book.names.get(node.name.upper())
            return self.span(tree.parse(source)) if source else None
        if isinstance(node, tree.Columns):
            sheet = node.table or self.sheet
            cols = self.book.sheets[sheet].columns if sheet in self.book.sheets else []
            if not node.first:
                return _Span(sheet, cols, "row" if node.this_row else "whole") if cols else None
            if node.first not in cols or node.last not in cols:
                return None
            a, b = cols.index(node.first), cols.index(node.last)
            return _Span(sheet, cols[a : b + 1], "row" if node.this_row else "whole")
        if isinstance(node, tree.Cell):
            node = tree.Area(node, node)
        if not isinstance(node, tree.Area):
            return None
        a, b = node.first, node.last
        sheet = a.sheet or self.sheet
        if sheet not in self.book.sheets:
            return None
        cols = self.book.sheets[sheet].columns[min(a.col, b.col) : max(a.col, b.col) + 1]
        if not cols:
            return None
        if a.row_abs and b.row_abs or sheet != self.sheet and a.row_abs:
            return _Span(sheet, cols, "fixed", min(a.row, b.row), max(a.row, b.row))
        if a.row_abs:
            return _Span(sheet, cols, "running", a.row, b.row - self.base)
        low, high = a.row - self.base, b.row - self.base
        return _Span(sheet, cols, "row" if low == high == 0 and sheet == self.sheet else "sliding", low, high)

    def read(self, sheet: str, col: str) -> Val:
        return cell_val(self.book.sheets[sheet].df, col)

    def scalar(self, sheet: str, v: Val) -> Val:
        """An aggregate of a whole sheet, joined to every row."""
        name = self.alias()
        self.scalars.setdefault(sheet, []).append((name, v))
        return Val(v.kind, F.col(name), None if v.err is None else F.col(name + "e"))

    def rows_of(self, s: _Span) -> Column | None:
        return None if s.kind == "whole" else F.col(ROW).between(s.low, s.high)

    def neighbour(self, s: _Span, col: str) -> Val:
        """A cell at a fixed distance; off the sheet is #REF! above it and blank below."""
        v, name = self.read(s.sheet, col), self.alias()
        self.windows.append((s.low, s.low, {name: lambda w, c=v.col: F.max(c).over(w)}))
        return Val(v.kind, F.col(name), F.when(F.col(ROW) + s.low < 0, F.lit(REF)))

    def ref(self, node) -> Val:
        s = self.span(node)
        if s is None:
            return error(NAME if isinstance(node, (tree.Name, tree.Columns)) else REF)
        if len(s.columns) > 1 and s.kind == "row":
            vals = [self.read(s.sheet, c) for c in s.columns]
            return Val(vals[0].kind, vals[0].col, vals[0].err, src=vals)
        if s.kind == "row":
            return self.read(s.sheet, s.columns[0])
        if s.kind == "fixed" and s.low == s.high:
            v = self.read(s.sheet, s.columns[0])
            return self.scalar(s.sheet, Val(v.kind, F.max(F.when(self.rows_of(s), v.col)), None if v.err is None else F.max(F.when(self.rows_of(s), v.err))))
        if s.kind == "sliding" and s.low == s.high:
            if s.sheet != self.sheet:
                return self.beside(s)
            return self.neighbour(s, s.columns[0])
        return error(VALUE)

    def beside(self, s: _Span) -> Val:
        """A cell of the same or a shifted row of another sheet: a join on the position."""
        v, name = self.read(s.sheet, s.columns[0]), self.alias()
        other = self.book.sheets[s.sheet].df.select((F.col(ROW) - s.low).alias(ROW), v.col.alias(name))
        self.steps.append(lambda df: df.join(other, ROW, "left"))
        return Val(v.kind, F.col(name))

    # trees

    def val(self, node) -> Val:
        if isinstance(node, tree.Literal):
            return constant(node.value)
        if isinstance(node, tree.ErrorLiteral):
            return error(node.code)
        if isinstance(node, (tree.Cell, tree.Area, tree.Columns, tree.Name)):
            return self.ref(node)
        if isinstance(node, tree.Unary):
            v = self.scalar_call(to_num, self.part(node.arg))
            return v if node.op == "+" else Val("num", -v.col if node.op == "-" else v.col / 100, v.err)
        if isinstance(node, tree.Binary):
            a, b = self.part(node.left), self.part(node.right)
            if node.op == "&":
                return self.scalar_call(concat, a, b)
            return self.scalar_call(arithmetic if node.op in "+-*/^" else compare, node.op, a, b)
        return self.call(node)

    def call(self, node: tree.Call) -> Val:
        name, args = node.name, node.args
        if name in CONDITIONAL:
            return self.conditional(name, args)
        special = getattr(self, "fn_" + name.lower().replace(".", "_"), None)
        try:
            if special is not None:
                return special(*args)
            if name in RANGE_FUNCTIONS and any(is_array(a) for a in args):
                return self.over_arrays(name, args)
            if is_array(node):
                return self.first_cell(node)
        except ArrayError as e:
            return error(str(e))
        if name in RANGE_FUNCTIONS and any(self.is_range(a) for a in args):
            return self.ranged(name, args)
        if name in agg.NUMERIC:
            return self.direct(name, args)
        if name not in registry.FUNCTIONS:
            return error(NAME)
        return self.scalar_call(registry.call, name, [self.part(a) for a in args])

    def part(self, node) -> Val:
        """A value that an operation may use several times: anything but a leaf becomes a column of its own first."""
        v = self.val(node)
        if not isinstance(node, (tree.Call, tree.Binary)) or v.src is not None or v.kind == "blank":
            # a date's serial number takes a tree of its own
            return replace(v, col=self.scalar_call(values.once, v.col)) if isinstance(node, tree.Columns) and v.src is None and v.kind == "num" else v
        name = self.alias()
        made = {name: v.col} if v.err is None else {name: v.col, name + "e": v.err}
        self.steps.append(made)
        return Val(v.kind, F.col(name), None if v.err is None else F.col(name + "e"))

    def over_arrays(self, name: str, args: tuple) -> Val:
        """An aggregate over array expressions: all their cells in one pass, joined as one row."""
        cells, out = Arrays(self).stacked(args), self.alias()
        e = F.first("e", ignorenulls=True)
        if name in ("COUNTA", "COUNTBLANK"):
            v = values.num(F.count_if(F.col("f") if name == "COUNTA" else ~F.col("f")).cast("double"))
        elif name in ("GCD", "LCM", "MEDIAN"):
            return self.one_row(self.far(name, cells, F.col("n")), out, cells.agg(e.alias("e")))
        else:
            v = agg.aggregate(name, Val("num", F.col("n"), F.col("e")))
        one = cells.agg(v.col.alias(out), (F.lit(None).cast("string") if v.err is None else v.err).alias(out + "e"))
        self.steps.append(lambda df: df.join(F.broadcast(one), how="cross"))
        return Val(v.kind, F.col(out), F.col(out + "e"))

    def first_cell(self, node) -> Val:
        """An array inside an operation of single values stands for its first cell."""
        g, name = Arrays(self).grid(node).renumbered(), self.alias()
        kinds = dict(g.df.dtypes)
        kind = {"string": "text", "boolean": "bool"}.get(kinds["c0"], "num")
        err = F.col("c0_err") if "c0_err" in kinds else F.lit(None).cast("string")
        c0 = F.col("c0").cast("double") if kind == "num" else F.col("c0")
        one = g.df.where(F.col(ROW) == 0).agg(F.max(c0).alias(name), F.max(err).alias(name + "e"))
        self.steps.append(lambda df: df.join(F.broadcast(one), how="cross"))
        return Val(kind, F.col(name), F.col(name + "e"))

    def far(self, name: str, df: DataFrame, x: Column) -> tuple[DataFrame, Column, Column | None]:
        """One row, its value and its error, for aggregates that no bounded buffer can make."""
        if name == "MEDIAN":
            return statistics.quantiles(df, x, [0.5]), F.coalesce("q0", F.lit(0.0)), None
        return statistics.divisor(df, x, name == "LCM"), F.when(~F.col("bad"), F.col("value")), values.when(F.col("bad"), values.NUM)

    def one_row(self, made: tuple[DataFrame, Column, Column | None], out: str, errors: DataFrame | None = None) -> Val:
        one, value, err = made
        none = F.lit(None).cast("string")
        if errors is not None:
            one = one.join(F.broadcast(errors.withColumnRenamed(errors.columns[0], "_e")), how="cross")
        err = first_error(F.col("_e") if errors is not None else None, err)
        one = one.select(value.alias(out), (none if err is None else err).alias(out + "e"))
        self.steps.append(lambda df: df.join(F.broadcast(one), how="cross"))
        return Val("num", F.col(out), F.col(out + "e"))

    def is_range(self, node) -> bool:
        s = self.span(node)
        return s is not None and (s.kind != "row" or len(s.columns) >= 1)

    def direct(self, name: str, args: tuple) -> Val:
        """An aggregate of values given one by one; they are coerced."""
        return self.of_list(name, [to_num(self.val(a)) for a in args if not (name == "COUNT" and isinstance(a, tree.Literal) and not isinstance(a.value, float))])

    def of_list(self, name: str, vals: list[Val]) -> Val:
        xs = F.array_compact(F.array(*[v.col for v in vals])) if vals else F.expr("cast(array() as array<double>)")
        n, errs = F.size(xs), first_error(*[v.err for v in vals])
        total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        spread = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n))
        made = {"SUM": total, "COUNT": n.cast("double"), "MIN": F.coalesce(F.array_min(xs), F.lit(0.0)), "MAX": F.coalesce(F.array_max(xs), F.lit(0.0)), "PRODUCT": F.when(n == 0, 0.0).otherwise(F.aggregate(xs, F.lit(1.0), lambda a, x: a * x))}
        if name in made:
            return values.finite(made[name], errs)
        if name in ("AVERAGE", "AVG"):
            return values.num(F.try_divide(total, n), errs, values.when(n == 0, values.DIV0))
        if name in ("VAR.S", "VAR.P", "STDEV.S", "STDEV.P"):
            below = n - 1 if name.endswith("S") else n
            var = F.try_divide(spread, below)
            return values.num(F.sqrt(var) if name.startswith("ST") else var, errs, values.when(below <= 0, values.DIV0))
        if name == "MEDIAN":
            s = F.array_sort(xs)
            return values.num(F.coalesce((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2, F.lit(0.0)), errs)
        if name == "GEOMEAN":
            bad = (n == 0) | F.exists(xs, lambda x: x <= 0)
            return values.num(F.when(~bad, F.exp(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.ln(x)) / n)), errs, values.when(bad, values.NUM))
        raise NotImplementedError(f"{name} of single values")

    def ranged(self, name: str, args: tuple) -> Val:
        """An aggregate over ranges: one column at a time where its parts can be combined."""
        spans = [self.span(a) for a in args]
        if len(args) == 1 and spans[0].kind == "row":
            vals = [self.read(spans[0].sheet, c) for c in spans[0].columns]
            if name in ("COUNTA", "COUNTBLANK"):
                hit = [agg.non_blank(v) if name == "COUNTA" else v.col.isNull() for v in vals]
                return values.num(sum((F.when(h, 1.0).otherwise(0.0) for h in hit), F.lit(0.0)))
            if name in ("AND", "OR", "XOR"):
                return registry.call(name, vals)
            return self.of_list(name, [v for v in vals if v.kind == "num"])
        if len(args) == 1 and len(spans[0].columns) == 1:
            return self.one_column(name, spans[0])
        parts: list[Val] = []
        for a, s in zip(args, spans):
            parts += [to_num(self.val(a))] if s is None else [self.one_column("SUM" if name in ("SUM", "AVERAGE", "AVG") else name, _Span(s.sheet, [c], s.kind, s.low, s.high)) for c in s.columns]
        if name in ("SUM", "COUNT", "COUNTA", "COUNTBLANK"):
            return values.finite(sum((p.col for p in parts), F.lit(0.0)), *[p.err for p in parts])
        if name in ("MIN", "MAX"):
            return Val("num", (F.least if name == "MIN" else F.greatest)(*[p.col for p in parts]) if len(parts) > 1 else parts[0].col, first_error(*[p.err for p in parts]))
        if name in ("AVERAGE", "AVG"):
            counts: list[Val] = []
            for a, s in zip(args, spans):
                counts += [values.num(F.lit(1.0))] if s is None else [self.one_column("COUNT", _Span(s.sheet, [c], s.kind, s.low, s.high)) for c in s.columns]
            n = sum((c.col for c in counts), F.lit(0.0))
            return values.num(F.try_divide(sum((p.col for p in parts), F.lit(0.0)), n), *[p.err for p in parts], values.when(n == 0, values.DIV0))
        raise NotImplementedError(f"{name} over several columns")

    def one_column(self, name: str, s: _Span) -> Val:
        v = self.read(s.sheet, s.columns[0])
        if s.kind in ("whole", "fixed"):
            if name in ("MEDIAN", "GCD", "LCM"):
                src = self.book.sheets[s.sheet].df
                src = src if s.kind == "whole" else src.where(self.rows_of(s))
                return self.one_row(self.far(name, src, agg.numbers(v)), self.alias(), None if v.err is None else src.agg(F.first(v.err, ignorenulls=True)))
            return self.scalar(s.sheet, agg.aggregate(name, v, self.rows_of(s)))
        x = agg.numbers(v)
        if s.kind == "running":
            return self.running_column(name, s, v)
        total, count = self.alias(), self.alias()
        f = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "PRODUCT": F.product, "STDEV.S": F.stddev_samp, "STDEV.P": F.stddev_pop, "VAR.S": F.var_samp, "VAR.P": F.var_pop}[name]
        self.windows.append((s.low, s.high, {total: lambda w: f(x).over(w), count: lambda w: F.count(x).over(w)}))
        c = F.col(count)
        need = {"AVERAGE": 1, "STDEV.S": 2, "VAR.S": 2, "STDEV.P": 1, "VAR.P": 1}.get(name, 0)
        return values.finite(F.coalesce(F.col(total), F.lit(None if need else 0.0)).cast("double"), values.when(c < need, values.DIV0) if need else None)

    def running_column(self, name: str, s: _Span, v: Val) -> Val:
        """An aggregate from a fixed row to the formula's own (or one at a fixed distance from it), in either direction."""
        x = agg.numbers(v)
        if name == "COUNTA":
            x = F.when(agg.non_blank(v), F.lit(1.0))
        elif name == "COUNTBLANK":
            x = F.when(v.col.isNull() | (v.col == "") if v.kind == "text" else v.col.isNull(), F.lit(1.0))
        elif name not in ("SUM", "COUNT", "AVERAGE", "AVG", "MIN", "MAX"):
            raise NotImplementedError(f"{name} over a running range")
        total, count = self.alias(), self.alias()
        how = {total: name.lower()} if name in ("MIN", "MAX") else {}
        self.runs.append((s, {total: x, count: F.when(x.isNotNull(), 1).otherwise(0)}, how))
        some = F.coalesce(F.col(count), F.lit(0))
        if name in ("COUNT", "COUNTA", "COUNTBLANK"):
            return values.num(some.cast("double"))
        if name in ("AVERAGE", "AVG"):
            return values.finite(F.try_divide(F.col(total), some), values.when(some == 0, values.DIV0))
        return values.finite(F.coalesce(F.col(total), F.lit(0.0)))

    def with_runs(self, df: DataFrame) -> DataFrame:
        """The running columns of the formula. One pass over the rows for ranges of the same shape."""
        shapes: dict[tuple, tuple[dict, dict]] = {}
        for s, sums, how in self.runs:
            kept = shapes.setdefault((s.sheet, s.low, s.high), ({}, {}))
            kept[0].update(sums)
            kept[1].update(how)
        for (sheet, low, high), (sums, how) in shapes.items():
            if low == high == 0 and sheet == self.sheet:
                df = running(df, sums, how=how)
                continue
            src = self.book.sheets[sheet].df
            # rows from the fixed one on, and those before it, whose range runs back up to themselves
            down = running(src.where(F.col(ROW) >= low), sums, how=how).select(ROW, *sums)
            up = running(src.where(F.col(ROW) <= low), sums, how=how, backwards=True).where(F.col(ROW) < low).select(ROW, *sums)
            last = F.broadcast(src.agg(F.max(ROW).alias("_last")))
            df = df.join(last, how="cross").withColumn("_at", F.least(F.col(ROW) + high, F.greatest(F.col("_last"), F.lit(low))))
            df = df.join(down.unionByName(up).withColumnRenamed(ROW, "_at"), "_at", "left").drop("_at", "_last")
        return df

    # functions that need more than their values

    def fn_row(self, node=None) -> Val:
        if node is None:
            return values.num((F.col(ROW) + 1).cast("double"))
        s = self.span(node)
        return values.num((F.col(ROW) + 1 + s.low).cast("double") if s.kind in ("row", "sliding") else F.lit(float(s.low + 1)))

    def fn_column(self, node=None) -> Val:
        s = self.span(node) if node is not None else None
        cols = self.here.columns
        return constant(float(len(cols) + 1)) if s is None else constant(float(self.book.sheets[s.sheet].columns.index(s.columns[0]) + 1))

    def fn_rows(self, node) -> Val:
        if is_array(node):
            return self.one_row((Arrays(self).grid(node).df.agg(F.count(F.lit(1)).cast("double").alias("n")), F.col("n"), None), self.alias())
        s = self.span(node)
        if s is None:
            return constant(1.0)
        return self.scalar(s.sheet, values.num(F.count(F.lit(1)).cast("double"))) if s.kind == "whole" else values.num(F.lit(float(s.high - s.low + 1)) if s.kind != "running" else (F.col(ROW) + s.high - s.low + 1).cast("double"))

    def fn_columns(self, node) -> Val:
        if is_array(node):
            return constant(float(Arrays(self).grid(node).width))
        s = self.span(node)
        return constant(float(len(s.columns) if s else 1))

    def fn_today(self) -> Val:
        """The day on which the plan is made, captured once."""
        import datetime

        return constant(float((datetime.datetime.now(datetime.timezone.utc).date() - datetime.date(1899, 12, 30)).days))

    def fn_now(self) -> Val:
        import datetime

        t = datetime.datetime.now(datetime.timezone.utc) - datetime.datetime(1899, 12, 30, tzinfo=datetime.timezone.utc)
        return constant(t.total_seconds() / 86400)

    def fn_subtotal(self, code, *args) -> Val:
        k = code.value if isinstance(code, tree.Literal) else None
        return self.ranged(agg.SUBTOTAL[int(k) - 1], args) if isinstance(k, float) and 1 <= k < 12 else error(VALUE)

    def whole(self, node) -> tuple[str, Val, Column | None]:
        s = self.span(node)
        v = self.read(s.sheet, s.columns[0])
        return s.sheet, v, self.rows_of(s)

    def picked(self, node) -> tuple[DataFrame, Column]:
        """The rows and the numbers of a range."""
        sheet, v, where = self.whole(node)
        src = self.book.sheets[sheet].df
        return (src if where is None else src.where(where)), agg.numbers(v)

    def fn_percentile_inc(self, node, p) -> Val:
        src, x = self.picked(node)
        if not self.is_constant(p):
            return self.percentile_by_row(src, x, to_num(self.part(p)))
        share = self.constant_of(p)
        if not isinstance(share, (int, float)) or not 0 <= share <= 1:
            return error(values.NUM)
        return self.one_row((statistics.quantiles(src, x, [share]), F.col("q0"), values.when(F.col("n") == 0, values.NUM)), self.alias())

    def percentile_by_row(self, src: DataFrame, x: Column, p: Val) -> Val:
        """A share per row: positions around it, found by two joins."""
        low, high, n, at = (self.alias() for _ in range(4))
        places = statistics.ranked(src, x)
        total = src.agg(F.count(x).alias(n))

        def step(df):
            df = df.join(F.broadcast(total), how="cross").withColumn(at, F.when(p.col.between(0, 1), p.col * (F.col(n) - 1)))
            df = df.withColumn("_at", F.floor(at)).join(places.withColumnRenamed("v", low), "_at", "left")
            return df.withColumn("_at", F.ceil(at)).join(places.withColumnRenamed("v", high), "_at", "left").drop("_at")

        self.steps.append(step)
        share = F.col(at) - F.floor(at)
        return values.num((1 - share) * F.col(low) + share * F.col(high), p.err, values.when(F.col(low).isNull(), values.NUM))

    def fn_quartile_inc(self, node, q) -> Val:
        if not self.is_constant(q):
            k = to_num(self.part(q))
            src, x = self.picked(node)
            return self.percentile_by_row(src, x, Val("num", F.when(k.col >= 0, F.floor(k.col)) / 4, k.err))
        k = self.constant_of(q)
        ok = isinstance(k, (int, float)) and 0 <= int(k) <= 4 and k >= 0
        return self.fn_percentile_inc(node, tree.Literal(int(k) * 0.25)) if ok else error(values.NUM)

    def number(self, node) -> float:
        """The value of a constant argument."""
        if isinstance(node, tree.Literal) and isinstance(node.value, float):
            return node.value
        if isinstance(node, tree.Unary) and node.op in "+-%":
            x = self.number(node.arg)
            return -x if node.op == "-" else x / 100 if node.op == "%" else x
        raise NotImplementedError("this argument has to be a number")

    def nth(self, node, k, descending: bool) -> Val:
        if not self.is_constant(k):
            return self.nth_by_row(node, to_num(self.part(k)), descending)
        k = tree.Literal(float(self.constant_of(k)))
        sheet, v, where = self.whole(node)
        n, x = int(self.number(k)), agg.numbers(v)
        x = x if where is None else F.when(where, x)
        # a value at rank n: counts per value, then the first whose running count reaches n
        src, name = self.book.sheets[sheet].df, self.alias()
        counts = src.select(x.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        top = counts.orderBy(F.col("v").desc() if descending else F.col("v").asc()).limit(max(1, n))
        run = F.aggregate(F.array_sort(F.collect_list(F.struct((-F.col("v") if descending else F.col("v")).alias("o"), "v", "c"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("r")), lambda a, y: F.struct((a["n"] + y["c"]).alias("n"), F.when(a["r"].isNull() & (a["n"] + y["c"] >= n), y["v"]).otherwise(a["r"]).alias("r")))
        one = top.agg(run["r"].alias(name)) if n >= 1 else counts.agg(F.max(F.lit(None).cast("double")).alias(name))
        self.steps.append(lambda df: df.join(F.broadcast(one), how="cross"))
        return values.num(F.col(name), values.when(F.col(name).isNull(), values.NUM))

    def nth_by_row(self, node, k: Val, descending: bool) -> Val:
        """A rank per row: one join on the numbers' positions."""
        places, name = statistics.ranked(*self.picked(node), descending), self.alias()
        self.steps.append(lambda df: df.withColumn("_at", F.floor(k.col) - 1).join(places.withColumnRenamed("v", name), "_at", "left").drop("_at"))
        return values.num(F.col(name), k.err, values.when(F.col(name).isNull(), values.NUM))

    def fn_large(self, node, k) -> Val:
        return self.nth(node, k, True)

    def fn_small(self, node, k) -> Val:
        return self.nth(node, k, False)

    def fn_mode_sngl(self, node) -> Val:
        sheet, v, _ = self.whole(node)
        name = self.alias()
        counts = self.book.sheets[sheet].df.select(agg.numbers(v).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        one = counts.where("c > 1").agg(F.max(F.struct(F.col("c"), (-F.col("v")).alias("m"))).alias("b")).select((-F.col("b.m")).alias(name))
        self.steps.append(lambda df: df.join(F.broadcast(one), how="cross"))
        return values.num(F.col(name), values.when(F.col(name).isNull(), NA))

    def fn_rank_eq(self, key, node, order=None) -> Val:
        """1 + how many numbers are better, by a join on the grouped values."""
        from pyspark.sql import Window

        sheet, v, _ = self.whole(node)
        up = order is not None and self.number(order) != 0
        name, k = self.alias(), self.alias()
        counts = self.book.sheets[sheet].df.select(agg.numbers(v).alias(k)).where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("_c"))
        ranks = running(number_rows(counts, F.col(k).asc() if up else F.col(k).desc()), {"_upto": F.col("_c")}).select(k, (F.col("_upto") - F.col("_c") + 1).cast("double").alias(name))
        probe = to_num(self.part(key))
        self.steps.append(lambda df: df.withColumn(k, probe.col).join(ranks, k, "left").drop(k))
        del Window
        return values.num(F.col(name), probe.err, values.when(F.col(name).isNull(), NA))

    def fn_sumproduct(self, *nodes) -> Val:
        got = [self.whole(n) for n in nodes]
        return self.scalar(got[0][0], agg.sumproduct(*[v for _, v, _ in got]))

    def pair(self, name: str, a, b) -> Val:
        (sheet, x, _), (_, y, _) = self.whole(a), self.whole(b)
        return self.scalar(sheet, agg.paired(name, x, y))

    def fn_correl(self, a, b) -> Val:
        return self.pair("CORREL", a, b)

    def fn_covariance_s(self, a, b) -> Val:
        return self.pair("COVARIANCE.S", a, b)

    def fn_covariance_p(self, a, b) -> Val:
        return self.pair("COVARIANCE.P", a, b)

    def conditional(self, name: str, args: tuple) -> Val:
        """COUNTIF and its kin. Constant criteria make one aggregate; a criterion cell of the row makes a grouped join."""
        if name in ("SUMIFS", "AVERAGEIFS", "MAXIFS", "MINIFS"):
            target, pairs = args[0], list(zip(args[1::2], args[2::2]))
        elif name in ("SUMIF", "AVERAGEIF"):
            target, pairs = args[2] if len(args) > 2 else args[0], [(args[0], args[1])]
        else:
            target, pairs = None, list(zip(args[::2], args[1::2]))
        kind = {"COUN": "COUNT*", "SUMI": "SUM", "AVER": "AVERAGE", "MAXI": "MAX", "MINI": "MIN"}[name[:4]]
        shapes = {(s.kind, s.high - s.low) for s in map(self.span, [p for p, _ in pairs] + ([target] if target is not None else []))}
        if len(shapes) > 1:
            return error(VALUE)
        first = self.span(pairs[0][0])
        if first.kind == "running":
            return self.conditional_run(kind, target, pairs)
        sheet, _, where = self.whole(pairs[0][0])
        keys: list[tuple[Val, Val]] = []
        for node, crit in pairs:
            v = self.whole(node)[1]
            if self.is_constant(crit):
                test = matches(v, parse_criterion(self.constant_of(crit)))
                where = test if where is None else where & test
            else:
                keys.append((v, self.part(crit)))
        value = None if target is None else self.whole(target)[1]
        if not keys:
            return self.scalar(sheet, self.folded(kind, value, where))
        src, names = self.book.sheets[sheet].df, [self.alias() for _ in keys]
        picked = src if where is None else src.where(where)
        out = self.alias()
        res = self.folded(kind, value, None)
        made = [res.col.alias(out), (F.lit(None).cast("string") if res.err is None else res.err).alias(out + "e")]
        grouped = picked.groupBy(*[join_key(v).alias(n) for (v, _), n in zip(keys, names)]).agg(*made)
        self.steps.append(lambda df: self.met(df, keys, names, picked, grouped, made, out))
        miss = F.col(out).isNull() & F.col(out + "e").isNull()
        err = values.when(miss, values.DIV0) if kind == "AVERAGE" else None
        return Val("num", F.col(out) if kind == "AVERAGE" else F.coalesce(F.col(out), F.lit(0.0)), first_error(*[k.err for _, k in keys], F.col(out + "e"), err))

    def met(self, df: DataFrame, keys: list, names: list[str], picked: DataFrame, grouped: DataFrame, made: list, out: str, block: int = 256) -> DataFrame:
        """Criterion cells of the row: plain ones are joined by equality; the distinct others run over the range in blocks."""
        plain = df.withColumns({n: criterion_key(v, k) for (v, k), n in zip(keys, names)}).join(grouped, names, "left").drop(*names)
        texts = [k.col for _, k in keys if k.kind == "text"]
        if not texts:
            return plain
        odd = F.coalesce(F.greatest(*[F.coalesce(t.rlike(SPECIAL), F.lit(False)) for t in texts]) if len(texts) > 1 else texts[0].rlike(SPECIAL), F.lit(False))
        asked = [tuple(r) for r in df.where(odd).select(*[k.col.alias(n) for (_, k), n in zip(keys, names)]).distinct().toLocalIterator()]
        hits = None
        for a in range(0, len(asked), block):
            tests = []
            for i, row in enumerate(asked[a : a + block]):
                hit = F.lit(True)
                for (v, _), x in zip(keys, row):
                    hit = hit & (F.lit(False) if x is None else matches(v, parse_criterion(x)))
                tests.append(F.when(hit, F.lit(a + i)))
            one = picked.withColumn("_i", F.explode(F.array_compact(F.array(*tests)))).groupBy("_i").agg(*made)
            hits = one if hits is None else hits.unionByName(one)
        if hits is None:
            return plain
        kinds = {"text": "string", "num": "double", "bool": "boolean"}
        schema = "_i int, " + ", ".join(f"{n} {kinds[k.kind]}" for (_, k), n in zip(keys, names))
        rows = df.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(asked)], schema)
        named = rows.join(hits, "_i", "left").withColumnsRenamed({n: n + "r" for n in names} | {out: "_w", out + "e": "_we"})
        cond = odd
        for n in names:
            cond = cond & F.col(n).eqNullSafe(F.col(n + "r"))
        joined = plain.withColumns({n: F.when(odd, k.col) for (_, k), n in zip(keys, names)}).join(named, cond, "left")
        chosen = {out: F.when(odd, F.col("_w")).otherwise(F.col(out)), out + "e": F.when(odd, F.col("_we")).otherwise(F.col(out + "e"))}
        return joined.withColumns(chosen).drop("_i", "_w", "_we", *names, *[n + "r" for n in names])

    def conditional_run(self, kind: str, target, pairs: list) -> Val:
        """Criteria over ranges from the first row to the formula's own: running totals, within each value of criterion cells."""
        spans = [self.span(p) for p, _ in pairs] + ([self.span(target)] if target is not None else [])
        if any(s.low or s.high or s.sheet != self.sheet for s in spans):
            raise NotImplementedError("running criteria start in the first row and end in the formula's own")
        test, by, probes = None, {}, {}
        for (node, crit), s in zip(pairs, spans):
            v = self.read(s.sheet, s.columns[0])
            if self.is_constant(crit):
                hit = matches(v, parse_criterion(self.constant_of(crit)))
                test = hit if test is None else test & hit
            else:
                n = self.alias()
                by[n], probes[n] = join_key(v), criterion_key(v, self.part(crit))
        value = None if target is None else agg.numbers(self.read(self.sheet, spans[-1].columns[0]))
        x = F.lit(1.0) if value is None else value
        x = x if test is None else F.when(test, x)
        total, count = self.alias(), self.alias()
        sums, how = {total: x, count: F.when(x.isNotNull(), 1).otherwise(0)}, {total: kind.lower()} if kind in ("MIN", "MAX") else {}
        def step(df):
            if not by:
                return running(df, sums, how=how)
            # cells of the range and the questions of the rows in one sequence: a question comes after its row's cells
            cells = df.select((F.col(ROW) * 2).alias(ROW), *[c.alias(n) for n, c in by.items()], x.alias("_x"))
            asks = df.select((F.col(ROW) * 2 + 1).alias(ROW), *[c.alias(n) for n, c in probes.items()], F.lit(None).cast("double").alias("_x"))
            line = cells.unionByName(asks).dropna(subset=list(by))
            run = running(line, {total: F.col("_x"), count: F.when(F.col("_x").isNotNull(), 1).otherwise(0)}, how=how, by=tuple(by))
            answers = run.where(F.col(ROW) % 2 == 1).select(F.floor(F.col(ROW) / 2).alias(ROW), total, count)
            return df.join(answers, ROW, "left")

        self.steps.append(step)
        some = F.coalesce(F.col(count), F.lit(0))
        if kind == "COUNT*":
            return values.num(some.cast("double"))
        if kind == "AVERAGE":
            return values.num(F.try_divide(F.col(total), some), values.when(some == 0, values.DIV0))
        return values.num(F.coalesce(F.col(total), F.lit(0.0)))

    def folded(self, kind: str, value: Val | None, where: Column | None) -> Val:
        if kind == "COUNT*":
            return values.num(F.count(F.lit(1) if where is None else F.when(where, F.lit(1))).cast("double"))
        return agg.aggregate(kind, value, where)

    def lookup(self, key, s: _Span, result_cols: dict, mode: int, last: bool, validate: bool) -> Val | None:
        k, found, key_col = self.part(key), self.alias(), s.columns[0]
        table, probe = self.book.sheets[s.sheet].df, self.alias()
        table = table.where(self.rows_of(s)) if s.kind == "fixed" else table
        if mode == 2 and isinstance(key, tree.Literal):
            one = lookups.wildcard_first(table, key_col, key.value, result_cols, last) if isinstance(key.value, str) else None
            if one is None:
                return self.lookup(key, s, result_cols, 0, last, validate)
            self.steps.append(lambda df: df.join(F.broadcast(one), how="cross").withColumn(found, F.col(next(iter(result_cols))).isNotNull()))
        elif mode == 2:
            self.steps.append(lambda df: lookups.wildcard(df.withColumn(probe, k.col), probe, table, key_col, result_cols, last, found).drop(probe))
        elif mode == 0:
            self.steps.append(lambda df: lookups.exact(df.withColumn(probe, k.col), probe, table, key_col, result_cols, last, found).drop(probe))
        else:
            self.steps.append(lambda df: lookups.nearest(df.withColumn(probe, k.col), probe, table, key_col, result_cols, larger=mode == 1, validate=validate, found=found).drop(probe))
        return Val("bool", F.col(found), k.err)

    def result(self, found: Val, sheet: str, col: str, name: str, spare: Val | None = None) -> Val:
        kind = cell_val(self.book.sheets[sheet].df, col).kind
        v = Val(kind, F.col(name).cast("double") if kind == "num" else F.col(name), first_error(found.err, values.when(~found.col, NA)))
        return v if spare is None else registry.call("IFNA", [v, spare])

    def fn_vlookup(self, key, node, col, approx=None) -> Val:
        s = self.span(node)
        i = int(self.number(col))
        if i < 1 or i > len(s.columns):
            return error(VALUE if i < 1 else REF)
        near = approx is None or self.truth(approx)
        name = self.alias()
        found = self.lookup(key, s, {name: s.columns[i - 1]}, -1 if near else 0, False, near)
        return self.result(found, s.sheet, s.columns[i - 1], name)

    def fn_hlookup(self, key, node, row, approx=None) -> Val:
        """The first row of a range is searched, and the row-th one of the column found is the result."""
        s, i = self.span(node), int(self.constant_of(row))
        low = 0 if s.kind == "whole" else s.low if s.kind in ("fixed", "running") else self.base + s.low
        high = None if s.kind == "whole" else s.high if s.kind == "fixed" else self.base + s.high
        if i < 1 or high is not None and i > high - low + 1:
            return error(VALUE if i < 1 else REF)
        src, k, probe, name, found = self.book.sheets[s.sheet].df, self.part(key), self.alias(), self.alias(), self.alias()
        near = approx is None or self.truth(approx)
        text = any(cell_val(src, c).kind == "text" for c in s.columns)
        plain = src.select(ROW, *[cell_val(src, c).col.alias(c) for c in s.columns])
        table = lookups.across(plain, s.columns, low, low + i - 1, k.kind == "text", text)
        if near:
            self.steps.append(lambda df: lookups.nearest(df.withColumn(probe, k.col), probe, table, "key", {name: "result"}, validate=True, found=found).drop(probe))
        else:
            self.steps.append(lambda df: lookups.exact(df.withColumn(probe, k.col), probe, table, "key", {name: "result"}, False, found).drop(probe))
        return Val("text" if text else "num", F.col(name), first_error(k.err, values.when(~F.col(found), NA)))

    def truth(self, node) -> bool:
        return bool(self.constant_of(node)) if self.is_constant(node) else False

    def fn_xlookup(self, key, where, results, spare=None, mode=None, search=None) -> Val:
        a, b, name = self.span(where), self.span(results), self.alias()
        m, way = (int(self.number(x)) if x is not None and not (isinstance(x, tree.Literal) and x.value is None) else d for x, d in ((mode, 0), (search, 1)))
        found = self.lookup(key, a, {name: b.columns[0]}, m, way < 0, abs(way) == 2)
        none = spare is None or isinstance(spare, tree.Literal) and spare.value is None
        return self.result(found, b.sheet, b.columns[0], name, None if none else self.val(spare))

    def position(self, key, node, mode: int, last: bool, validate: bool) -> Val:
        s, name = self.span(node), self.alias()
        found = self.lookup(key, s, {name: ROW}, mode, last, validate)
        return values.num((F.col(name) + 1 - (s.low if s.kind == "fixed" else 0)).cast("double"), found.err, values.when(~found.col, NA))

    def fn_match(self, key, node, kind=None) -> Val:
        k = 1 if kind is None else int(self.number(kind))
        return self.position(key, node, {1: -1, 0: 0, -1: 1}[k], k == -1, k != 0)

    def fn_xmatch(self, key, node, mode=None, search=None) -> Val:
        m, way = (int(self.number(x)) if x is not None else d for x, d in ((mode, 0), (search, 1)))
        return self.position(key, node, m, way < 0, abs(way) == 2)

    def fn_index(self, node, row, col=None) -> Val:
        if is_array(node):
            return self.index_of(Arrays(self).grid(node).renumbered(), row, col)
        s, name = self.span(node), self.alias()
        c = 0 if col is None else int(self.number(col)) - 1
        if c < 0 or c >= len(s.columns):
            return error(VALUE if c < 0 else REF)
        at, src = to_num(self.part(row)), self.book.sheets[s.sheet].df
        probe = self.alias()
        self.steps.append(lambda df: lookups.index_rows(src, df.withColumn(probe, at.col), probe, s.columns[c], name).drop(probe))
        v = cell_val(src, s.columns[c])
        return Val(v.kind, F.col(name).cast("double") if v.kind == "num" else F.col(name), first_error(at.err, F.col(f"{name}_err")))

    def index_of(self, g, row, col) -> Val:
        """INDEX of an array expression."""
        c = 0 if col is None else int(self.constant_of(col)) - 1
        if not 0 <= c < g.width:
            return error(VALUE if c < 0 else REF)
        at, probe, name, v = to_num(self.part(row)), self.alias(), self.alias(), cell_val(g.df, f"c{c}")
        self.steps.append(lambda df: lookups.index_rows(g.df, df.withColumn(probe, at.col), probe, f"c{c}", name).drop(probe))
        return Val(v.kind, F.col(name).cast("double") if v.kind == "num" else F.col(name), first_error(at.err, F.col(f"{name}_err")))

    # the plan

    def apply(self, v: Val, out: str) -> Sheet:
        return self.apply_all({out: v})

    def apply_all(self, outs: dict[str, Val]) -> Sheet:
        df = self.here.df
        for low, high, made in self.windows:
            df = neighbourhood(df, low, high, made)
        if self.runs:
            df = self.with_runs(df)
        for sheet, scalars in self.scalars.items():
            cols = [c for name, x in scalars for c in ([x.col.alias(name)] + ([x.err.alias(name + "e")] if x.err is not None else []))]
            df = df.join(F.broadcast(self.book.sheets[sheet].df.agg(*cols)), how="cross")
        outs = {n: self.scalar_call(values.settled, v) for n, v in outs.items()}
        for step in _layered(self.steps):
            df = df.withColumns(step) if isinstance(step, dict) else step(df)
        made = df.withColumns({k: c for n, v in outs.items() for k, c in ((n, v.col), (f"{n}_err", v.err)) if c is not None})
        keep = [ROW, *self.here.df.columns, *[k for n in outs for k in (n, f"{n}_err")]]
        return Sheet(made.select(*[c for c in dict.fromkeys(keep) if c in made.columns]), [*self.here.columns, *outs])


def _layered(steps: list) -> list:
    """Steps in order, with neighbouring columns that don't read each other added at once."""
    out: list = []
    for step in steps:
        if not isinstance(step, dict):
            out.append(step)
            continue
        # columns made since the last other step, a layer each; a column goes right behind the last layer that it reads
        first = next((i for i in range(len(out), 0, -1) if not isinstance(out[i - 1], dict)), 0)
        reads = set(re.findall(r"_x\d+e?", " ".join(str(c) for c in step.values())))
        at = next((i + 1 for i in range(len(out) - 1, first - 1, -1) if reads & out[i].keys()), first)
        if at == len(out):
            out.append({})
        out[at] = out[at] | step
    return out


def compile_formula(book: Workbook, sheet: str, name: str, source: str, base_row: int = 0) -> Sheet:
    return compile_formulas(book, sheet, {name: source}, base_row)


def compile_formulas(book: Workbook, sheet: str, formulas: dict[str, str], base_row: int = 0) -> Sheet:
    """Formulas that don't read each other: neighbours that don't spill are compiled into one plan."""
    c, waiting = Compiler(book, sheet, base_row), {}

    def settle() -> Workbook:
        return replace(book, sheets={**book.sheets, sheet: c.apply_all(waiting)}) if waiting else book

    for name, source in formulas.items():
        try:
            node = tree.parse(source)
        except tree.FormulaError:
            waiting[name] = error(NAME)
            continue
        s = c.span(node)
        if is_array(node) or isinstance(node, tree.Area) and s is not None and s.low != s.high:
            book = settle()
            made = spill(book.sheets[sheet], Arrays(Compiler(book, sheet, base_row)), node, name, base_row)
            book = replace(book, sheets={**book.sheets, sheet: made})
            c, waiting = Compiler(book, sheet, base_row), {}
        else:
            waiting[name] = c.val(node)
    return settle().sheets[sheet]


def spill(here: Sheet, maker: Arrays, node, name: str, base_row: int) -> Sheet:
    """The sheet with an array's columns beside its own, from row base_row on; a longer array adds blank rows."""
    made, names = maker.spilled(node, name, base_row)
    df = here.df.join(made, ROW, "full")
    keep = [ROW, *[c for c in here.df.columns if c != ROW], *[c for c in made.columns if c != ROW]]
    return Sheet(df.select(*[F.col(f"`{c}`") for c in keep]), [*here.columns, *names])


__all__ = ["Sheet", "Workbook", "blank", "compile_formula"]
