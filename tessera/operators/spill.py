"""Dynamic arrays as formulas: an array expression becomes a grid, a DataFrame of _row and cells c0, c1, ...

A cell's error stands beside it in c0_err and so on, as in sheets. Arrays nest, feed aggregates, ROWS, COLUMNS and
INDEX, and spill over the rows of a sheet from the formula's own row on. Heights stay unknown until the plan runs,
except for TRANSPOSE, whose height becomes its width.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CALC, VALUE
from ..plans import formula as tree
from ..plans.rows import ROW, number_rows
from . import arrays
from .arrays import ArrayError

#: Fixed value: the most columns that a sheet has.
MOST_COLUMNS = 16_384


@dataclass
class Grid:
    df: DataFrame
    width: int
    dense: bool

    def cells(self) -> list[str]:
        return [f"c{i}" for i in range(self.width)]

    def renumbered(self) -> Grid:
        return self if self.dense else Grid(_dense(self.df), self.width, True)


def _dense(df: DataFrame) -> DataFrame:
    return number_rows(df.withColumnRenamed(ROW, "_old"), F.col("_old").asc()).drop("_old")


def _renamed(df: DataFrame, cells: list[str]) -> list[Column]:
    """These columns (with their errors) as c0, c1, ..."""
    return [F.col(f"`{src}{end}`").alias(f"c{i}{end}") for i, src in enumerate(cells) for end in ("", "_err") if f"{src}{end}" in df.columns]


def is_array(node) -> bool:
    return isinstance(node, tree.Call) and node.name in BUILDERS


class Arrays:
    """Evaluates array expressions for one formula; `compiler` resolves references."""

    def __init__(self, compiler):
        self.c = compiler

    def rows(self, s) -> tuple[int, int] | None:
        """First and last row of a range, as the formula reads them in its own row; None for all rows."""
        if s.kind == "whole":
            return None
        if s.kind == "fixed":
            return s.low, s.high
        return (s.low if s.kind == "running" else self.c.base + s.low), self.c.base + s.high

    def grid(self, node) -> Grid:
        if is_array(node):
            return getattr(self, BUILDERS[node.name])(*node.args)
        s = self.c.span(node)
        if s is not None:
            return self.of_range(s)
        return self.elementwise(node)

    def of_range(self, s) -> Grid:
        df, rows = self.c.book.sheets[s.sheet].df, self.rows(s)
        low = 0
        if rows is not None:
            low = rows[0]
            df = df.where(F.col(ROW).between(*rows))
        return Grid(df.select((F.col(ROW) - low).alias(ROW), *self._cells(s)), len(s.columns), True)

    def _cells(self, s) -> list[Column]:
        """The cells of a range as formulas see them: numbers as doubles, dates as serials."""
        out = []
        for i, v in enumerate(self.c.read(s.sheet, c) for c in s.columns):
            out += [v.col.alias(f"c{i}")] + ([v.err.alias(f"c{i}_err")] if v.err is not None else [])
        return out

    def _spans(self, node) -> list:
        s = self.c.span(node)
        if s is not None:
            return [s]
        if isinstance(node, tree.Unary):
            return self._spans(node.arg)
        if isinstance(node, tree.Binary):
            return self._spans(node.left) + self._spans(node.right)
        if isinstance(node, tree.Call):
            return [s for a in node.args for s in self._spans(a)]
        return []

    def _by_row(self, node):
        """The expression with its ranges replaced by the cell of the row."""
        s = self.c.span(node)
        if s is not None:
            return tree.Columns(s.sheet, s.columns[0], s.columns[0], True)
        if isinstance(node, tree.Unary):
            return replace(node, arg=self._by_row(node.arg))
        if isinstance(node, tree.Binary):
            return replace(node, left=self._by_row(node.left), right=self._by_row(node.right))
        if isinstance(node, tree.Call):
            return replace(node, args=tuple(self._by_row(a) for a in node.args))
        return node

    def _computed(self, node) -> tuple[DataFrame, str, tuple[int, int] | None]:
        """An expression over ranges of one sheet and the same rows, as a column `_mask` of that sheet."""
        spans = self._spans(node)
        places = {(s.sheet, self.rows(s)) for s in spans}
        if len(places) != 1 or any(len(s.columns) != 1 for s in spans):
            raise ArrayError(VALUE)
        (sheet, rows), = places
        sub = type(self.c)(self.c.book, sheet, 0)
        return sub.apply(sub.val(self._by_row(node)), "_mask").df, sheet, rows

    def elementwise(self, node) -> Grid:
        df, _, rows = self._computed(node)
        low = 0
        if rows is not None:
            low, df = rows[0], df.where(F.col(ROW).between(*rows))
        return Grid(df.select((F.col(ROW) - low).alias(ROW), *_renamed(df, ["_mask"])), 1, True)

    def filter(self, array, include, spare=None) -> Grid:
        s = self.c.span(array)
        if s is not None and not is_array(include) and {(x.sheet, self.rows(x)) for x in self._spans(include)} == {(s.sheet, self.rows(s))}:
            # array and condition lie side by side: one pass, no join
            df, _, rows = self._computed(include)
            low = 0
            if rows is not None:
                low, df = rows[0], df.where(F.col(ROW).between(*rows))
            g = Grid(df.select((F.col(ROW) - low).alias(ROW), *self._cells(s), F.col("_mask")), len(s.columns), False)
        else:
            g, mask = self.grid(array).renumbered(), self.grid(include).renumbered()
            if mask.width != 1:
                raise ArrayError(VALUE)
            g = Grid(g.df.join(mask.df.select(ROW, F.col("c0").alias("_mask")), ROW), g.width, False)
        kind = dict(g.df.dtypes)["_mask"]
        if kind == "string":
            raise ArrayError(VALUE)
        kept = g.df.where(F.col("_mask") if kind == "boolean" else F.col("_mask") != 0).drop("_mask")
        none = kept.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
        kinds, first = dict(kept.dtypes), self.c.constant_of(spare) if spare is not None else None
        if spare is None:
            kept = kept if "c0_err" in kept.columns else kept.withColumn("c0_err", F.lit(None).cast("string"))
            made = {ROW: F.lit(0), "c0_err": F.lit(CALC)}
        else:
            made = {ROW: F.lit(0), "c0": F.lit(first)}
            if isinstance(first, str) and kinds["c0"] != "string":
                kept, kinds = kept.withColumn("c0", F.col("c0").cast("string")), {**kinds, "c0": "string"}
        kinds = dict(kept.dtypes) | {"c0": kinds["c0"]}
        return Grid(kept.unionByName(none.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kept.columns])), g.width, False)

    def sort(self, array, index=None, order=None, by_col=None) -> Grid:
        if by_col is not None and self.c.constant_of(by_col):
            raise ArrayError(VALUE)
        g, k, way = self.grid(array), int(self._number(index, 1)), self._number(order, 1)
        if not 1 <= k <= g.width or way not in (1, -1):
            raise ArrayError(VALUE)
        return Grid(arrays.sort_rows(g.df, f"c{k - 1}", way < 0), g.width, True)

    def unique(self, array, by_col=None, once=None) -> Grid:
        if by_col is not None and self.c.constant_of(by_col):
            raise ArrayError(VALUE)
        g = self.grid(array)
        return Grid(arrays.unique(g.df, g.cells(), bool(once is not None and self.c.constant_of(once))), g.width, False)

    def transpose(self, array) -> Grid:
        g = self.grid(array).renumbered()
        height = g.df.count()
        if not 0 < height <= MOST_COLUMNS:
            raise ArrayError(VALUE)
        kinds = {k for c, k in g.df.dtypes if c in g.cells()}
        text = "string" in kinds
        cells = F.array(*[F.col(c).cast("string" if text else "double") for c in g.cells()])
        long = g.df.select(F.col(ROW).alias("_r"), F.posexplode(cells).alias("_c", "_v"))
        wide = long.groupBy(F.col("_c").cast("long").alias(ROW)).agg(*[F.max(F.when(F.col("_r") == r, F.col("_v"))).alias(f"c{r}") for r in range(height)])
        return Grid(wide, height, True)

    def sequence(self, rows, cols=None, start=None, step=None) -> Grid:
        n, k = (int(self._number(x, 1)) for x in (rows, cols))
        spark = self.c.here.df.sparkSession
        return Grid(arrays.sequence(spark, n, k, self._number(start, 1), self._number(step, 1)), k, True)

    def take(self, array, rows=None, cols=None) -> Grid:
        return self._cut(array, rows, cols, True)

    def drop(self, array, rows=None, cols=None) -> Grid:
        return self._cut(array, rows, cols, False)

    def _cut(self, array, rows, cols, keep: bool) -> Grid:
        g = self.grid(array)
        n, k = (int(x) if x is not None else None for x in (self._number(rows, None), self._number(cols, None)))
        if n is not None:
            g = g.renumbered()
            g = Grid((arrays.take if keep else arrays.drop)(g.df, n), g.width, False)
        if k is not None:
            if k == 0:
                raise ArrayError(CALC)
            all_ = list(range(g.width))
            kept = (all_[:k] if k > 0 else all_[k:]) if keep else (all_[k:] if k > 0 else all_[:k])
            if not kept:
                raise ArrayError(CALC)
            g = self._columns(g, kept)
        return g

    def _columns(self, g: Grid, at: list[int]) -> Grid:
        return Grid(g.df.select(ROW, *_renamed(g.df, [f"c{i}" for i in at])), len(at), g.dense)

    def choosecols(self, array, *at) -> Grid:
        g, places = self.grid(array), [int(self._number(a, 0)) for a in at]
        if not places or any(p == 0 or abs(p) > g.width for p in places):
            raise ArrayError(VALUE)
        return self._columns(g, [p - 1 if p > 0 else g.width + p for p in places])

    def chooserows(self, array, *at) -> Grid:
        g = self.grid(array).renumbered()
        return Grid(arrays.choose_rows(g.df, [int(self._number(a, 0)) for a in at]), g.width, True)

    def _number(self, node, spare):
        if node is None or isinstance(node, tree.Literal) and node.value is None:
            return spare
        x = self.c.constant_of(node)
        if not isinstance(x, (int, float)) or isinstance(x, bool):
            raise ArrayError(VALUE)
        return x

    # uses

    def stacked(self, nodes: tuple) -> DataFrame:
        """All cells of the arguments in one column: n (numbers), f (not blank), e (errors)."""
        out = None
        for node in nodes:
            if isinstance(node, tree.Literal):
                value = self.c.constant_of(node)
                df = self.c.here.df.sparkSession.range(1).select(F.lit(float(value) if isinstance(value, (int, float)) else None).cast("double").alias("n"), F.lit(value is not None).alias("f"), F.lit(None).cast("string").alias("e"))
                out = df if out is None else out.unionByName(df)
                continue
            g = self.grid(node)
            kinds, cells = dict(g.df.dtypes), []
            for c in g.cells():
                err = F.col(f"{c}_err") if f"{c}_err" in g.df.columns else F.lit(None).cast("string")
                is_num = kinds[c] not in ("string", "boolean")
                cells.append(F.struct((F.col(c).cast("double") if is_num else F.lit(None).cast("double")).alias("n"), (F.col(c).isNotNull() | err.isNotNull()).alias("f"), err.alias("e")))
            df = g.df.select(F.explode(F.array(*cells)).alias("x")).select("x.n", "x.f", "x.e")
            out = df if out is None else out.unionByName(df)
        return out

    def spilled(self, node, name: str, base: int) -> tuple[DataFrame, list[str]]:
        """The array's rows from row `base` on; its columns are name, name_2, ..."""
        try:
            g = self.grid(node).renumbered()
        except ArrayError as e:
            df = self.c.here.df.sparkSession.range(1).select(F.lit(base).cast("long").alias(ROW), F.lit(None).cast("double").alias(name), F.lit(str(e)).alias(f"{name}_err"))
            return df, [name]
        names = [name if i == 0 else f"{name}_{i + 1}" for i in range(g.width)]
        cells = [F.col(f"c{i}{end}").alias(f"{n}{end}") for i, n in enumerate(names) for end in ("", "_err") if f"c{i}{end}" in g.df.columns]
        return g.df.select((F.col(ROW) + base).cast("long").alias(ROW), *cells), names


#: Formula name -> method.
BUILDERS = {n: n.lower() for n in ("FILTER", "SORT", "UNIQUE", "TRANSPOSE", "SEQUENCE", "TAKE", "DROP", "CHOOSECOLS", "CHOOSEROWS")}

__all__ = ["ArrayError", "Arrays", "Grid", "is_array"]
