"""Views over a sheet: filters, hidden rows, collapsed groups, sorts, distinct values, search, edges, formats, checks.

A view is a lazy plan: filters become `where`, sorts `orderBy`; nothing runs until an action.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import number_text
from ..plans.rows import ROW
from .ordering import view_order


def shown(df: DataFrame, col: str) -> Column:
    """A cell's text: numbers in shortest form, booleans as TRUE and FALSE; null where empty."""
    kind = dict(df.dtypes)[col]
    c = F.col(f"`{col}`")
    if kind == "string":
        return c
    if kind == "boolean":
        return F.when(c, F.lit("TRUE")).when(~c, F.lit("FALSE"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("string")
    return F.when(c.isNotNull(), number_text(c.cast("double")))


@dataclass(frozen=True)
class Contains:
    text: str
    match_case: bool = False

    def predicate(self, df: DataFrame, col: str) -> Column:
        s = shown(df, col)
        hit = s.contains(self.text) if self.match_case else F.instr(F.lower(s), F.lit(self.text.lower())) > 0 if self.text else s.isNotNull()
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Values:
    """Membership in a typed set; None stands for empty cells."""

    values: tuple

    def predicate(self, df: DataFrame, col: str) -> Column:
        kind, c = dict(df.dtypes)[col], F.col(f"`{col}`")
        fits = {"string": str, "boolean": bool}.get(kind, (int, float))
        some = [v for v in self.values if v is not None and isinstance(v, fits) and not (fits == (int, float) and isinstance(v, bool))]
        hit = F.coalesce(c.isin(some), F.lit(False)) if some else F.lit(False)
        return hit | c.isNull() if None in self.values else hit


@dataclass(frozen=True)
class Compare:
    """gt, gte, lt, lte, eq, neq on numbers; any other cell fails, under neq too."""

    op: str
    value: float

    def predicate(self, df: DataFrame, col: str) -> Column:
        if dict(df.dtypes)[col] in ("string", "boolean"):
            return F.lit(False)
        c = F.col(f"`{col}`")
        hit = {"gt": c > self.value, "gte": c >= self.value, "lt": c < self.value, "lte": c <= self.value, "eq": c == self.value, "neq": c != self.value}[self.op]
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Empty:
    def predicate(self, df: DataFrame, col: str) -> Column:
        return F.col(f"`{col}`").isNull()


@dataclass(frozen=True)
class NonEmpty:
    def predicate(self, df: DataFrame, col: str) -> Column:
        return F.col(f"`{col}`").isNotNull()


@dataclass(frozen=True)
class View:
    """Filters by column (all must hold), sort keys (column, descending), hidden rows, collapsed row ranges."""

    filters: dict = field(default_factory=dict)
    sort: tuple[tuple[str, bool], ...] = ()
    hidden: tuple[int, ...] = ()
    collapsed: tuple[tuple[int, int], ...] = ()

    def cleared(self) -> View:
        """Without sort and filters; hidden rows and groups stay."""
        return View(hidden=self.hidden, collapsed=self.collapsed)

    def rows(self, df: DataFrame) -> DataFrame:
        out = df
        for col, f in self.filters.items():
            out = out.where(f.predicate(df, col))
        if self.hidden:
            out = out.where(~F.col(ROW).isin(list(self.hidden)))
        for a, b in self.collapsed:
            out = out.where(~F.col(ROW).between(a, b))
        return out

    def order(self) -> list[Column]:
        return [view_order(F.col(f"`{c}`"), desc) for c, desc in self.sort] + [F.col(ROW).asc()]

    def plan(self, df: DataFrame) -> DataFrame:
        return self.rows(df).orderBy(*self.order())

    def count(self, df: DataFrame) -> DataFrame:
        return self.rows(df).agg(F.count(F.lit(1)).alias("view_rows"))

    def positions(self, df: DataFrame) -> DataFrame:
        """The rows with their zero-based place in the view (_view); all columns are sorted and written, so select first."""
        from ..plans.rows import number_rows

        return number_rows(self.rows(df).withColumnRenamed(ROW, "_data"), *[view_order(F.col(f"`{c}`"), d) for c, d in self.sort], F.col("_data").asc()).withColumnRenamed(ROW, "_view").withColumnRenamed("_data", ROW)


def hide_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Drop the rows listed in a table of _row, however many."""
    return df.join(rows.select(ROW).distinct(), ROW, "left_anti")


def column_aggregate(df: DataFrame, col: str, *ops: str) -> DataFrame:
    """sum, avg, min, max, count over all numeric cells; 0 where there are none."""
    c = F.col(f"`{col}`")
    made = {"sum": F.sum(c), "avg": F.avg(c), "min": F.min(c), "max": F.max(c), "count": F.count(c)}
    return df.agg(*[F.coalesce(made[o].cast("double"), F.lit(0.0)).alias(f"{o}_value") for o in ops])


def distinct_values(df: DataFrame, col: str, limit: int = 1000) -> DataFrame:
    """Distinct values (blank once) in order of first appearance, with that row; limit 0 lists all."""
    out = df.groupBy(F.col(f"`{col}`").alias("value")).agg(F.min(ROW).alias("first_row")).orderBy("first_row")
    return out.limit(limit) if limit else out


def search(df: DataFrame, text: str, columns: Sequence[str], match_case: bool = False, whole: bool = False) -> DataFrame:
    """(_row, col) of matching cells; an empty query finds none."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), shown(df, c).alias("s")) for i, c in enumerate(columns)])
    out = df.select(ROW, F.inline(cells))
    s, t = (F.col("s"), text) if match_case else (F.lower("s"), text.lower())
    hit = F.lit(False) if not text else s == t if whole else F.instr(s, F.lit(t)) > 0
    return out.where(hit).select(ROW, "col").orderBy(ROW, "col")


def replace_text(df: DataFrame, col: str, find: str, new: str, match_case: bool = False, whole: bool = False) -> DataFrame:
    """Replace in one column, all occurrences or whole cells; the result is read again as the column's type.

    Cells of other types are searched by their text; where the replaced text is none of the type, the cell stays.
    """
    import re

    kind = dict(df.dtypes)[col]
    if kind != "string":
        read = {"boolean": lambda c: F.when(F.upper(c).isin("TRUE", "FALSE"), F.upper(c) == "TRUE")}.get(kind, lambda c: F.trim(c).try_cast(kind))
        made = replace_text(df.withColumn("_text", shown(df, col)), "_text", find, new, match_case, whole)
        return made.withColumn(col, F.when(F.col("_text").eqNullSafe(shown(df, col)), F.col(f"`{col}`")).otherwise(F.coalesce(read(F.col("_text")), F.col(f"`{col}`")))).drop("_text")
    c = F.col(f"`{col}`")
    if whole:
        same = c == find if match_case else F.lower(c) == find.lower()
        return df.withColumn(col, F.when(same, F.lit(new)).otherwise(c))
    pattern = ("" if match_case else "(?i)") + "".join("\\" + x if x in r"\.[]{}()*+?^$|" else x for x in find)
    return df.withColumn(col, F.regexp_replace(c, pattern, re.sub(r"([\\$])", r"\\\1", new))) if find else df


def data_edges(df: DataFrame, col: str, up: bool = False) -> DataFrame:
    """Where a jump down (or up) from each row lands: the end of its run of filled cells, else the next filled one, else the last row."""
    if up:  # the same in a sheet that stands on its head
        last = F.broadcast(df.agg(F.max(ROW).alias("_last")))
        turned = df.join(last, how="cross").withColumn(ROW, F.col("_last") - F.col(ROW))
        return data_edges(turned, col).join(last, how="cross").select((F.col("_last") - F.col(ROW)).alias(ROW), (F.col("_last") - F.col("edge")).alias("edge"))
    filled = F.when(F.col(f"`{col}`").isNotNull(), 1).otherwise(0)
    b = F.floor(F.col(ROW) / (1 << 16))
    base = df.select(ROW, filled.alias("f"), b.alias("b"))
    ends = base.groupBy("b").agg(F.min(F.when(F.col("f") == 0, F.col(ROW))).alias("e0"), F.min(F.when(F.col("f") == 1, F.col(ROW))).alias("e1"), F.max(ROW).alias("last"))
    # from the last row up: Spark folds such a frame once, but one that ends at the last row anew for every row
    after = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = ends.select("b", F.min("e0").over(after).alias("l0"), F.min("e1").over(after).alias("l1"), F.max("last").over(Window.partitionBy()).alias("end"))
    inside = Window.partitionBy("b").orderBy(F.col(ROW).desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = base.withColumn("n0", F.min(F.when(F.col("f") == 0, F.col(ROW))).over(inside)).withColumn("n1", F.min(F.when(F.col("f") == 1, F.col(ROW))).over(inside)).join(later, "b")
    gap, full = F.coalesce("n0", "l0"), F.coalesce("n1", "l1")
    run_end = F.coalesce(gap - 1, F.col("end"))
    return j.select(ROW, F.when((F.col("f") == 1) & (run_end > F.col(ROW)), run_end).otherwise(F.coalesce(full, F.col("end"))).alias("edge"))


def row_edges(df: DataFrame, columns: Sequence[str], at: int, left: bool = False) -> DataFrame:
    """Where a jump to the right (or left) from column `at` of each row lands, by the same rule: (_row, edge)."""
    order = list(range(at, -1, -1)) if left else list(range(at, len(columns)))
    full = [F.col(f"`{columns[i]}`").isNotNull() for i in order]
    end = F.lit(order[-1])

    def first(where: list[Column], result: list[Column], spare: Column) -> Column:
        out = None
        for w, x in zip(where, result):
            out = F.when(w, x) if out is None else out.when(w, x)
        return spare if out is None else out.otherwise(spare)

    run_end = first([~f for f in full[1:]], [F.lit(i) for i in order[:-1]], end)
    after = first(full[1:], [F.lit(i) for i in order[1:]], end)
    return df.select(ROW, F.when(full[0] & (run_end != at), run_end).otherwise(after).cast("int").alias("edge"))


@dataclass(frozen=True)
class FormatRule:
    predicate: Column
    stop: bool = False


def format_mask(df: DataFrame, rules: Sequence[FormatRule], name: str = "mask") -> DataFrame:
    """Bit i is set where rule i holds and no earlier stopping rule did; at most 32 rules."""
    if len(rules) > 32:
        raise ValueError("at most 32 rules")
    mask, open_ = F.lit(0).cast("long"), F.lit(True)
    for i, r in enumerate(rules):
        hit = F.coalesce(r.predicate, F.lit(False)) & open_
        mask = mask + F.when(hit, F.lit(1 << i)).otherwise(F.lit(0))
        open_ = open_ & ~hit if r.stop else open_
    return df.withColumn(name, mask)


def validation(df: DataFrame, col: str, kind: str, allow_blank: bool = True, options: Sequence = (), op: str = "between", low: float | None = None, high: float | None = None, integer: bool = False) -> Column:
    """Whether a cell passes a rule: list, number, date, textLength (UTF-16 units) or checkbox."""
    c, dtype = F.col(f"`{col}`"), dict(df.dtypes)[col]
    if kind == "list":
        ok = c.isin(list(options))
    elif kind == "checkbox":
        ok = F.lit(dtype == "boolean") & c.isNotNull()
    else:
        if kind == "textLength":
            x = F.octet_length(F.encode(shown(df, col), "UTF-16BE")) / 2
        elif kind == "date" and dtype in ("date", "timestamp", "timestamp_ntz"):
            from ..functions.dates import serial_of

            x = serial_of(c)
        else:
            x = c.cast("double") if dtype not in ("string", "boolean") else F.lit(None).cast("double")
        ok = {"between": lambda: x.between(low, high), "notBetween": lambda: ~x.between(low, high), "eq": lambda: x == low, "neq": lambda: x != low, "gt": lambda: x > low, "gte": lambda: x >= low, "lt": lambda: x < low, "lte": lambda: x <= low}[op]()
        if integer:
            ok = ok & (x == F.floor(x))
    ok = F.coalesce(ok, F.lit(False))
    return ok | c.isNull() if allow_blank else ok & c.isNotNull()


def validated(df: DataFrame, check: Column, mode: str = "partial") -> tuple[DataFrame, DataFrame]:
    """(kept, refused) rows. partial keeps those that pass; atomic keeps none if any fails."""
    marked = df.withColumn("_ok", check)
    if mode == "atomic":
        fails = marked.agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("_all"))
        kept = marked.join(F.broadcast(fails.where("_all")), how="cross")
        return kept.drop("_ok", "_all"), marked.where("not _ok").drop("_ok")
    return marked.where("_ok").drop("_ok"), marked.where("not _ok").drop("_ok")


@dataclass(frozen=True)
class ProtectedRange:
    """A block of cells (rows and columns, both ends included) that edits may not touch unless they are let through."""

    name: str
    first_row: int
    last_row: int
    first_col: int
    last_col: int


def protected(edits: DataFrame, ranges: Sequence[ProtectedRange], allowed: Sequence[str] = (), mode: str = "partial") -> tuple[DataFrame, DataFrame]:
    """(kept, refused) edits; each covers first_row..last_row and first_col..last_col.

    Refused ones say which protected ranges (in `denied`) they touch without being allowed to. partial keeps the
    others, atomic keeps none if any is refused.
    """
    c = F.col
    hit = [F.when((c("first_row") <= r.last_row) & (c("last_row") >= r.first_row) & (c("first_col") <= r.last_col) & (c("last_col") >= r.first_col), F.lit(r.name)) for r in ranges if r.name not in allowed]
    marked = edits.withColumn("denied", F.array_compact(F.array(*hit)) if hit else F.expr("cast(array() as array<string>)"))
    refused = marked.where(F.size("denied") > 0)
    kept = marked.where(F.size("denied") == 0).drop("denied")
    if mode == "atomic":
        none = refused.agg((F.count(F.lit(1)) == 0).alias("_clean"))
        kept = kept.join(F.broadcast(none.where("_clean")), how="cross").drop("_clean")
    return kept, refused


def fill_series(seed: Sequence[float | None], count: int, df: DataFrame) -> Column:
    """Extend a seed over rows after it: arithmetic if its steps agree, else repeated."""
    n = len(seed)
    steps = [b - a for a, b in zip(seed, seed[1:])] if all(x is not None for x in seed) else []
    place, near = F.col(ROW), 1e-9 * max([1.0, *[abs(x) for x in seed if x is not None]])
    if n > 1 and steps and all(abs(s - steps[0]) <= near for s in steps):
        return F.lit(float(seed[0])) + F.lit(float(steps[0])) * place
    return F.get(F.array(*[F.lit(x).cast("double") for x in seed]), (place % n).cast("int"))
