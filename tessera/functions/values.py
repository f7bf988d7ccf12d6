"""Typed formula values as Spark columns: a value column and an error-code column, with coercions and comparison.

Errors travel beside the value as text sentinels. Where an error is impossible its column is None, so homogeneous
columns compile to plain arithmetic.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error sentinels.
CYCLE, DIV0, REF, NUM, VALUE, NAME, NA, SPILL, CALC, LOADING = "#CYCLE!", "#DIV/0!", "#REF!", "#NUM!", "#VALUE!", "#NAME?", "#N/A", "#SPILL!", "#CALC!", "#LOADING!"
ERRORS = (CYCLE, DIV0, REF, NUM, VALUE, NAME, NA, SPILL, CALC, LOADING)

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Val:
    """kind: num (double), text, bool or blank. src: what the value was read from, for aggregates and lookups."""

    kind: str
    col: Column
    err: Column | None = None
    const: object = None
    src: object = field(default=None, compare=False)


def num(col: Column, *errs: Column | None) -> Val:
    return Val("num", col, first_error(*errs))


def text(col: Column, *errs: Column | None) -> Val:
    return Val("text", col, first_error(*errs))


def boolean(col: Column, *errs: Column | None) -> Val:
    return Val("bool", col, first_error(*errs))


def blank() -> Val:
    return Val("blank", F.lit(None).cast("double"))


def error(code: str) -> Val:
    return Val("num", F.lit(None).cast("double"), F.lit(code))


def constant(x) -> Val:
    if x is None:
        return blank()
    if isinstance(x, bool):
        return Val("bool", F.lit(x), const=x)
    if isinstance(x, (int, float)):
        return Val("num", F.lit(float(x)), const=float(x))
    return Val("text", F.lit(str(x)), const=str(x))


def first_error(*errs: Column | None) -> Column | None:
    """The first error that is set; None if none can be."""
    some = [e for e in errs if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def when(cond: Column, code: str) -> Column:
    return F.when(cond, F.lit(code))


#: Where a formula is compiled, what makes an expression a column of its own; empty elsewhere.
_STAGES: list[Callable[[Column], Column]] = []
_LEAF = re.compile(r"Column<'(`?\w+`?|[-+\w.]*|CAST\(\w+ AS \w+\))'>")


@contextlib.contextmanager
def staged(keep: Callable[[Column], Column]):
    """Inside the block `bind` and `once` give what is used several times to `keep`, which makes it a column."""
    _STAGES.append(keep)
    try:
        yield
    finally:
        _STAGES.pop()


def once(col: Column) -> Column:
    """col as a column of its own, where that can be had."""
    return col if not _STAGES or _LEAF.fullmatch(str(col)) else _STAGES[-1](col)


def bind(col: Column, f: Callable[[Column], Column]) -> Column:
    """f(col) with col evaluated once however often f uses it: expressions are trees, so plain reuse multiplies them.

    Outside a formula's compilation an array of one value stands in, which Spark only interprets.
    """
    if _STAGES:
        return f(once(col))
    return F.get(F.transform(F.array(col), f), F.lit(0))


def finite(col: Column, *errs: Column | None) -> Val:
    """A number whose infinities and NaN become #NUM!."""
    col = once(col)
    bad = F.isnan(col) | (F.abs(col) == float("inf"))
    return Val("num", F.when(~bad, col), first_error(*errs, when(bad, NUM)))


def settled(v: Val) -> Val:
    """The value is null wherever the error is set."""
    if v.err is None:
        return v
    err = once(v.err)
    return Val(v.kind, F.when(err.isNull(), v.col), err, src=v.src)


def to_num(v: Val) -> Val:
    if v.kind == "num":
        return Val("num", F.coalesce(v.col, F.lit(0.0)) if v.err is None else F.when(v.err.isNull(), F.coalesce(v.col, F.lit(0.0))), v.err, v.const)
    if v.kind == "bool":
        return Val("num", F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err)
    if v.kind == "blank":
        return Val("num", F.lit(0.0), v.err, 0.0)
    value = bind(F.trim(F.coalesce(v.col, F.lit(""))), lambda t: F.when(t == "", F.lit(0.0)).when(t.rlike(NUMERIC), t.try_cast("double")))
    return finite(value, v.err, when(value.isNull(), VALUE))


def to_bool(v: Val) -> Val:
    if v.kind == "bool":
        return Val("bool", F.coalesce(v.col, F.lit(False)), v.err)
    if v.kind == "num":
        return Val("bool", F.coalesce(v.col != 0, F.lit(False)), v.err)
    if v.kind == "blank":
        return Val("bool", F.lit(False), v.err)
    up = F.upper(v.col)
    return boolean(F.coalesce(up == "TRUE", F.lit(False)), v.err, when(v.col.isNotNull() & ~up.isin("TRUE", "FALSE"), VALUE))


def number_text(c: Column) -> Column:
    """The shortest decimal that reads back as the number, never with an exponent, integers without a point."""
    def parts(s: Column) -> Column:
        mantissa = F.substring_index(s, "E", 1)
        frac = F.substring_index(mantissa, ".", -1)
        exp = F.when(F.instr(s, "E") > 0, F.substring_index(s, "E", -1).try_cast("int")).otherwise(F.lit(0))
        return F.struct(F.substring_index(mantissa, ".", 1).alias("whole"), F.when(frac == "0", F.lit("")).otherwise(frac).alias("frac"), exp.alias("exp"))

    def joined(p: Column) -> Column:
        grown = F.rpad(p["frac"], F.greatest(p["exp"], F.length(p["frac"])), "0")
        large = F.concat(p["whole"], F.substring(grown, F.lit(1), p["exp"]), F.when(F.length(grown) > p["exp"], F.concat(F.lit("."), F.substring(grown, p["exp"] + 1, F.length(grown)))).otherwise(F.lit("")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -p["exp"] - 1)), p["whole"], p["frac"])
        return F.when(p["exp"] < 0, small).otherwise(large)

    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), bind(bind(F.abs(c).cast("string"), parts), joined))


def to_text(v: Val) -> Val:
    if v.kind == "text":
        return Val("text", F.coalesce(v.col, F.lit("")), v.err, v.const)
    if v.kind == "blank":
        return Val("text", F.lit(""), v.err, "")
    if v.kind == "bool":
        return Val("text", F.coalesce(F.when(v.col, F.lit("TRUE")).when(~v.col, F.lit("FALSE")), F.lit("")), v.err)
    return Val("text", F.coalesce(number_text(v.col), F.lit("")), v.err)


_RANK = {"num": 1, "text": 2, "bool": 3}


def compare(op: str, a: Val, b: Val) -> Val:
    """Formula comparison: text ignores case; unlike kinds rank number < text < bool; a blank takes the other's kind."""
    do: dict[str, Callable] = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    ka, kb = a.kind, b.kind
    if ka == "blank" and kb == "blank":
        return boolean(F.lit(op in ("=", "<=", ">=")), a.err, b.err)
    ka, kb = (kb if ka == "blank" else ka), (ka if kb == "blank" else kb)
    if ka != kb:
        # a null cell of a typed column is blank and compares as the other side's empty value
        same = do[op](F.lit(_RANK[ka]), F.lit(_RANK[kb]))
        empty_a = do[op](_empty(kb), _key(b, kb)) if a.kind != "blank" else None
        empty_b = do[op](_key(a, ka), _empty(ka)) if b.kind != "blank" else None
        out = F.when(a.col.isNull(), empty_a).when(b.col.isNull(), empty_b).otherwise(same)
        return boolean(out, a.err, b.err)
    return boolean(do[op](_key(a, ka), _key(b, kb)), a.err, b.err)


def _empty(kind: str) -> Column:
    return {"num": F.lit(0.0), "text": F.lit(""), "bool": F.lit(False)}[kind]


def _key(v: Val, kind: str) -> Column:
    if v.kind == "blank":
        return _empty(kind)
    return F.coalesce(F.lower(v.col) if kind == "text" else v.col, _empty(kind))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    x, y = to_num(a), to_num(b)
    if op == "/":
        zero = y.col == 0
        return settled(finite(F.try_divide(x.col, F.when(~zero, y.col)), x.err, y.err, when(zero, DIV0)))
    if op == "^":
        zero = (x.col == 0) & (y.col < 0)
        return settled(finite(F.when(~zero, F.pow(x.col, y.col)), x.err, y.err, when(zero, DIV0)))
    made = {"+": lambda: x.col + y.col, "-": lambda: x.col - y.col, "*": lambda: x.col * y.col}[op]()
    return settled(finite(made, x.err, y.err))


def concat(a: Val, b: Val) -> Val:
    x, y = to_text(a), to_text(b)
    return text(F.concat(x.col, y.col), x.err, y.err)
