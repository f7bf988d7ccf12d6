"""Logic, information and control flow. Branches are `when` chains, so only the chosen one counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import MOST, raw_function
from .values import NA, VALUE, Val, boolean, compare, constant, error, first_error, num, text, to_bool, to_num, to_text, when


def align(vals: list[Val]) -> list[Val]:
    """Bring branches to one kind: blanks follow, unlike kinds become text."""
    kinds = {v.kind for v in vals} - {"blank"}
    if not kinds:
        return vals
    kind = kinds.pop() if len(kinds) == 1 else "text"
    to = {"num": to_num, "bool": to_bool, "text": to_text}[kind]
    return [v if v.kind == kind else to(v) for v in vals]


def choose(cases: list[tuple[Column, Val]], last: Val, cond_err: Column | None = None) -> Val:
    """The value (and error) of the first case that holds."""
    vals = align([v for _, v in cases] + [last])
    col = err = None
    for (c, _), v in zip(cases, vals):
        e = v.err if v.err is not None else F.lit(None).cast("string")
        col, err = (F.when(c, v.col), F.when(c, e)) if col is None else (col.when(c, v.col), err.when(c, e))
    tail = vals[-1]
    err = err.otherwise(tail.err if tail.err is not None else F.lit(None).cast("string"))
    kind = next((v.kind for v in vals if v.kind != "blank"), "num")
    may = cond_err is not None or any(v.err is not None for v in vals)
    return Val(kind, col.otherwise(tail.col), first_error(cond_err, err) if may else None)


@raw_function("IF", 2, 3)
def _if(cond: Val, yes: Val, no: Val | None = None) -> Val:
    c = to_bool(cond)
    return choose([(c.col, yes)], constant(0) if no is None else no, c.err)


def _recover(v: Val, spare: Val, caught: Column | None) -> Val:
    if caught is None:
        return v
    return choose([(F.coalesce(caught, F.lit(False)), spare)], v)


raw_function("IFERROR", 1, 2)(lambda v, spare=None: _recover(v, constant(0) if spare is None else spare, None if v.err is None else v.err.isNotNull()))
raw_function("IFNA", 2)(lambda v, spare: _recover(v, spare, None if v.err is None else v.err == NA))


@raw_function("IFS", 2, MOST)
def _ifs(*args: Val) -> Val:
    if len(args) % 2:
        return error(VALUE)
    conds = [to_bool(a) for a in args[::2]]
    return choose([(c.col, v) for c, v in zip(conds, args[1::2])], error(NA), first_error(*[c.err for c in conds]))


@raw_function("SWITCH", 3, MOST)
def _switch(key: Val, *rest: Val) -> Val:
    pairs = list(zip(rest[::2], rest[1::2]))
    last = rest[-1] if len(rest) % 2 else error(NA)
    return choose([(compare("=", key, k).col, v) for k, v in pairs], last, key.err)


@raw_function("CHOOSE", 2, MOST)
def _choose(at: Val, *options: Val) -> Val:
    i = to_num(at)
    k = F.floor(i.col)
    return choose([(k == n + 1, v) for n, v in enumerate(options)], error(VALUE), i.err)


def _fold(args: tuple[Val, ...], how) -> Val:
    got = [to_bool(a) for a in args]
    out = got[0].col
    for g in got[1:]:
        out = how(out, g.col)
    return boolean(out, *[g.err for g in got])


raw_function("AND", 0, MOST)(lambda *a: _fold(a, lambda x, y: x & y) if a else constant(True))
raw_function("OR", 0, MOST)(lambda *a: _fold(a, lambda x, y: x | y) if a else constant(False))
raw_function("XOR", 0, MOST)(lambda *a: _fold(a, lambda x, y: x != y) if a else error(VALUE))


@raw_function("NOT", 1)
def _not(v: Val) -> Val:
    b = to_bool(v)
    return boolean(~b.col, b.err)


raw_function("TRUE", 0)(lambda: constant(True))
raw_function("FALSE", 0)(lambda: constant(False))
raw_function("NA", 0)(lambda: error(NA))


def _no_error(v: Val) -> Column:
    return F.lit(True) if v.err is None else v.err.isNull()


def _is_kind(kind: str):
    return lambda v: boolean(_no_error(v) & v.col.isNotNull() if v.kind == kind else F.lit(False))


raw_function("ISNUMBER", 1)(_is_kind("num"))
raw_function("ISTEXT", 1)(_is_kind("text"))
raw_function("ISLOGICAL", 1)(_is_kind("bool"))
raw_function("ISBLANK", 1)(lambda v: boolean(F.lit(True) if v.kind == "blank" else _no_error(v) & v.col.isNull()))
raw_function("ISERROR", 1)(lambda v: boolean(~_no_error(v)))
raw_function("ISNA", 1)(lambda v: boolean(F.lit(False) if v.err is None else F.coalesce(v.err == NA, F.lit(False))))
raw_function("ISERR", 1)(lambda v: boolean(F.lit(False) if v.err is None else F.coalesce(v.err != NA, F.lit(False))))


@raw_function("TYPE", 1)
def _type(v: Val) -> Val:
    #: The type codes.
    code = {"num": 1.0, "blank": 1.0, "text": 2.0, "bool": 4.0}[v.kind]
    plain = F.when(v.col.isNull(), 1.0).otherwise(code)
    return num(plain if v.err is None else F.when(v.err.isNotNull(), 16.0).otherwise(plain))


@raw_function("N", 1)
def _n(v: Val) -> Val:
    return num(F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err) if v.kind in ("num", "bool") else num(F.lit(0.0), v.err)


@raw_function("T", 1)
def _t(v: Val) -> Val:
    return text(F.coalesce(v.col, F.lit("")) if v.kind == "text" else F.lit(""), v.err)


__all__ = ["choose", "when"]
