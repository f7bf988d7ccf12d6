"""Aggregates over a range: numbers count, text, booleans and blanks in ranges don't, errors win."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.finance import irr_of
from ..functions.values import DIV0, NA, NUM, Val, finite, first_error, num, when


def numbers(v: Val) -> Column:
    """The cells that count; null for the others."""
    return v.col if v.kind == "num" else F.lit(None).cast("double")


def non_blank(v: Val) -> Column:
    return v.col.isNotNull() if v.err is None else v.col.isNotNull() | v.err.isNotNull()


def _moment(f: Callable[[Column], Column], least: int):
    def build(x: Column) -> Val:
        few = F.count(x) < least
        return num(F.when(~few, f(x)), when(few, DIV0))

    return build


def _geomean(x: Column) -> Val:
    bad = (F.count(x) == 0) | F.coalesce(F.min(x) <= 0, F.lit(False))
    return num(F.when(~bad, F.exp(F.avg(F.ln(F.when(x > 0, x))))), when(bad, NUM))


def _folded(x: Column, lcm: bool) -> Column:
    """GCD or LCM of the distinct values; Euclid's steps as an inner fold."""
    values = F.array_sort(F.collect_set(F.floor(F.abs(x)).cast("long")))

    def gcd(a, b):
        start = F.struct(a.alias("a"), b.alias("b"))
        steps = F.sequence(F.lit(1), F.lit(93))
        return F.aggregate(steps, start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))))["a"]

    zero = F.lit(0).cast("long")
    if lcm:
        return F.aggregate(values, F.lit(1).cast("long"), lambda acc, v: F.when((acc == 0) | (v == 0), zero).otherwise(acc / gcd(acc, v) * v).cast("long")).cast("double")
    return F.aggregate(values, zero, gcd).cast("double")


def _common_divisor(x: Column, lcm: bool) -> Val:
    bad = F.coalesce(F.min(x) < 0, F.lit(False))
    return num(F.when(~bad, _folded(x, lcm)), when(bad, NUM))


#: Range aggregates by name, over the numbers of one range.
NUMERIC: dict[str, Callable[[Column], Val]] = {
    "SUM": lambda x: finite(F.coalesce(F.sum(x), F.lit(0.0))),
    "AVERAGE": lambda x: num(F.avg(x), when(F.count(x) == 0, DIV0)),
    "MIN": lambda x: num(F.coalesce(F.min(x), F.lit(0.0))),
    "MAX": lambda x: num(F.coalesce(F.max(x), F.lit(0.0))),
    "COUNT": lambda x: num(F.count(x).cast("double")),
    "PRODUCT": lambda x: finite(F.when(F.count(x) == 0, 0.0).otherwise(F.product(x))),
    "MEDIAN": lambda x: num(F.coalesce(F.median(x), F.lit(0.0))),
    "STDEV.S": _moment(F.stddev_samp, 2),
    "STDEV.P": _moment(F.stddev_pop, 1),
    "VAR.S": _moment(F.var_samp, 2),
    "VAR.P": _moment(F.var_pop, 1),
    "GEOMEAN": _geomean,
    "GCD": lambda x: _common_divisor(x, lcm=False),
    "LCM": lambda x: _common_divisor(x, lcm=True),
}
NUMERIC["AVG"] = NUMERIC["AVERAGE"]

#: What the codes of SUBTOTAL stand for.
SUBTOTAL = ("AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV.S", "STDEV.P", "SUM", "VAR.S", "VAR.P")


def aggregate(name: str, v: Val, where: Column | None = None) -> Val:
    """One range aggregate as an aggregate expression, over the rows that `where` admits."""
    pick = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    err = None if v.err is None else F.first(pick(v.err), ignorenulls=True)
    if name == "COUNTA":
        out = num(F.count(pick(F.when(non_blank(v), F.lit(1)))).cast("double"))
    elif name == "COUNTBLANK":
        empty = v.col.isNull() | (v.col == "") if v.kind == "text" else v.col.isNull()
        out = num(F.count(pick(F.when(empty, F.lit(1)))).cast("double"))
    elif name in ("AND", "OR", "XOR"):
        from ..functions.values import to_bool

        b = to_bool(v)
        some = pick(b.col)
        made = {"AND": F.coalesce(F.bool_and(some), F.lit(True)), "OR": F.coalesce(F.bool_or(some), F.lit(False)), "XOR": F.coalesce(F.sum(some.cast("int")) % 2 == 1, F.lit(False))}[name]
        out = Val("bool", made)
    else:
        out = NUMERIC[name](pick(numbers(v)))
    return Val(out.kind, out.col, first_error(err, out.err))


def percentile(v: Val, p: float) -> Val:
    x = numbers(v)
    if not 0 <= p <= 1:
        return num(F.first(F.lit(None).cast("double")), F.first(F.lit(NUM)))
    return num(F.percentile(x, p), when(F.count(x) == 0, NUM))


def sumproduct(*vs: Val) -> Val:
    out = F.lit(1.0)
    for v in vs:
        out = out * F.coalesce(numbers(v), F.lit(0.0))
    return finite(F.coalesce(F.sum(out), F.lit(0.0)))


def paired(name: str, a: Val, b: Val) -> Val:
    """CORREL and the covariances: only rows with two numbers count."""
    both = numbers(a).isNotNull() & numbers(b).isNotNull()
    x, y = F.when(both, numbers(a)), F.when(both, numbers(b))
    n = F.count(x)
    if name == "CORREL":
        flat = (n < 1) | (F.var_pop(x) == 0) | (F.var_pop(y) == 0)
        return num(F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(x, y)))), when(flat, DIV0))
    least, f = (2, F.covar_samp) if name == "COVARIANCE.S" else (1, F.covar_pop)
    return num(F.when(n >= least, f(x, y)), when(n < least, DIV0))


def npv(v: Val, rate: float, position: Column) -> Val:
    """NPV of a column whose numbers are numbered from 1 by `position`."""
    return finite(F.coalesce(F.sum(numbers(v) / F.pow(F.lit(1.0 + rate), position)), F.lit(0.0)))


def irr_frame(flows: pd.DataFrame, guess: float = 0.1) -> float:
    """IRR of one group's flows (columns period, cf), for applyInPandas."""
    return irr_of(flows.sort_values("period").cf.tolist(), guess)


__all__ = ["NA", "aggregate", "irr_frame", "npv", "paired", "percentile", "sumproduct"]
