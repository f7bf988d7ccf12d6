"""Annuities in closed form; IRR and RATE by a vectorised solver in pandas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import MOST, number_function, raw_function
from .values import DIV0, NUM, Val, bind, constant, error, finite, first_error, num, settled, to_num, when


def _terms(rate: Column, n: Column) -> Column:
    """(g, a): growth (1 + rate) ** n and the sum of its lower powers; null growth where there is none."""
    def growth(p: Column) -> Column:
        base = 1 + p["r"]
        negative = F.when(p["n"] == F.floor(p["n"]), F.pow(F.abs(base), p["n"]) * F.when(F.pmod(p["n"], F.lit(2.0)) == 0, 1.0).otherwise(-1.0))
        at_zero = F.when(p["n"] > 0, 0.0).when(p["n"] == 0, 1.0)
        log = F.when(base > 0, p["n"] * F.log1p(p["r"]))
        g = F.when(p["r"] == 0, 1.0).when(base > 0, F.exp(log)).when(base == 0, at_zero).otherwise(negative)
        return F.struct(p["r"].alias("r"), p["n"].alias("n"), log.alias("log"), g.alias("g"))

    def both(p: Column) -> Column:
        safe = F.when(p["r"] != 0, p["r"])
        annuity = F.when(p["r"] == 0, p["n"]).when(p["r"] > -1, F.expm1(p["log"]) / safe).otherwise((p["g"] - 1) / safe)
        return F.struct(F.when(~F.isnan(p["g"]) & (p["g"] != float("inf")), p["g"]).alias("g"), annuity.alias("a"))

    return bind(bind(F.struct(rate.alias("r"), n.alias("n")), growth), both)


def _due(rate: Column, kind: Column) -> Column:
    return F.when(kind != 0, 1 + rate).otherwise(1.0)


def _zero(c: Column | None) -> Column:
    return F.lit(0.0) if c is None else c


def _judged(terms: Column, value: Callable[[Column], Column], zero: Callable[[Column], Column] | None = None) -> Val:
    """A value of the terms; no growth is #NUM!, and a vanishing `zero` #DIV/0!."""
    def pair(t: Column) -> Column:
        err = F.when(t["g"].isNull(), F.lit(NUM))
        err = err if zero is None else err.when(zero(t) == 0, F.lit(DIV0))
        return F.struct(value(t).alias("v"), err.alias("e"))

    both = bind(terms, pair)
    return finite(both["v"], both["e"])


@number_function("PV", 3, 5)
def _pv(rate, n, pmt, fv=None, kind=None) -> Val:
    return _judged(_terms(rate, n), lambda t: -(_zero(fv) + pmt * _due(rate, _zero(kind)) * t["a"]) / F.when(t["g"] != 0, t["g"]), lambda t: t["g"])


def _fv_of(t: Column, rate, pmt, pv, kind) -> Column:
    return -(pv * t["g"] + pmt * _due(rate, kind) * t["a"])


def _pmt_of(t: Column, rate, pv, fv, kind) -> Column:
    below = _due(rate, kind) * t["a"]
    return -(fv + pv * t["g"]) / F.when(below != 0, below)


@number_function("FV", 3, 5)
def _fv(rate, n, pmt, pv=None, kind=None) -> Val:
    return _judged(_terms(rate, n), lambda t: _fv_of(t, rate, pmt, _zero(pv), _zero(kind)))


@number_function("PMT", 3, 5)
def _pmt(rate, n, pv, fv=None, kind=None) -> Val:
    return _judged(_terms(rate, n), lambda t: _pmt_of(t, rate, pv, _zero(fv), _zero(kind)), lambda t: t["a"])


def _share(rate, per, n, pv, fv, kind, principal: bool) -> Val:
    """Interest of one period, or what the payment leaves for the principal."""
    fv, kind = _zero(fv), _zero(kind)
    due = kind != 0
    outside = (per < 1) | (per > n) | (n < 1)

    def value(t: Column) -> Column:
        def interest(pay: Column) -> Column:
            owed = bind(_terms(rate, per - 1), lambda u: _fv_of(u, rate, pay, pv, kind))
            part = F.when(due & (per == 1), 0.0).otherwise(owed * rate / F.when(due, F.when(rate != -1, 1 + rate)).otherwise(1.0))
            return pay - part if principal else part

        return bind(_pmt_of(t, rate, pv, fv, kind), interest)

    out = _judged(_terms(rate, n), value, lambda t: t["a"])
    return num(out.col, when(outside, NUM), out.err)


number_function("IPMT", 4, 6)(lambda rate, per, n, pv, fv=None, kind=None: _share(rate, per, n, pv, fv, kind, False))
number_function("PPMT", 4, 6)(lambda rate, per, n, pv, fv=None, kind=None: _share(rate, per, n, pv, fv, kind, True))


#: Fixed values of the search for a rate: the first step, how often it doubles, the ends of the search, and what counts
#: as zero beside the scale of a value: at the guess, at a root, and at the best point found.
FIRST_STEP, WIDENINGS, ENDS = 0.125, 14, (-36.0, 700.0)
AT_GUESS, AT_ROOT, AT_BEST = 1e-12, 1e-14, 1e-9
HALVINGS = 200


def _bracket(f: Callable, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the segment nearest the start over which f changes sign; NaN without one.

    Points lie on both sides at distances that double; of two segments as far out, the one whose secant crosses zero
    nearer the start is taken.
    """
    rows = np.arange(len(start))
    reach = FIRST_STEP * (2.0 ** np.arange(WIDENINGS + 1) - 1)
    sides = []
    for way in (-1, 1):
        at = np.clip(start[:, None] + way * reach, *ENDS)
        value = np.stack([f(at[:, k])[0] for k in range(at.shape[1])], axis=1)
        change = (np.signbit(value[:, 1:]) != np.signbit(value[:, :-1])) & (at[:, 1:] != at[:, :-1])
        sides.append((at, value, change))
    either = sides[0][2] | sides[1][2]
    first = either.argmax(axis=1)
    found, off = [], []
    for at, value, change in sides:
        near, far = at[rows, first], at[rows, first + 1]
        v_near, v_far = value[rows, first], value[rows, first + 1]
        cross = near - v_near * (far - near) / (v_far - v_near)
        found.append((near, far))
        off.append(np.where(change[rows, first], np.abs(cross - start), np.inf))
    left = off[0] <= off[1]
    ends = np.where(left, found[0], found[1])
    none = ~either.any(axis=1)
    return np.where(none, np.nan, ends[0]), np.where(none, np.nan, ends[1])


def solve(f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], guess: np.ndarray) -> np.ndarray:
    """Rates at which f vanishes, row by row; NaN where none is found. f maps x = ln(1 + rate) to (value, scale)."""
    with np.errstate(all="ignore"):
        start = np.log1p(np.where(guess > -1, guess, np.nan))
        value, scale = f(start)
        root = np.where(np.abs(value) <= AT_GUESS * scale, start, np.nan)
        a, b = _bracket(f, start)
        fa = f(a)[0]
        for _ in range(HALVINGS):
            mid = (a + b) / 2
            fm, scale = f(mid)
            root = np.where(np.isnan(root) & (np.abs(fm) <= AT_ROOT * scale), mid, root)
            same = np.signbit(fm) == np.signbit(fa)
            a, fa, b = np.where(same, mid, a), np.where(same, fm, fa), np.where(same, b, mid)
        best = (a + b) / 2
        fm, scale = f(best)
        return np.expm1(np.where(np.isnan(root) & (np.abs(fm) <= AT_BEST * scale), best, root))


def irr_of(flows: list, guess: float = 0.1) -> float:
    """Internal rate of return of one list of flows; NaN without both signs or without a root."""
    return float(irr_rows([flows], np.array([guess]))[0])


def irr_rows(rows: list, guess: np.ndarray) -> np.ndarray:
    """IRR of many lists at once; the shorter end in zeros, which change nothing."""
    lists = [[x for x in r if x is not None and x == x] if r is not None else [] for r in rows]
    cf = np.zeros((len(lists), max([1, *map(len, lists)])))
    for i, r in enumerate(lists):
        cf[i, : len(r)] = r
    held = (cf > 0).any(axis=1) & (cf < 0).any(axis=1)
    out = np.full(len(lists), np.nan)
    if held.any():
        some = cf[held]

        def f(x):
            d = np.exp(-x[:, None] * np.arange(some.shape[1]))
            return (some * d).sum(axis=1), (np.abs(some) * d).sum(axis=1)

        with np.errstate(all="ignore"):
            out[held] = solve(f, guess[held])
    return out


@F.pandas_udf(T.DoubleType())
def irr_udf(flows: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series(irr_rows([None if x is None else list(x) for x in flows], guess.to_numpy(np.float64)))


@F.pandas_udf(T.DoubleType())
def rate_udf(n: pd.Series, pmt: pd.Series, pv: pd.Series, fv: pd.Series, kind: pd.Series, guess: pd.Series) -> pd.Series:
    n, pmt, pv, fv, kind = (s.to_numpy(np.float64) for s in (n, pmt, pv, fv, kind))

    def f(x):
        with np.errstate(all="ignore"):
            r = np.expm1(x)
            ann = np.where(x == 0, n, -np.expm1(-n * x) / np.where(r == 0, 1, r)) * np.where(kind != 0, 1 + r, 1)
            end = fv * np.exp(-n * x)
            return pv + pmt * ann + end, np.abs(pv) + np.abs(pmt * ann) + np.abs(end)

    return pd.Series(solve(f, guess.to_numpy(np.float64)))


@raw_function("RATE", 3, 6)
def _rate(n: Val, pmt: Val, pv: Val, fv: Val | None = None, kind: Val | None = None, guess: Val | None = None) -> Val:
    got = [to_num(v) for v in (n, pmt, pv, fv or constant(0), kind or constant(0), guess or constant(0.1))]
    out = rate_udf(*[g.col for g in got])
    bad = (got[0].col <= 0) | out.isNull() | F.isnan(out)
    return settled(num(out, *[g.err for g in got], when(bad, NUM)))


def _flows(args: tuple[Val, ...]) -> tuple[list[Val], list[Column]]:
    flat = [x for a in args for x in (a.src if isinstance(a.src, list) else [a])]
    return [to_num(v) for v in flat if v.kind in ("num", "bool", "blank")], []


@raw_function("NPV", 2, MOST)
def _npv(rate: Val, *args: Val) -> Val:
    """Flows given one by one, or as a list (a row range); for a column range see operators.aggregates."""
    r, (flows, _) = to_num(rate), _flows(args)
    out = F.lit(0.0)
    for i, v in enumerate(flows):
        out = out + v.col / F.pow(1 + r.col, F.lit(float(i + 1)))
    return finite(F.when(r.col != -1, out), r.err, *[v.err for v in flows], when(r.col == -1, DIV0))


@raw_function("IRR", 1, 2)
def _irr(values: Val, guess: Val | None = None) -> Val:
    flows, _ = _flows((values,))
    if not flows:
        return error(NUM)
    g = to_num(guess or constant(0.1))
    out = irr_udf(F.array(*[v.col for v in flows]), g.col)
    return settled(num(out, g.err, first_error(*[v.err for v in flows]), when(out.isNull() | F.isnan(out), NUM)))
