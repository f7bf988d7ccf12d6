"""Scalar mathematics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import number_function, raw_function
from .values import DIV0, NUM, VALUE, Val, arithmetic, constant, error, finite, num, when


def towards_zero(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c)).cast("double")


def half_away(c: Column) -> Column:
    """Round to an integer, halves away from zero, on the binary value itself."""
    a, low = F.abs(c), F.floor(F.abs(c)).cast("double")
    return F.signum(c) * (low + F.when(a - low >= 0.5, 1.0).otherwise(0.0))


def _floor(c: Column) -> Column:
    # floor() gives bigint, which saturates; numbers of 2**53 and more are whole already
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def _ceil(c: Column) -> Column:
    return -_floor(-c)


number_function("ABS", 1)(lambda x: finite(F.abs(x)))
number_function("SIGN", 1)(lambda x: num(F.signum(x)))
number_function("PI", 0)(lambda: num(F.pi()))
number_function("EXP", 1)(lambda x: finite(F.exp(x)))
number_function("SQRT", 1)(lambda x: num(F.when(x >= 0, F.sqrt(x)), when(x < 0, NUM)))
number_function("INT", 1)(lambda x: finite(_floor(x)))
number_function("LN", 1)(lambda x: num(F.when(x > 0, F.ln(x)), when(x <= 0, NUM)))
number_function("LOG10", 1)(lambda x: num(F.when(x > 0, F.log10(x)), when(x <= 0, NUM)))


@number_function("LOG", 1, 2)
def _log(x: Column, base: Column | None = None) -> Val:
    base = F.lit(10.0) if base is None else base
    bad = (x <= 0) | (base <= 0) | (base == 1)
    return finite(F.when(~bad, F.ln(x) / F.ln(base)), when(bad, NUM))


@number_function("MOD", 2)
def _mod(x: Column, y: Column) -> Val:
    y_ok = F.when(y != 0, y)
    return finite(x - y_ok * _floor(x / y_ok), when(y == 0, DIV0))


@raw_function("POWER", 2)
def _power(a: Val, b: Val) -> Val:
    return arithmetic("^", a, b)


raw_function("POW", 2)(_power)


def _scaled(x: Column, digits: Column, how) -> Val:
    d = towards_zero(digits)
    bad = F.abs(d) > 308
    scale = F.pow(F.lit(10.0), F.abs(F.when(~bad, d)))
    up = F.when(d >= 0, x * scale).otherwise(x / scale)
    back = F.when(d >= 0, how(up) / scale).otherwise(how(up) * scale)
    return finite(F.when(F.abs(up) < 2.0**53, back).otherwise(x), when(bad, NUM))


number_function("ROUND", 2)(lambda x, d: _scaled(x, d, half_away))
number_function("ROUNDUP", 2)(lambda x, d: _scaled(x, d, lambda c: F.signum(c) * _ceil(F.abs(c))))
number_function("ROUNDDOWN", 2)(lambda x, d: _scaled(x, d, towards_zero))
number_function("TRUNC", 1, 2)(lambda x, d=None: _scaled(x, F.lit(0.0) if d is None else d, towards_zero))


def _multiple(x: Column, s: Column | None, how) -> Val:
    s = F.lit(1.0) if s is None else s
    ok = F.when(s != 0, s)
    return finite(how(x / ok) * ok, when(s == 0, DIV0))


number_function("FLOOR", 1, 2)(lambda x, s=None: _multiple(x, s, _floor))
number_function("CEILING", 1, 2)(lambda x, s=None: _multiple(x, s, _ceil))


@number_function("MROUND", 2)
def _mround(x: Column, m: Column) -> Val:
    none = (x == 0) | (m == 0)
    clash = ~none & ((x < 0) != (m < 0))
    return finite(F.when(none, 0.0).when(~clash, half_away(x / F.when(m != 0, m)) * m), when(clash, NUM))


def _parity(x: Column, odd: int) -> Val:
    away = F.signum(x) * _ceil(F.abs(x))
    off = F.abs(away) % 2 != odd
    step = F.when(x < 0, -1.0).otherwise(1.0)
    bad = F.abs(x) >= 2.0**63
    return finite(F.when(~bad, away + F.when(off, step).otherwise(0.0)), when(bad, NUM))


number_function("EVEN", 1)(lambda x: _parity(x, 0))
number_function("ODD", 1)(lambda x: _parity(x, 1))
number_function("QUOTIENT", 2)(lambda x, y: finite(towards_zero(x / F.when(y != 0, y)), when(y == 0, DIV0)))


@raw_function("ADDRESS", 2, 5)
def _address(row: Val, col: Val, kind: Val | None = None, a1: Val | None = None, sheet: Val | None = None) -> Val:
    from .values import first_error, text, to_bool, to_num, to_text

    r, c, k = to_num(row), to_num(col), to_num(kind) if kind else to_num(constant(1))
    flag, name = to_bool(a1) if a1 else to_bool(constant(True)), to_text(sheet) if sheet else None
    bad = (r.col < 1) | (c.col < 1) | ~towards_zero(k.col).isin(1.0, 2.0, 3.0, 4.0)
    ri, ci, ki = (towards_zero(v.col).cast("long") for v in (r, c, k))
    letter = lambda x: F.chr(F.lit(65) + x)
    one, two, three = (ci - 1) % 26, F.floor((ci - 1) / 26) - 1, F.floor((ci - 703) / 676)
    letters = F.when(ci <= 26, letter(one)).when(ci <= 702, F.concat(letter(two % 26), letter(one))).otherwise(F.concat(letter(three), letter(two % 26), letter(one)))
    rt, ct = ri.cast("string"), ci.cast("string")
    a1_text = F.concat(F.when(ki.isin(1, 3), F.lit("$")).otherwise(F.lit("")), letters, F.when(ki.isin(1, 2), F.lit("$")).otherwise(F.lit("")), rt)
    rc_text = F.concat(F.when(ki.isin(1, 2), F.concat(F.lit("R"), rt)).otherwise(F.concat(F.lit("R["), rt, F.lit("]"))), F.when(ki.isin(1, 3), F.concat(F.lit("C"), ct)).otherwise(F.concat(F.lit("C["), ct, F.lit("]"))))
    made = F.when(flag.col, a1_text).otherwise(rc_text)
    if name is not None:
        quoted = F.when(name.col.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"), name.col).otherwise(F.concat(F.lit("'"), F.replace(name.col, F.lit("'"), F.lit("''")), F.lit("'")))
        made = F.concat(quoted, F.lit("!"), made)
    return text(F.when(~bad, made), first_error(r.err, c.err, k.err, flag.err, name.err if name else None), when(bad, VALUE))


__all__ = ["error", "half_away", "towards_zero"]
