"""Text functions. Positions count code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import date_text
from .math import towards_zero
from .registry import MOST, number_function, raw_function, text_function
from .values import NUM, NUMERIC, VALUE, Val, bind, boolean, constant, error, finite, first_error, num, settled, text, to_bool, to_num, to_text, when

text_function("LEN", 1)(lambda t: num(F.char_length(t).cast("double")))
text_function("UPPER", 1)(lambda t: text(F.upper(t)))
text_function("LOWER", 1)(lambda t: text(F.lower(t)))
text_function("TRIM", 1)(lambda t: text(F.trim(F.regexp_replace(t, r"(?U)\s+", " "))))
text_function("CLEAN", 1)(lambda t: text(F.regexp_replace(t, r"[\x00-\x1F]", "")))
text_function("EXACT", 2)(lambda a, b: boolean(a == b))


def _count(v: Val | None, least: int) -> Val:
    n = to_num(constant(1) if v is None else v)
    k = towards_zero(n.col)
    return Val("num", F.least(k, F.lit(2.0**31 - 2)).cast("int"), first_error(n.err, when(k < least, VALUE)))


@raw_function("LEFT", 1, 2)
def _left(v: Val, n: Val | None = None) -> Val:
    t, k = to_text(v), _count(n, 0)
    return settled(text(F.substring(t.col, F.lit(1), k.col), t.err, k.err))


@raw_function("RIGHT", 1, 2)
def _right(v: Val, n: Val | None = None) -> Val:
    t, k = to_text(v), _count(n, 0)
    keep = F.least(k.col, F.char_length(t.col))
    return settled(text(F.substring(t.col, F.char_length(t.col) - keep + 1, keep), t.err, k.err))


@raw_function("MID", 3)
def _mid(v: Val, start: Val, n: Val) -> Val:
    t, a, k = to_text(v), _count(start, 1), _count(n, 0)
    return settled(text(F.substring(t.col, F.when(a.err.isNull(), a.col), F.when(k.err.isNull(), k.col)), t.err, a.err, k.err))


def _joined(*args: Val) -> Val:
    got = [to_text(a) for a in args]
    return text(F.concat(*[g.col for g in got]), *[g.err for g in got])


raw_function("CONCAT", 1, MOST)(_joined)
raw_function("CONCATENATE", 1, MOST)(_joined)


@raw_function("TEXTJOIN", 3, MOST)
def _textjoin(delim: Val, skip: Val, *args: Val) -> Val:
    d, s, got = to_text(delim), to_bool(skip), [to_text(a) for a in args]
    every = F.array(*[g.col for g in got])
    parts = F.when(s.col, F.filter(every, lambda x: x != "")).otherwise(every)
    return text(_join(parts, d.col), d.err, s.err, *[g.err for g in got])


def _join(parts: Column, delim: Column) -> Column:
    whole = F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(True).alias("first")), lambda acc, x: F.struct(F.concat(acc["t"], F.when(acc["first"], F.lit("")).otherwise(delim), x).alias("t"), F.lit(False).alias("first")))
    return whole["t"]


@raw_function("SUBSTITUTE", 3, 4)
def _substitute(v: Val, old: Val, new: Val, nth: Val | None = None) -> Val:
    t, o, w = to_text(v), to_text(old), to_text(new)
    errs = (t.err, o.err, w.err)
    if nth is None:
        return settled(text(F.when(o.col == "", t.col).otherwise(F.replace(t.col, o.col, w.col)), *errs))
    k = _count(nth, 1)
    parts = F.split(t.col, F.concat(F.lit("\\Q"), F.replace(o.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    n = F.size(parts)
    some = F.concat(_join(F.slice(parts, F.lit(1), k.col), o.col), w.col, _join(F.slice(parts, k.col + 1, F.greatest(n - k.col, F.lit(0))), o.col))
    return settled(text(F.when((o.col == "") | (k.col >= n), t.col).otherwise(some), *errs, k.err))


@raw_function("REPLACE", 4)
def _replace(v: Val, start: Val, n: Val, new: Val) -> Val:
    t, a, k, w = to_text(v), _count(start, 1), _count(n, 0), to_text(new)
    size = F.char_length(t.col)
    out = F.concat(F.substring(t.col, F.lit(1), a.col - 1), w.col, F.when(a.col + k.col <= size, F.substring(t.col, a.col + k.col, size)).otherwise(F.lit("")))
    return settled(text(out, t.err, a.err, k.err, w.err, when(a.col > size + 1, VALUE)))


def _found(at: Column, start: Val, size: Column, *errs) -> Val:
    return settled(num(at.cast("double"), *errs, start.err, when((start.col > size + 1) | (at == 0), VALUE)))


@raw_function("FIND", 2, 3)
def _find(needle: Val, hay: Val, start: Val | None = None) -> Val:
    n, h, a = to_text(needle), to_text(hay), _count(start, 1)
    at = F.when(n.col == "", a.col).otherwise(F.call_function("locate", n.col, h.col, a.col))
    return _found(at, a, F.char_length(h.col), n.err, h.err)


def wildcard_regex(pattern: Column, lazy: bool) -> Column:
    """A pattern with * ? and ~ as a Java regular expression."""
    held = {"*": "\u0001", "?": "\u0002", "~": "\u0003"}
    p = pattern
    for mark, stand in held.items():
        p = F.replace(p, F.lit("~" + mark), F.lit(stand))
    p = F.regexp_replace(p, r"([\\.\[\]{}()+^$|])", r"\\$1")
    p = F.replace(F.replace(p, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*?" if lazy else ".*"))
    for mark, stand in held.items():
        p = F.replace(p, F.lit(stand), F.lit("\\" + mark if mark != "~" else "~"))
    return p


@raw_function("SEARCH", 2, 3)
def _search(needle: Val, hay: Val, start: Val | None = None) -> Val:
    n, h, a = to_text(needle), to_text(hay), _count(start, 1)
    rest = F.substring(h.col, a.col, F.char_length(h.col))
    ahead = F.regexp_instr(rest, F.concat(F.lit("(?is)"), wildcard_regex(n.col, lazy=True)))
    at = F.when(n.col == "", a.col).when(ahead > 0, ahead + a.col - 1).otherwise(0)
    return _found(at, a, F.char_length(h.col), n.err, h.err)


def _parsed(t: Column, decimal: Column, group: Column) -> Val:
    def pieces(s: Column) -> Column:
        tail = F.regexp_extract(s, r"([%\s]*)$", 1)
        return F.struct(F.trim(F.regexp_replace(s, r"[%\s]*$", "")).alias("body"), (F.length(tail) - F.length(F.regexp_replace(tail, "%", ""))).alias("marks"))

    def number(p: Column) -> Column:
        at = F.call_function("locate", decimal, p["body"])
        late_group = (group != "") & (at > 0) & (F.call_function("locate", group, F.substring(p["body"], at + 1, F.length(p["body"]))) > 0)
        sound = ~late_group & (decimal != group) & (F.length(decimal) == 1) & (F.length(group) <= 1)
        bare = F.regexp_replace(F.replace(F.when(group == "", p["body"]).otherwise(F.replace(p["body"], group, F.lit(""))), decimal, F.lit(".")), r"\s", "")
        return bind(bare, lambda b: F.when(sound & b.rlike(NUMERIC), b.try_cast("double"))) * F.pow(F.lit(0.01), p["marks"])

    out = bind(bind(F.trim(t), pieces), number)
    return finite(out, when(out.isNull(), VALUE))


@raw_function("NUMBERVALUE", 1, 3)
def _numbervalue(v: Val, decimal: Val | None = None, group: Val | None = None) -> Val:
    t, d, g = to_text(v), to_text(decimal or constant(".")), to_text(group or constant(","))
    out = _parsed(t.col, d.col, g.col)
    return settled(num(out.col, t.err, d.err, g.err, out.err))


@raw_function("VALUE", 1)
def _value(v: Val) -> Val:
    from .dates import parsed_date

    if v.kind != "text":
        return to_num(v)
    out, day = _parsed(v.col, F.lit("."), F.lit(",")), parsed_date(v.col)
    return settled(num(F.coalesce(day, out.col), v.err, F.when(day.isNull(), out.err)))


@raw_function("REPT", 2)
def _rept(v: Val, n: Val) -> Val:
    t, k = to_text(v), _count(n, 0)
    return settled(text(F.call_function("repeat", t.col, k.col), t.err, k.err))


@number_function("CHAR", 1)
def _char(x: Column) -> Val:
    k = towards_zero(x).cast("long")
    bad = (k < 1) | (k > 255)
    return text(F.when(~bad, F.chr(k)), when(bad, VALUE))


@number_function("UNICHAR", 1)
def _unichar(x: Column) -> Val:
    k = towards_zero(x).cast("long")
    bad = (k < 1) | (k > 0x10FFFF) | k.between(0xD800, 0xDFFF)
    return text(F.when(~bad, F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32")), when(bad, VALUE))


for _name in ("CODE", "UNICODE"):
    text_function(_name, 1)(lambda t: num(F.when(t != "", F.ascii(t).cast("double")), when(t == "", VALUE)))


@F.pandas_udf(T.StringType())
def _proper(texts: pd.Series) -> pd.Series:
    """A letter after a non-letter is upper case, every other one lower; no built-in function does this."""
    def one(s):
        out, inside = [], False
        for c in s:
            out.append((c.lower() if inside else c.upper()) if c.isalpha() else c)
            inside = c.isalpha()
        return "".join(out)

    return texts.map(lambda s: None if s is None else one(s))


text_function("PROPER", 1)(lambda t: text(_proper(t)))


@raw_function("TEXT", 2)
def _text(v: Val, fmt: Val) -> Val:
    if v.kind != "num":
        return to_text(v)
    f = fmt.const
    if f is None:
        return error(VALUE)
    day = date_text(v.col, f)
    if day is not None:
        return text(day, v.err)
    if "." in f:
        digits = 0
        for c in f[f.index(".") + 1 :]:
            if c not in "0#":
                break
            digits += 1
        return text(fixed(v.col, digits), v.err)
    return text(fixed(v.col, 0), v.err) if "0" in f else to_text(v)


def fixed(c: Column, digits: int) -> Column:
    """So many decimal places, halves of the decimal form to even."""
    return F.bround(c.cast(f"decimal(38,{min(18, digits + 6)})"), digits).cast(f"decimal(38,{digits})").cast("string")


__all__ = ["NUM"]
