"""Criteria of COUNTIF and its kin: an operator prefix, a typed operand, and wildcards for = and <>."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import NUMERIC, Val


@dataclass(frozen=True)
class Criterion:
    op: str
    operand: object  # float, bool, str or None for blank
    pattern: str | None = None  # a Java regular expression of the whole text


def is_wildcard(text: str) -> bool:
    """Whether an unescaped * or ?, or an escape of one, occurs."""
    return bool(re.search(r"[*?]|~[*?~]", text))


def wildcard(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "~" and i + 1 < len(text) and text[i + 1] in "*?~":
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def parse_criterion(raw: object) -> Criterion:
    if raw is None or isinstance(raw, (bool, int, float)):
        return Criterion("=", raw if raw is None or isinstance(raw, bool) else float(raw))
    m = re.match(r"<>|<=|>=|<|>|=", raw)
    op, rest = (m[0], raw[m.end() :]) if m else ("=", raw)
    if re.match(NUMERIC, rest.strip()):
        return Criterion(op, float(rest))
    if rest.upper() in ("TRUE", "FALSE"):
        return Criterion(op, rest.upper() == "TRUE")
    if op in ("=", "<>") and is_wildcard(rest):
        return Criterion(op, rest, wildcard(rest))
    return Criterion(op, rest)


def matches(v: Val, c: Criterion) -> Column:
    """The predicate; kinds are strict: a number only meets numbers, and a plain <> is false across kinds."""
    kind = {float: "num", bool: "bool", str: "text"}.get(type(c.operand))
    if c.pattern is not None:
        shown = F.coalesce(v.col, F.lit("")) if v.kind == "text" else F.lit("")
        hit = shown.rlike(c.pattern) if v.kind == "text" else F.lit(False)
        if v.kind != "text":
            hit = v.col.isNull() & F.lit("").rlike(c.pattern)
        return hit if c.op == "=" else ~hit
    if c.operand is None:
        return v.col.isNull()
    if kind == "text" and c.operand == "":
        empty = v.col.isNull() | (v.col == "") if v.kind == "text" else v.col.isNull()
        return empty if c.op == "=" else ~empty
    if kind != v.kind:
        return F.lit(False)
    x, y = (F.lower(v.col), F.lit(c.operand.lower())) if kind == "text" else (v.col, F.lit(c.operand))
    hit = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[c.op]
    return F.coalesce(hit, F.lit(False))


#: Text in a criterion cell that says more than "equal to this".
SPECIAL = r"^(<|>|=)|[*?]|~[*?~]|^\s*$"


def join_key(v: Val) -> Column:
    """What plain criteria are joined on: text ignores case."""
    return F.lower(v.col) if v.kind == "text" else v.col


def criterion_key(v: Val, key: Val) -> Column:
    """A plain criterion cell as a join key for a range: a number in text meets numbers, and never text."""
    nothing = F.lit(None).cast({"text": "string", "num": "double", "bool": "boolean"}[v.kind])
    if key.kind == "blank":
        return nothing
    if key.kind != "text":
        return key.col if key.kind == v.kind else nothing
    plain, number, flag = ~key.col.rlike(SPECIAL), F.trim(key.col).rlike(NUMERIC), F.upper(key.col).isin("TRUE", "FALSE")
    made = {"text": F.when(~number & ~flag, F.lower(key.col)), "num": F.when(number, F.trim(key.col).try_cast("double")), "bool": F.when(flag, F.upper(key.col) == "TRUE")}
    return F.when(plain, made[v.kind])
