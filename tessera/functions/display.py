"""Display formats: codes such as `#,##0.00;(#,##0.00);"none";@` become one expression when the plan is made.

A code has up to four sections for positive, negative, zero and text values; fewer sections fall back on the first,
which then keeps the sign. A section is a date where it holds a date token, else a number where it holds a
placeholder, else plain text. Quotes and backslashes mark text, brackets (colours, conditions) are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import rendered

#: Fixed values of the format language: date tokens and what Spark's date patterns call them (m is settled by context).
DATE_TOKENS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "E", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss", "s": "s", "am/pm": "a"}
PIECE = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|(?P<bracket>\[[^\]]*\])|(?P<date>am/pm|y{4}|yy|m{1,4}|d{1,4}|h{1,2}|s{1,2})'
    r"|(?P<number>[#0?][#0?,]*(?:\.[#0?]*)?(?:E[+-]?0+)?|\.[#0?]+(?:E[+-]?0+)?)|(?P<other>.)",
    re.I | re.S,
)


def _sections(code: str) -> list[str]:
    """Cut at semicolons outside quotes and escapes."""
    return ["".join(p) for p in _grouped(re.findall(r'"[^"]*"?|\\.|.', code, re.S))]


def _grouped(parts: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for p in parts:
        out.append([]) if p == ";" else out[-1].append(p)
    return out


def _pieces(section: str) -> list[tuple[str, str]]:
    """(kind, text): text, date or number."""
    out = []
    for m in PIECE.finditer(section):
        kind = m.lastgroup
        if kind in ("date", "number"):
            out.append((kind, m[0].lower() if kind == "date" else m[0]))
        elif kind != "bracket" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + m[kind])
        elif kind != "bracket":
            out.append(("text", m[kind]))
    return out


def _date_pattern(pieces: list[tuple[str, str]]) -> str:
    tokens = [i for i, (kind, _) in enumerate(pieces) if kind == "date"]
    half_day = any(pieces[i][1] == "am/pm" for i in tokens)
    out = []
    for i, (kind, t) in enumerate(pieces):
        if kind != "date":
            out.append("'" + t.replace("'", "''") + "'")
            continue
        k = tokens.index(i)
        beside = [pieces[tokens[k - 1]][1][0] if k else "", pieces[tokens[k + 1]][1][0] if k + 1 < len(tokens) else ""]
        if t in ("m", "mm") and (beside[0] == "h" or beside[1] == "s"):
            out.append(t)
        else:
            out.append(DATE_TOKENS[t].lower() if half_day and t[0] == "h" else DATE_TOKENS[t])
    return "".join(out)


def _number(c: Column, pattern: str) -> Column:
    """Half away from zero on the shortest decimal form, as the JVM's formatter rounds."""
    mantissa, *exponent = re.split("E", pattern, flags=re.I)
    decimals = len(mantissa.partition(".")[2])
    if not exponent:
        return F.format_string(f"%{',' if ',' in mantissa else ''}.{decimals}f", c)
    digits = exponent[0].count("0")
    halves = F.split(F.format_string(f"%.{decimals}e", c), "e")
    bare = F.regexp_replace(F.get(halves, F.lit(1)), "^[+-]0*(?=.)", "")
    return F.concat(F.get(halves, F.lit(0)), F.lit("E"), F.left(F.get(halves, F.lit(1)), F.lit(1)), F.when(F.length(bare) < digits, F.lpad(bare, digits, "0")).otherwise(bare))


def _shown(c: Column, section: str) -> Column:
    pieces = _pieces(section)
    kinds = [k for k, _ in pieces]
    if "date" in kinds:
        return rendered(c, _date_pattern(pieces))
    if "number" not in kinds:
        return F.lit("".join(t for _, t in pieces).replace("@", ""))
    at = kinds.index("number")
    percent = any(k == "text" and "%" in t for k, t in pieces)
    body = _number(c * 100 if percent else c, pieces[at][1])
    return F.concat(F.lit("".join(t for _, t in pieces[:at])), body, F.lit("".join(t for _, t in pieces[at + 1 :])))


def format_number(c: Column, code: str) -> Column:
    """A numeric column as text; null stays null, and what isn't finite is empty."""
    sections = _sections(code)
    x = c.cast("double")
    positive = _shown(x, sections[0])
    negative = _shown(F.abs(x), sections[1]) if len(sections) > 1 else positive
    zero = _shown(F.abs(x), sections[2]) if len(sections) > 2 else positive
    shown = F.when(x > 0, positive).when(x < 0, negative).otherwise(zero)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("")).otherwise(shown)


def format_text(c: Column, code: str) -> Column:
    """A text column: the fourth section with the text in place of @, if there is one."""
    sections = _sections(code)
    if len(sections) < 4:
        return c
    return F.replace(F.lit("".join(t for _, t in _pieces(sections[3]))), F.lit("@"), c)
