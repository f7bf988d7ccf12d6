"""The function registry: name -> (least arguments, most arguments, builder of a Val from Vals)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .values import VALUE, Val, error, first_error, settled, to_bool, to_num, to_text

FUNCTIONS: dict[str, tuple[int, int, Callable[..., Val]]] = {}
MOST = 254


def raw_function(name: str, least: int, most: int | None = None):
    """Register a builder that gets the Vals as they are."""

    def keep(f: Callable[..., Val]) -> Callable[..., Val]:
        FUNCTIONS[name] = (least, least if most is None else most, f)
        return f

    return keep


def _coerced(name: str, least: int, most: int | None, convert) -> Callable:
    def keep(f: Callable[..., Val]) -> Callable[..., Val]:
        def build(*args: Val) -> Val:
            got = [convert(a) for a in args]
            errs = first_error(*[g.err for g in got])
            out = f(*[g.col for g in got])
            return settled(Val(out.kind, out.col, first_error(errs, out.err)))

        FUNCTIONS[name] = (least, least if most is None else most, build)
        return f

    return keep


def number_function(name: str, least: int, most: int | None = None):
    """Register a builder over number columns; argument errors come first."""
    return _coerced(name, least, most, to_num)


def text_function(name: str, least: int, most: int | None = None):
    return _coerced(name, least, most, to_text)


def boolean_function(name: str, least: int, most: int | None = None):
    return _coerced(name, least, most, to_bool)


def call(name: str, args: list[Val]) -> Val:
    """Apply a registered function; a wrong number of arguments is #VALUE!."""
    least, most, f = FUNCTIONS[name]
    return f(*args) if least <= len(args) <= most else error(VALUE)


def load() -> dict:
    from . import dates, finance, logical, math, text  # noqa: F401

    return FUNCTIONS


__all__ = ["F", "FUNCTIONS", "boolean_function", "call", "load", "number_function", "raw_function", "text_function"]
