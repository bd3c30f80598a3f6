"""String, arithmetic and mathematical functions, with PostgreSQL's results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..expr import Arg, Expr, QueryError, as_expr, require
from ..types import new_uuid7

TEXT, NUMBER = ("text",), ("numeric",)


def _text(name: str, e: Any, render, kind: str = "text", params: tuple = (), more: tuple = ()) -> Expr:
    e = as_expr(e)
    require(e, TEXT, name)
    return Expr(name, (e, *more), render, params=params, kind=kind, integral=kind == "numeric")


def length(e: Any) -> Expr:
    """Characters of a text."""
    return _text("length", e, F.length, "numeric")


def lower(e: Any) -> Expr:
    return _text("lower", e, F.lower)


def upper(e: Any) -> Expr:
    return _text("upper", e, F.upper)


def trim(e: Any) -> Expr:
    """Without blanks (0x20 only) at both ends."""
    return _text("trim", e, F.trim)


def left(e: Any, n: int | Arg) -> Expr:
    """The first n characters; for negative n all but the last -n."""
    return _text("left", e, lambda c, k: F.substring(c, F.lit(1), F.when(k >= 0, k).otherwise(F.greatest(F.length(c) + k, F.lit(0)))), more=(n,))


def right(e: Any, n: int | Arg) -> Expr:
    """The last n characters; for negative n all but the first -n."""

    def render(c, k):
        size = F.when(k >= 0, F.least(k, F.length(c))).otherwise(F.greatest(F.length(c) + k, F.lit(0)))
        return F.substring(c, F.length(c) - size + 1, size)

    return _text("right", e, render, more=(n,))


def position(e: Any, part: Any) -> Expr:
    """Where part first stands, from 1; 0 if nowhere."""
    return _text("position", e, lambda c, s: F.call_function("instr", c, s), "numeric", more=(part,))


def _arith(op: str, l: Any, r: Any, render, integral: bool | None = None) -> Expr:
    l, r = as_expr(l), as_expr(r)
    for e in (l, r):
        require(e, NUMBER, op)
    return Expr(op, (l, r), render, kind="numeric", integral=l.integral and r.integral if integral is None else integral)


def add(l: Any, r: Any) -> Expr:
    return _arith("add", l, r, lambda a, b: a + b)


def sub(l: Any, r: Any) -> Expr:
    return _arith("sub", l, r, lambda a, b: a - b)


def mul(l: Any, r: Any) -> Expr:
    return _arith("mul", l, r, lambda a, b: a * b)


def div(l: Any, r: Any) -> Expr:
    """Quotient; of whole numbers cut towards zero."""
    l, r = as_expr(l), as_expr(r)
    whole = l.integral and r.integral
    return _arith("div", l, r, (lambda a, b: F.call_function("div", a, b)) if whole else (lambda a, b: a / b))


def abs_(e: Any) -> Expr:
    e = as_expr(e)
    require(e, NUMBER, "abs")
    return Expr("abs", (e,), F.abs, kind="numeric", integral=e.integral)


def mod(e: Any, n: Any) -> Expr:
    """Remainder with the dividend's sign."""
    return _arith("mod", e, n, lambda a, b: a % b)


def _digits(d: Any) -> int:
    if not isinstance(d, int):
        raise QueryError("the number of digits is an integer")
    return d


def round_(e: Any, digits: int = 0) -> Expr:
    """Rounded half away from zero."""
    e = as_expr(e)
    require(e, NUMBER, "round")
    d = _digits(digits)
    return Expr("round", (e,), lambda c: F.round(c, d), params=(d,), kind="numeric", integral=e.integral)


def _outward(name: str, e: Any, fn) -> Expr:
    e = as_expr(e)
    require(e, NUMBER, name)
    return Expr(name, (e,), (lambda c: c) if e.integral else (lambda c: fn(c).cast("double")), kind="numeric", integral=e.integral)


def ceil(e: Any) -> Expr:
    return _outward("ceil", e, F.ceil)


def floor(e: Any) -> Expr:
    return _outward("floor", e, F.floor)


def trunc(e: Any, digits: int = 0) -> Expr:
    """Cut towards zero after some digits."""
    e = as_expr(e)
    require(e, NUMBER, "trunc")
    scale = 10.0 ** _digits(digits)
    return Expr("trunc", (e,), lambda c: F.signum(c) * F.floor(F.abs(c) * scale) / scale, params=(digits,), kind="numeric")


def power(e: Any, n: Any) -> Expr:
    return _arith("power", e, n, F.pow, False)


def now() -> Expr:
    """The time at which the query began."""
    return Expr("now", render=F.current_timestamp, kind="datetime")


def uuidv4() -> Expr:
    """A random uuid for each row."""
    return Expr("uuidv4", render=lambda: F.expr("uuid()"), kind="text")


def uuidv7() -> Expr:
    """A time-ordered uuid for each row: the query's time in milliseconds, then random bits."""

    def render():
        ms = F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0")
        r = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
        hexed = F.lower(F.concat(ms, F.lit("7"), F.substring(r, 14, 3), F.substring(r, 17, 16)))
        part = lambda at, n: F.substring(hexed, at, n)
        return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))

    return Expr("uuidv7", render=render, kind="text")


__all__ = ["abs_", "add", "ceil", "div", "floor", "left", "length", "lower", "mod", "mul", "new_uuid7", "now", "position", "power", "right", "round_", "sub", "trim", "trunc", "upper", "uuidv4", "uuidv7"]
