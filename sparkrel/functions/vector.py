"""Distances of vectors and bit strings, as built-in expressions (no Python in the plan)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..expr import Expr, as_expr, require

VECTOR, BITS = ("vector", "array", "any"), ("bit", "text")


def _sum(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _wide(c):
    return c.cast("array<double>")


def _pairs(a, b, fn):
    return _sum(F.zip_with(_wide(a), _wide(b), fn))


def _of(name: str, l: Any, r: Any, kinds: tuple, render) -> Expr:
    l, r = as_expr(l), as_expr(r)
    for e in (l, r):
        require(e, kinds, name)
    return Expr(name, (l, r), render, kind="numeric")


def l2_distance(l: Any, r: Any) -> Expr:
    return _of("l2", l, r, VECTOR, lambda a, b: F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def inner_product(l: Any, r: Any) -> Expr:
    """The negative inner product, so that less is nearer."""
    return _of("ip", l, r, VECTOR, lambda a, b: -_pairs(a, b, lambda x, y: x * y))


def cosine_distance(l: Any, r: Any) -> Expr:
    """1 - cosine; NaN where a vector is zero."""

    def render(a, b):
        dot = lambda p, q: _pairs(p, q, lambda x, y: x * y)
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.when(norm != 0, norm))

    return _of("cosine", l, r, VECTOR, render)


def l1_distance(l: Any, r: Any) -> Expr:
    return _of("l1", l, r, VECTOR, lambda a, b: _pairs(a, b, lambda x, y: F.abs(x - y)))


def _bits(a, b, fn):
    return F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: fn(x, y).cast("double"))


def hamming_distance(l: Any, r: Any) -> Expr:
    """Places at which two bit strings differ."""
    return _of("hamming", l, r, BITS, lambda a, b: _sum(_bits(a, b, lambda x, y: x != y)))


def jaccard_distance(l: Any, r: Any) -> Expr:
    """1 - common ones / all ones; 1 if none are common."""

    def render(a, b):
        both = _sum(_bits(a, b, lambda x, y: (x == "1") & (y == "1")))
        any_ = _sum(_bits(a, b, lambda x, y: (x == "1") | (y == "1")))
        return F.when(both == 0, F.lit(1.0)).otherwise(1 - both / F.when(any_ != 0, any_))

    return _of("jaccard", l, r, BITS, render)


def sparse_to_dense(c, n: int):
    """A string {i:v,...}/n as an array of n doubles."""
    pairs = F.split(F.regexp_extract(c, r"^\{(.*)\}", 1), ",")
    real = F.filter(pairs, lambda p: p != "")
    entries = F.map_from_entries(F.transform(real, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double"))))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)))
