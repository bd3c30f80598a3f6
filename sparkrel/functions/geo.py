"""Distances of geographic points in metres, on the WGS 84 ellipsoid.

Vincenty's inverse formula in built-in functions: a fixed number of steps by
``aggregate``, ``transform`` over one value to name an intermediate result.
Nearly opposite points, for which it doesn't converge, get the distance on the
sphere with the mean earth radius (within about half a per cent).
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import functions as F

from ..expr import Expr, as_expr, require

RADIUS = 6371008.8
#: WGS 84: semi-major axis and flattening.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
STEPS = 20


def point_literal(p: Any) -> Expr:
    """An expression for a point: an expression, or (lon, lat)."""
    if isinstance(p, Expr):
        return p
    lon, lat = (p["lon"], p["lat"]) if isinstance(p, dict) else p
    return Expr("point", render=lambda: F.struct(F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat")), params=(float(lon), float(lat)), kind="geography")


def haversine(a, b):
    """Metres between two struct<lon, lat> columns."""
    la, lb = F.radians(a.getField("lat")), F.radians(b.getField("lat"))
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(b.getField("lon") - a.getField("lon")) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _pair(name: str, l: Any, r: Any, render) -> Expr:
    l, r = as_expr(l), point_literal(r)
    for e in (l, r):
        require(e, ("geography",), name)
    return Expr(name, (l, r), render, kind="numeric")


def _let(value, then):
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _angles(u, lam):
    """struct<s, c, sigma, alpha, cos2, mid> of the arc whose ends differ by lam in longitude on the auxiliary sphere."""
    x = F.sin(u.s1) * F.sin(u.s2)
    y = F.cos(u.s1) * F.cos(u.s2)
    across = F.hypot(F.cos(u.s2) * F.sin(lam), F.cos(u.s1) * F.sin(u.s2) - F.sin(u.s1) * F.cos(u.s2) * F.cos(lam))
    arc = F.struct(across.alias("s"), (x + y * F.cos(lam)).alias("c"), x.alias("x"), (y * F.sin(lam)).alias("y"))

    def turned(p):
        return F.struct(p.s, p.c, p.x, F.when(p.s > 0, p.y / p.s).otherwise(F.when(p.s.isNotNull(), 0.0)).alias("alpha"))

    def whole(q):
        cos2 = 1 - q.alpha * q.alpha
        return F.struct(q.s, q.c, F.atan2(q.s, q.c).alias("sigma"), q.alpha, cos2.alias("cos2"), F.when(cos2 > 1e-12, q.c - 2 * q.x / cos2).otherwise(0.0).alias("mid"))

    return _let(arc, lambda p: _let(turned(p), whole))


def _next(u, g):
    """The longitudes' difference that follows from an arc."""
    k = FLATTENING / 16 * g.cos2 * (4 + FLATTENING * (4 - 3 * g.cos2))
    return _let(k, lambda k: u.diff + (1 - k) * FLATTENING * g.alpha * (g.sigma + k * g.s * (g.mid + k * g.c * (2 * g.mid * g.mid - 1))))


def _length(g):
    """Metres along an arc."""
    polar = AXIS * (1 - FLATTENING)
    w = g.cos2 * ((AXIS**2 - polar**2) / polar**2)
    big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    turn = lambda m: m * g.s * (g.mid + m / 4 * (g.c * (2 * g.mid * g.mid - 1) - m / 6 * g.mid * (4 * g.s * g.s - 3) * (4 * g.mid * g.mid - 3)))
    return polar * big * (g.sigma - _let(small, turn))


def geodesic(a, b):
    """Metres between two struct<lon, lat> columns."""
    reduced = lambda p: F.atan((1 - FLATTENING) * F.tan(F.radians(p.getField("lat"))))
    ends = F.struct(reduced(a).alias("s1"), reduced(b).alias("s2"), F.radians(b.getField("lon") - a.getField("lon")).alias("diff"), haversine(a, b).alias("sphere"))

    def measured(u):
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), u.diff, lambda x, _: _let(_angles(u, x), lambda g: _next(u, g)))
        return _let(lam, lambda x: _let(_angles(u, x), lambda g: F.when((F.abs(_next(u, g) - x) > 1e-9) | (F.abs(x) > math.pi), u.sphere).otherwise(_length(g))))

    return _let(ends, measured)


def near(a, b, metres):
    """Whether two points are at most so many metres apart; the ellipsoid is asked only where the sphere leaves it open."""
    return _let(haversine(a, b), lambda d: F.when(d <= metres * 0.99, True).when(d > metres * 1.01, False).otherwise(geodesic(a, b) <= metres))


def st_distance(column: Any, point: Any) -> Expr:
    """Metres between points, on the ellipsoid."""
    return _pair("st_distance", column, point, geodesic)


def sphere_distance(column: Any, point: Any) -> Expr:
    """Metres between points on the sphere: within half a per cent, and cheaper."""
    return _pair("sphere_distance", column, point, haversine)
