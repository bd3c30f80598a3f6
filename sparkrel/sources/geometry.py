"""Geometries as text and bytes: WKT, EWKT, WKB, EWKB, TWKB and GeoJSON.

A geometry is its kind, its coordinates as nested tuples (a collection's are
geometries), whether these have Z and M values, and an optional SRID. This
runs where rows enter or leave; queries work on structs of longitude and
latitude.
"""

from __future__ import annotations

import json
import math
import re
import struct
from dataclasses import dataclass
from typing import Any

#: Kinds by their number in WKB, and how deep their coordinates are nested.
KINDS = {"Point": (1, 0), "LineString": (2, 1), "Polygon": (3, 2), "MultiPoint": (4, 1), "MultiLineString": (5, 2), "MultiPolygon": (6, 3), "GeometryCollection": (7, None)}
NUMBERS = {n: k for k, (n, _) in KINDS.items()}
MEMBER = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}
FLAG_Z, FLAG_M, FLAG_SRID = 0x80000000, 0x40000000, 0x20000000


@dataclass(frozen=True)
class Geometry:
    kind: str
    coordinates: tuple
    z: bool = False
    m: bool = False
    srid: int | None = None

    @property
    def empty(self) -> bool:
        return len(self.coordinates) == 0

    # text

    def wkt(self) -> str:
        mark = " " + "Z" * self.z + "M" * self.m if self.z or self.m else ""
        return self.kind.upper() + mark + (" EMPTY" if self.empty else ("" if not mark else " ") + self._body())

    def _body(self) -> str:
        if self.kind == "GeometryCollection":
            return "(" + ",".join(g.wkt() for g in self.coordinates) + ")"

        def text(c: Any, depth: int) -> str:
            if depth == 0:
                return " ".join(_number(x) for x in c)
            return "(" + ",".join(text(x, depth - 1) for x in c) + ")"

        depth = KINDS[self.kind][1]
        return f"({text(self.coordinates, 0)})" if depth == 0 else text(self.coordinates, depth)

    def ewkt(self) -> str:
        return f"SRID={self.srid or 0};{self.wkt()}"

    def geojson(self) -> dict:
        if self.kind == "GeometryCollection":
            return {"type": self.kind, "geometries": [g.geojson() for g in self.coordinates]}
        lists = lambda c: [lists(x) for x in c] if isinstance(c, tuple) else c
        return {"type": self.kind, "coordinates": lists(self.coordinates)}

    # bytes

    def wkb(self) -> bytes:
        return self._wkb(False)

    def ewkb(self) -> bytes:
        return self._wkb(True)

    def _wkb(self, extended: bool, inner: bool = False) -> bytes:
        number = KINDS[self.kind][0]
        if extended:
            head = struct.pack("<BI", 1, number | FLAG_Z * self.z | FLAG_M * self.m | (FLAG_SRID if not inner else 0)) + (b"" if inner else struct.pack("<I", self.srid or 0))
        else:
            head = struct.pack("<BI", 1, number + 1000 * self.z + 2000 * self.m)
        size = 2 + self.z + self.m
        point = lambda c: struct.pack(f"<{size}d", *(c or (math.nan,) * size))
        many = lambda items: struct.pack("<I", len(items)) + b"".join(items)
        c = self.coordinates
        if self.kind == "Point":
            return head + point(c)
        if self.kind == "LineString":
            return head + many([point(p) for p in c])
        if self.kind == "Polygon":
            return head + many([many([point(p) for p in ring]) for ring in c])
        members = c if self.kind == "GeometryCollection" else [Geometry(MEMBER[self.kind], x, self.z, self.m) for x in c]
        return head + many([g._wkb(extended, True) for g in members])

    def twkb(self, precision: int = 5, z_precision: int = 5, m_precision: int = 5) -> bytes:
        """Whole numbers of 10**-precision, each point as the difference from the last one."""
        out = bytearray([KINDS[self.kind][0] | _zigzag(precision) << 4, 0x08 * (self.z or self.m) | 0x10 * self.empty])
        if self.z or self.m:
            out.append(self.z | self.m << 1 | z_precision << 2 | m_precision << 5)
        if self.empty:
            return bytes(out)
        scale = [10**precision, 10**precision] + [10**z_precision] * self.z + [10**m_precision] * self.m
        last = [0] * len(scale)

        def point(c: tuple) -> None:
            for i, (x, s) in enumerate(zip(c, scale, strict=True)):
                now = math.floor(x * s + 0.5)
                _put(out, _zigzag(now - last[i]))
                last[i] = now

        def walk(c: tuple, depth: int) -> None:
            if depth == 0:
                point(c)
                return
            _put(out, len(c))
            for x in c:
                walk(x, depth - 1)

        if self.kind == "GeometryCollection":
            _put(out, len(self.coordinates))
            for g in self.coordinates:
                out += g.twkb(precision, z_precision, m_precision)
        else:
            walk(self.coordinates, KINDS[self.kind][1])
        return bytes(out)


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _unzigzag(n: int) -> int:
    return n >> 1 if n % 2 == 0 else -(n + 1 >> 1)


def _put(out: bytearray, n: int) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def parse(value: str | bytes | dict) -> Geometry:
    """A geometry from EWKT or WKT, hexadecimal or raw WKB or EWKB, or GeoJSON."""
    if isinstance(value, dict):
        return from_geojson(value)
    if isinstance(value, (bytes, bytearray)):
        return from_wkb(bytes(value))
    if value.lstrip()[:1] == "{":
        return from_geojson(json.loads(value))
    if re.fullmatch("[0-9A-Fa-f]+", value):
        return from_wkb(bytes.fromhex(value))
    return from_wkt(value)


def from_geojson(g: dict) -> Geometry:
    if g["type"] == "GeometryCollection":
        return Geometry(g["type"], tuple(map(from_geojson, g["geometries"])))
    tuples = lambda c: tuple(map(tuples, c)) if isinstance(c, (list, tuple)) else float(c)
    c = tuples(g["coordinates"])
    first = c
    while first and isinstance(first[0], tuple):
        first = first[0]
    return Geometry(g["type"], c, z=len(first) > 2, m=len(first) > 3)


def from_wkt(text: str) -> Geometry:
    m = re.match(r"\s*SRID\s*=\s*(\d+)\s*;", text, re.I)
    tokens = re.findall(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]", text[m.end() if m else 0 :])
    at = 0

    def peek() -> str:
        return tokens[at].upper() if at < len(tokens) else ""

    def take(what: str | None = None) -> str:
        nonlocal at
        t = peek()
        if not t or what is not None and t != what:
            raise ValueError(f"bad WKT near {t or 'its end'}")
        at += 1
        return t

    def numbers() -> tuple:
        out = []
        while peek() not in (",", ")", ""):
            out.append(float(take()))
        return tuple(out)

    def group(depth: int, loose: bool = False) -> tuple:
        if loose and peek() != "(":
            return numbers()
        take("(")
        if depth == 0:
            out = numbers()
        else:
            items = [numbers() if depth == 1 and not loose_points else group(depth - 1, loose_points)]
            while peek() == ",":
                take()
                items.append(numbers() if depth == 1 and not loose_points else group(depth - 1, loose_points))
            out = tuple(items)
        take(")")
        return out

    loose_points = False

    def geometry(srid: int | None) -> Geometry:
        nonlocal loose_points
        word = take()
        mark = ""
        for suffix in ("ZM", "Z", "M"):
            if word.endswith(suffix) and word[: -len(suffix)] in {k.upper() for k in KINDS}:
                word, mark = word[: -len(suffix)], suffix
        kind = next((k for k in KINDS if k.upper() == word), None)
        if kind is None:
            raise ValueError(f"no geometry {word}")
        if peek() in ("Z", "M", "ZM"):
            mark = take()
        z, m_ = "Z" in mark, "M" in mark
        if peek() == "EMPTY":
            take()
            return Geometry(kind, (), z, m_, srid)
        if kind == "GeometryCollection":
            take("(")
            items = [geometry(None)]
            while peek() == ",":
                take()
                items.append(geometry(None))
            take(")")
            return Geometry(kind, tuple(items), z, m_, srid)
        loose_points = kind == "MultiPoint"
        c = group(KINDS[kind][1])
        first = c
        while first and isinstance(first[0], tuple):
            first = first[0]
        if not mark and len(first) > 2:
            z, m_ = True, len(first) > 3
        if len(first) != 2 + z + m_:
            raise ValueError("a point's values don't fit its dimensions")
        return Geometry(kind, c, z, m_, srid)

    out = geometry(int(m[1]) if m else None)
    if at != len(tokens):
        raise ValueError("text after the geometry")
    return out


def from_wkb(data: bytes) -> Geometry:
    at = 0

    def read(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def geometry() -> Geometry:
        order = "<" if read("B")[0] else ">"
        code = read(order + "I")[0]
        z, m, srid = bool(code & FLAG_Z), bool(code & FLAG_M), None
        if code & FLAG_SRID:
            srid = read(order + "I")[0]
        code &= 0x1FFFFFFF
        z, m = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3)
        kind = NUMBERS[code % 1000]
        size = 2 + z + m
        point = lambda: read(f"{order}{size}d")
        many = lambda one: tuple(one() for _ in range(read(order + "I")[0]))
        if kind == "Point":
            c = point()
            return Geometry(kind, () if math.isnan(c[0]) else c, z, m, srid)
        if kind == "LineString":
            return Geometry(kind, many(point), z, m, srid)
        if kind == "Polygon":
            return Geometry(kind, many(lambda: many(point)), z, m, srid)
        parts = many(geometry)
        return Geometry(kind, parts if kind == "GeometryCollection" else tuple(p.coordinates for p in parts), z, m, srid)

    return geometry()


def from_twkb(data: bytes) -> Geometry:
    at = 0

    def byte() -> int:
        nonlocal at
        at += 1
        return data[at - 1]

    def number() -> int:
        out = shift = 0
        while True:
            b = byte()
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    def geometry() -> Geometry:
        head, meta = byte(), byte()
        kind, precision = NUMBERS[head & 0x0F], _unzigzag(head >> 4)
        z = m = False
        scale = [10.0**precision] * 2
        if meta & 0x08:
            more = byte()
            z, m = bool(more & 1), bool(more & 2)
            scale += [10.0 ** (more >> 2 & 7)] * z + [10.0 ** (more >> 5)] * m
        if meta & 0x02:
            number()
        if meta & 0x01:
            for _ in range(2 * len(scale)):
                number()
        if meta & 0x10:
            return Geometry(kind, (), z, m)
        if kind == "GeometryCollection":
            return Geometry(kind, tuple(geometry() for _ in range(number())), z, m)
        last = [0] * len(scale)

        def walk(depth: int) -> tuple:
            if depth:
                n = number()
                if meta & 0x04 and depth == KINDS[kind][1]:
                    for _ in range(n):
                        number()
                return tuple(walk(depth - 1) for _ in range(n))
            for i in range(len(scale)):
                last[i] += _unzigzag(number())
            return tuple(v / s for v, s in zip(last, scale, strict=True))

        return Geometry(kind, walk(KINDS[kind][1]), z, m)

    return geometry()
