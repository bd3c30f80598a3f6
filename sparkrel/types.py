"""Column types: the Spark type that holds them, and what a value must fulfil on write."""

from __future__ import annotations

import math
import re
import uuid as _uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    """name: SQL-like name; spark: type in DataFrames; category: what functions accept it; check: Column -> Column that is true (or null) for good values."""

    name: str
    spark: T.DataType
    category: str
    check: Callable[[SparkColumn], SparkColumn] | None = None
    read: Callable[[SparkColumn], SparkColumn] | None = None
    params: tuple = ()
    serial: bool = False
    enum: Any = field(default=None, compare=False)
    element: ColumnType | None = None
    dims: tuple = ()

    @property
    def integral(self) -> bool:
        return isinstance(self.spark, T.IntegralType)

    def accepts(self, value: Any) -> str | None:
        """Why a Python value isn't of this type, or None."""
        return _reject(self, value)

    def array(self, *sizes: int | None) -> ColumnType:
        """An array of this type, one size (or None) for each dimension, the innermost first; no size: one free dimension."""
        out = self
        for n in sizes or (None,):
            inner = out
            check = _array_check(inner, n)
            out = ColumnType(f"{inner.name}[{n or ''}]", T.ArrayType(inner.spark), "array", check, element=self, dims=(*inner.dims, n))
        return out


def _array_check(inner: ColumnType, n: int | None):
    def check(c: SparkColumn) -> SparkColumn:
        ok = F.lit(True)
        if n is not None:
            ok = ok & (F.size(c) == n)
        if inner.check is not None:
            ok = ok & F.forall(c, lambda x: F.coalesce(inner.check(x), F.lit(True)))
        return ok

    return check if n is not None or inner.check is not None else None


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _reject(t: ColumnType, v: Any) -> str | None:
    if v is None:
        return None
    s = t.spark
    if t.category == "array" or isinstance(s, T.ArrayType):
        if not isinstance(v, (list, tuple)):
            return "not a list"
        n = t.dims[-1] if t.dims else t.params[0] if t.params else None
        if n is not None and len(v) != n:
            return f"needs {n} elements"
        inner = replace(t, dims=t.dims[:-1], spark=s.elementType) if len(t.dims) > 1 else t.element
        if inner is None:
            return None if all(isinstance(x, (int, float, dict, list, tuple)) for x in v) else "not numbers"
        return next((r for x in v if (r := _reject(inner, x))), None)
    if isinstance(s, T.BooleanType):
        return None if isinstance(v, bool) else "not a boolean"
    if isinstance(s, T.IntegralType):
        if isinstance(v, bool) or not isinstance(v, int):
            return "not an integer"
        bits = {T.ShortType: 15, T.IntegerType: 31}.get(type(s), 63)
        return None if -(1 << bits) <= v < 1 << bits else "out of range"
    if isinstance(s, T.DecimalType):
        from decimal import Decimal, InvalidOperation

        try:
            d = Decimal(str(v))
        except InvalidOperation:
            return "not a number"
        return None if not d.is_finite() or len(d.as_tuple().digits) - max(0, -d.as_tuple().exponent) <= s.precision - s.scale else "out of range"
    if isinstance(s, T.StringType):
        if not isinstance(v, str):
            return "not a string"
        if t.enum is not None and v not in t.enum.values:
            return f"not one of {', '.join(t.enum.values)}"
        if t.name.startswith(("varchar", "char", "bit")) and t.params:
            if t.name.startswith("bit"):
                return None if re.fullmatch("[01]*", v) and len(v) == t.params[0] else f"not {t.params[0]} bits"
            return None if len(v) <= t.params[0] else f"longer than {t.params[0]}"
        if t.name == "uuid":
            return None if re.match(UUID, v) else "not a uuid"
        return None
    if isinstance(s, T.BinaryType):
        return None if isinstance(v, (bytes, bytearray)) else "not bytes"
    import datetime as dt

    if isinstance(s, T.DateType):
        return None if isinstance(v, dt.date) else "not a date"
    if isinstance(s, (T.TimestampType, T.TimestampNTZType)):
        return None if isinstance(v, dt.datetime) else "not a date and time"
    return None


def _simple(name: str, spark: T.DataType, category: str) -> Callable[[], ColumnType]:
    made = ColumnType(name, spark, category)

    def make() -> ColumnType:
        return made

    make.__name__ = name
    make.__doc__ = f"The type {name}."
    return make


smallint = _simple("smallint", T.ShortType(), "numeric")
integer = _simple("integer", T.IntegerType(), "numeric")
bigint = _simple("bigint", T.LongType(), "numeric")
double = _simple("double", T.DoubleType(), "numeric")
boolean = _simple("boolean", T.BooleanType(), "boolean")
text = _simple("text", T.StringType(), "text")
inet = _simple("inet", T.StringType(), "text")
cidr = _simple("cidr", T.StringType(), "text")
macaddr = _simple("macaddr", T.StringType(), "text")
date = _simple("date", T.DateType(), "datetime")
bytea = _simple("bytea", T.BinaryType(), "bytea")
json = _simple("json", T.StringType(), "json")


def smallserial() -> ColumnType:
    """smallint whose missing values the store numbers."""
    return ColumnType("smallserial", T.ShortType(), "numeric", serial=True)


def serial() -> ColumnType:
    """integer whose missing values the store numbers."""
    return ColumnType("serial", T.IntegerType(), "numeric", serial=True)


def bigserial() -> ColumnType:
    """bigint whose missing values the store numbers."""
    return ColumnType("bigserial", T.LongType(), "numeric", serial=True)


def numeric(precision: int = 38, scale: int | None = None) -> ColumnType:
    """Exact decimals; without arguments 38 digits, 18 of them after the point (Spark has no unbounded decimal)."""
    scale = (18 if precision == 38 else 0) if scale is None else scale
    return ColumnType(f"numeric({precision},{scale})", T.DecimalType(precision, scale), "numeric", params=(precision, scale))


def varchar(n: int = 255) -> ColumnType:
    """Strings of at most n characters."""
    return ColumnType(f"varchar({n})", T.StringType(), "text", lambda c: F.length(c) <= n, params=(n,))


def char(n: int = 1) -> ColumnType:
    """Strings of at most n characters; blanks at the end don't count, and go on read."""
    return ColumnType(f"char({n})", T.StringType(), "text", lambda c: F.length(F.rtrim(c)) <= n, lambda c: F.rtrim(c), params=(n,))


def uuid() -> ColumnType:
    """Strings in the form of a uuid."""
    return ColumnType("uuid", T.StringType(), "text", lambda c: c.rlike(UUID))


def timestamp(precision: int | None = None, with_timezone: bool = False) -> ColumnType:
    """Date and time, without a zone unless asked for."""
    name = "timestamptz" if with_timezone else "timestamp"
    return ColumnType(name, T.TimestampType() if with_timezone else T.TimestampNTZType(), "datetime", params=() if precision is None else (precision,))


def timestamptz(precision: int | None = None) -> ColumnType:
    """A point in time."""
    return timestamp(precision, True)


def time(precision: int | None = None, with_timezone: bool = False) -> ColumnType:
    """Time of day, held as a string hh:mm:ss with an optional fraction (and zone)."""
    zone = "([+-][0-9]{2}(:?[0-9]{2})?|Z)" if with_timezone else ""
    return ColumnType("timetz" if with_timezone else "time", T.StringType(), "time", lambda c: c.rlike(f"^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?{zone}$"), params=() if precision is None else (precision,))


def timetz(precision: int | None = None) -> ColumnType:
    """Time of day with a zone."""
    return time(precision, True)


def jsonb() -> ColumnType:
    """Semi-structured values (Spark's variant)."""
    return ColumnType("jsonb", T.VariantType(), "json")


def enum_column(enum: Any) -> ColumnType:
    """Values of an Enum; they sort in the order of its declaration."""
    return ColumnType(f"enum {enum.name}", T.StringType(), "text", lambda c: c.isin(*enum.values), enum=enum)


def vector(n: int | None = None) -> ColumnType:
    """Float vectors, of n components if given."""
    return ColumnType(f"vector({n or ''})", T.ArrayType(T.FloatType()), "vector", None if n is None else lambda c: F.size(c) == n, params=() if n is None else (n,))


def halfvec(n: int | None = None) -> ColumnType:
    """Vectors that other systems hold in half precision; floats here."""
    return replace(vector(n), name=f"halfvec({n or ''})")


def sparsevec(n: int) -> ColumnType:
    """Strings {i:v,...}/n with indices from 1."""
    return ColumnType(f"sparsevec({n})", T.StringType(), "sparse", lambda c: c.rlike(rf"^\{{(\d+:[^,{{}}]+(,\d+:[^,{{}}]+)*)?\}}/{n}$"), params=(n,))


def bit(n: int = 1) -> ColumnType:
    """Strings of n characters 0 and 1."""
    return ColumnType(f"bit({n})", T.StringType(), "bit", lambda c: c.rlike(f"^[01]{{{n}}}$"), params=(n,))


POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


def _geography(kind: str, depth: int) -> Callable[..., ColumnType]:
    spark: T.DataType = POINT
    for _ in range(depth):
        spark = T.ArrayType(spark)

    def make(srid: int = 4326) -> ColumnType:
        return ColumnType(f"geography({kind},{srid})", spark, "geography" if depth == 0 else "shape", params=())

    make.__name__ = kind
    make.__doc__ = f"Geographic {kind}: longitude and latitude" + (", in nested arrays." if depth else ".")
    return make


point = _geography("point", 0)
linestring = _geography("linestring", 1)
multipoint = _geography("multipoint", 1)
polygon = _geography("polygon", 2)
multilinestring = _geography("multilinestring", 2)
multipolygon = _geography("multipolygon", 3)


def new_uuid7() -> str:
    """A time-ordered uuid (version 7), made on the driver."""
    import os
    import time as clock

    raw = bytearray(int(clock.time() * 1000).to_bytes(6, "big") + os.urandom(10))
    raw[6] = 0x70 | raw[6] & 0x0F
    raw[8] = 0x80 | raw[8] & 0x3F
    return str(_uuid.UUID(bytes=bytes(raw)))


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and (isinstance(v, int) or not math.isnan(v))
