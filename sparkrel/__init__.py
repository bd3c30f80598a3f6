"""A PySpark-native typed relational query engine.

Tables, enums and relations are declared once; immutable builders lower to
Spark DataFrames, which Catalyst plans.
"""

from . import functions, types
from .engine import Engine
from .expr import Aggregate, Arg, ColumnRef, Expr, Filter, QueryError, Raw, sql
from .functions import *  # noqa: F403
from .operators.filters import *  # noqa: F403
from .operators.prepared import Prepared, prepare
from .operators.select import asc, desc
from .plans.relational import RelationError
from .schema import Check, Col, Enum, ForeignKey, Index, PrimaryKey, Reference, Relation, Relations, Sequence, Table, Unique, fk, many, one, pk, relations
from .sources import Frames, Jdbc, ParquetFolder, Store
from .validate import Validator, insert_validator, update_validator

__all__ = [n for n in dir() if not n.startswith("_")]


def is_table(x) -> bool:
    return isinstance(x, Table)


def is_enum(x) -> bool:
    return isinstance(x, Enum)


def is_sequence(x) -> bool:
    return isinstance(x, Sequence)
