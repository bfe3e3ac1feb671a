"""Maps, products and flattening at any depth of nested arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType


def depth_of(kind: DataType) -> int:
    """Levels of arrays in a column's type."""
    return 1 + depth_of(kind.elementType) if isinstance(kind, ArrayType) else 0


def mapped(nested: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """``f`` of every element at a depth: at 0 of the column, at 1 of its elements, and so on. Null levels stay null, empty ones empty."""
    return f(nested) if depth == 0 else F.transform(nested, lambda x: mapped(x, depth - 1, f))


def distributed(nested: Column, values: Column, level: int) -> Column:
    """At ``level``, each list becomes a list of copies of it, each with one of ``values`` appended. A null list stays null."""
    return mapped(nested, level, lambda x: F.when(x.isNotNull(), F.transform(values, lambda v: F.concat(x, F.array(v)))))


def flattened(nested: Column, level: int) -> Column:
    """The elements at a depth as one list: at 0 the column alone, at 1 its elements. Null levels on the way have no elements."""
    if level == 0:
        return F.array(nested)
    if level == 1:
        return F.coalesce(nested, F.slice(nested, 1, 0), F.array())
    return F.flatten(F.transform(F.filter(F.coalesce(nested, F.array()), lambda x: x.isNotNull()), lambda x: flattened(x, level - 1)))
