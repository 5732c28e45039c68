"""Metadata filters: a JSON-like dict compiled to one boolean column.

Logic is two-valued: a missing key is false for every operator but ``$ne`` and
``$nin``, for which it is true; no leaf is ever null, so predicates can be
negated and still reach the scan.  Numbers compare as numbers where both sides
are numeric (``string_compare`` compares texts instead), booleans as booleans,
all else as text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Resolver = Callable[[str], tuple[Column, T.DataType] | None]


def columns_of(df: DataFrame) -> Resolver:
    """Keys are columns of ``df``; any other key is missing."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    return lambda key: (df[key], fields[key]) if key in fields else None


def map_of(col: Column) -> Resolver:
    """Keys of a map<string,string> column."""
    return lambda key: (col.getItem(key), T.StringType())


def json_of(col: Column) -> Resolver:
    """Top-level keys of a column of JSON objects; numbers compare as numbers."""
    return lambda key: (F.get_json_object(col, f"$['{key}']"), T.NullType())


def _text(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def _sides(col: Column, kind: T.DataType, v: Any, string_compare: bool) -> tuple[Column, Column]:
    if isinstance(v, bool):
        if isinstance(kind, T.BooleanType):
            return col, F.lit(v)
    elif isinstance(v, (int, float)) and not string_compare:
        if isinstance(kind, T.NumericType):
            return col, F.lit(v)
        if isinstance(kind, T.NullType):  # JSON: numeric if it reads as a number
            return col.try_cast("double"), F.lit(float(v))
    return col.cast("string"), F.lit(_text(v))


def _leaf(found: tuple[Column, T.DataType] | None, op: str, v: Any, string_compare: bool) -> Column:
    if op in ("$in", "$nin") and not isinstance(v, (list, tuple)):
        raise ValueError(f"{op} takes an array")
    if found is None:
        return F.lit(op in ("$ne", "$nin"))
    col, kind = found
    if op in ("$in", "$nin"):
        any_ = reduce(lambda a, b: a | b, (_leaf(found, "$eq", x, string_compare) for x in v), F.lit(False))
        if v and isinstance(kind, (T.NumericType, T.StringType)) and len({type(x) for x in v}) == 1 and not isinstance(v[0], bool):
            sides = [_sides(col, kind, x, string_compare) for x in v]
            any_ = sides[0][0].isNotNull() & sides[0][0].isin([r for _, r in sides])
        return any_ if op == "$in" else ~any_
    a, b = _sides(col, kind, v, string_compare)
    tests = {"$eq": lambda: a == b, "$ne": lambda: a != b, "$gt": lambda: a > b, "$gte": lambda: a >= b, "$lt": lambda: a < b, "$lte": lambda: a <= b}
    if op not in tests:
        return F.lit(False)
    # Never null, and in a shape that reaches the scan.
    return a.isNull() | tests[op]() if op == "$ne" else a.isNotNull() & tests[op]()


def compile_filter(spec: Mapping[str, Any] | str | None, resolve: Resolver, string_compare: bool = False) -> Column:
    """The column of a filter; an empty one, also inside ``$and`` or ``$or``, is true.

    Keys and operators of one object are joined by AND; ``{"f": v}`` means ``$eq``.
    ``$and``/``$or`` take arrays of filters and nest freely; an empty array is no
    constraint.  An unknown operator is false.
    """
    if isinstance(spec, str):
        spec = json.loads(spec)
    parts = []
    for key, cond in (spec or {}).items():
        if key in ("$and", "$or"):
            if not isinstance(cond, (list, tuple)):
                raise ValueError(f"{key} takes an array of filters")
            subs = [compile_filter(x, resolve, string_compare) for x in cond]
            if subs:
                parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, subs))
        elif isinstance(cond, Mapping):
            parts += [_leaf(resolve(key), op, v, string_compare) for op, v in cond.items()]
        else:
            parts.append(_leaf(resolve(key), "$eq", cond, string_compare))
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)
