"""Selectors: nested conditions as JSON or dictionaries, compiled to columns."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SelectorError(ValueError):
    """A selector that has no meaning for the table."""


def field(path: str, schema: T.StructType) -> Column | None:
    """Column of a dotted path through structs and maps; None if the schema has no such field."""
    out, kind = None, schema
    for part in path.split("."):
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            out, kind = (F.col(f"`{part}`") if out is None else out.getField(part)), kind[part].dataType
        elif isinstance(kind, T.MapType):
            out, kind = out.getItem(part), kind.valueType
        else:
            return None
    return out


#: Conditions on one field by operator; missing fields read as null.
COMPARE = {
    "$eq": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "$ne": lambda c, v: c.isNotNull() if v is None else F.coalesce(c != F.lit(v), F.lit(True)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(v),
    "$nin": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False)),
    "$regex": lambda c, v: c.rlike(v),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def compile_selector(selector: dict | str, schema: T.StructType) -> Column:
    """A condition for where(): what cannot be decided is null and does not match.

    It stays a plain conjunction, so its parts reach the scan."""
    return _compiled(json.loads(selector) if isinstance(selector, str) else selector, schema, None)


def _compiled(node, schema: T.StructType, path: str | None) -> Column:
    if not isinstance(node, dict):
        return COMPARE["$eq"](_column(path, schema), node)
    parts = []
    for key, value in node.items():
        if key == "$and":
            parts.append(_all([_compiled(x, schema, path) for x in _listed(value, path)]))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, [F.coalesce(_compiled(x, schema, path), F.lit(False)) for x in _listed(value, path)], F.lit(False)))
        elif key == "$nor":
            parts.append(~reduce(lambda a, b: a | b, [F.coalesce(_compiled(x, schema, path), F.lit(False)) for x in _listed(value, path)], F.lit(False)))
        elif key == "$not":
            parts.append(~F.coalesce(_compiled(value, schema, path), F.lit(False)))
        elif key.startswith("$"):
            if path is None or key not in COMPARE:
                raise SelectorError(f"{key} is no condition here")
            parts.append(COMPARE[key](_column(path, schema), value))
        else:
            parts.append(_compiled(value, schema, key if path is None else f"{path}.{key}"))
    return _all(parts)


def _listed(value, path):
    """Members of a list of conditions; an object of several operators counts as one for each."""
    return value if isinstance(value, list) else [{k: v} for k, v in value.items()]


def _column(path: str, schema: T.StructType) -> Column:
    found = field(path, schema)
    return F.lit(None) if found is None else found


def find(df: DataFrame, selector: dict | str, fields: list[str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows that a selector matches, projected, ordered and limited, in that sense of the words."""
    out = df.where(compile_selector(selector, df.schema))
    if order:
        out = out.orderBy(order)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*fields) if fields else out


#: Documents that nobody has claimed, that have a picture, and that no event was made of.
NEXT_DOCUMENT = {"$and": [{"$not": {"processed_by": {"$and": [{"$exists": True}, {"$ne": None}]}}}, {"attachments.userimage": {"$exists": True}}, {"$not": {"event_id": {"$exists": True}}}]}
