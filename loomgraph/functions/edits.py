"""Edits of open (VARIANT) metadata along dotted paths, rebuilt inside the JVM.

An edit is ("set", path, value), ("delete", path), ("append", path, value) or ("remove", path, value); a list of edits applies in
order.  A value is a Python value or a Column.

* set makes the objects on its way; where something else than an object is in the way it changes nothing.
* delete takes the field away, and with it the objects that it leaves empty.
* append adds to a list, and makes one where there is no field; remove takes all equal items out of a list.  Where the
  field is something else they change nothing.

Null metadata is an empty object.  Each object on a path is opened and closed once: its parts are bound by a lambda, so an expression
grows with the length of its paths and not with a power of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.layers import once

OPS = ("set", "delete", "append", "remove")


def variant(value: Any) -> Column:
    """A VARIANT of a Python value, or of a Column's (a struct or map becomes an object)."""
    if not isinstance(value, Column):
        return F.parse_json(F.lit(json.dumps(value)))
    return F.from_json(F.to_json(F.struct(value.alias("v"))), "struct<v:variant>")["v"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """*use* of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _object(value: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _with(fields: Column, key: str, value: Column) -> Column:
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), value)))


def _without(fields: Column, key: str) -> Column:
    return F.to_variant_object(F.map_filter(fields, lambda k, _: k != key))


def _set(at: Column, path: list[str], leaf: Callable[[Column, Column], Column]) -> Column:
    """The value with the path's end as *leaf* (the field there or null, whether there is one) makes it; null if nothing changes."""
    key, rest = path[0], path[1:]

    def inside(fields: Column) -> Column:
        there, child = F.map_contains_key(fields, key), F.try_element_at(fields, F.lit(key))
        new = leaf(child, there) if not rest else _set(F.when(there, child).otherwise(F.parse_json(F.lit("{}"))), rest, leaf)
        return F.when(fields.isNotNull(), bound(new, lambda v: F.when(v.isNotNull(), _with(fields, key, v))))

    return bound(_object(at), inside)


def _delete(at: Column, path: list[str]) -> Column:
    key, rest = path[0], path[1:]

    def inside(fields: Column) -> Column:
        there = fields.isNotNull() & F.map_contains_key(fields, key)
        if not rest:
            return F.when(there, _without(fields, key))
        new = _delete(F.try_element_at(fields, F.lit(key)), rest)
        return F.when(there, bound(new, lambda v: F.when(v.isNotNull(), F.when(F.size(_object(v)) == 0, _without(fields, key)).otherwise(_with(fields, key, v)))))

    return bound(_object(at), inside)


def _list(child: Column) -> Column:
    return F.try_variant_get(child, "$", "array<variant>")


def edited(metadata: Column, *ops: tuple) -> Column:
    """The metadata after the edits, as one expression; for many or deep edits take :func:`applied`."""
    out = F.coalesce(metadata, F.parse_json(F.lit("{}")))
    for name, path, *value in ops:
        if name not in OPS or len(value) != (name != "delete"):
            raise ValueError(f"unknown edit {name}")
        keys = path.split(".")
        if name == "delete":
            new = lambda v, keys=keys: _delete(v, keys)
        else:
            given = variant(value[0])
            leaf = {
                "set": lambda child, there, x=given: x,
                "append": lambda child, there, x=given: F.when(there, bound(_list(child), lambda items: F.when(items.isNotNull(), F.array_append(items, x).cast("variant")))).otherwise(F.array(x).cast("variant")),
                "remove": lambda child, there, x=given: bound(_list(child), lambda items: F.when(items.isNotNull(), F.filter(items, lambda i: ~F.to_json(F.struct(i.alias("v"))).eqNullSafe(F.to_json(F.struct(x.alias("v"))))).cast("variant"))),
            }[name]
            new = lambda v, keys=keys, leaf=leaf: _set(v, keys, leaf)
        out = bound(out, _or_same(new))
    return out


def _or_same(new: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(new(v), v)


def applied(rows: DataFrame, column: str, *ops: tuple) -> DataFrame:
    """The rows with a column after the edits, one step of the plan for each edit.  Columns among the values are those of *rows*, before any edit."""
    out = once(rows, "_edited", F.col(column))
    for op in ops:
        out = once(out, "_next", edited(F.col("_edited"), op)).drop("_edited").withColumnRenamed("_next", "_edited")
    return out.select(*[F.col("_edited").alias(c) if c == column else F.col(f"`{c}`") for c in rows.columns])
