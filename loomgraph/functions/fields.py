"""Access to fields of schemaless elements as Columns.

Metadata is a struct (known keys: pruned and pushed down to the scan) or a VARIANT (open keys).  A
key is a dotted path; a path through a list of structs gives a list.  Integers are read permissively
from numeric strings, booleans and floats; a string field counts as a string only if it is one.  A
list matches if any of its elements does, unless *lists* is false (edges).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Built-in fields of every element.
BUILT_IN = {"@ID": "id", "@Host": "host", "@Origin": "origin", "@CreatedAt": "created_at", "@UpdatedAt": "updated_at", "@DeletedAt": "deleted_at", "@Revision": "revision"}


def _no() -> Column:
    return F.lit(False)


@dataclass
class Fields:
    """Resolves keys against a frame's schema; *roots* maps further names to columns."""

    schema: T.StructType
    metadata: str | None = "metadata"
    roots: dict[str, str] = field(default_factory=dict)
    lists: bool = True

    @classmethod
    def of(cls, df: DataFrame, **kw) -> "Fields":
        return cls(df.schema, **kw)

    def find(self, key: str) -> tuple[Column, T.DataType] | None:
        """Column and type of a key, or None if no element can have it."""
        roots = BUILT_IN | self.roots
        if key in roots:
            return self._walk(F.lit(None), self.schema, roots[key].split("."))
        key = key.removeprefix("Metadata.")
        if self.metadata is None or self.metadata not in self.schema.names:
            return None
        kind = self.schema[self.metadata].dataType
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(F.col(self.metadata), "$." + key, "variant"), kind
        return self._walk(F.lit(None), self.schema, [self.metadata, *key.split(".")])

    def _walk(self, at: Column, kind: T.DataType, path: list[str]) -> tuple[Column, T.DataType] | None:
        top = True
        for name in path:
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if not isinstance(inner, T.StructType) or name not in inner.names:
                return None
            if top:
                at = F.col(f"`{name}`")
            elif isinstance(kind, T.ArrayType):
                nested = isinstance(inner[name].dataType, T.ArrayType)
                at = F.transform(at, lambda x, n=name: x[n])
                at = F.flatten(at) if nested else at
                kind = inner[name].dataType if nested else T.ArrayType(inner[name].dataType)
                continue
            else:
                at = at[name]
            kind, top = inner[name].dataType, False
        return at, kind

    def present(self, key: str) -> Column:
        found = self.find(key)
        return _no() if found is None else found[0].isNotNull()

    def raw(self, key: str) -> Column:
        found = self.find(key)
        return F.lit(None).cast("string") if found is None else found[0]

    def long(self, key: str) -> Column:
        """The scalar as a long, null if it isn't one."""
        found = self.find(key)
        return F.lit(None).cast("long") if found is None else _long(*found)

    def string(self, key: str) -> Column:
        found = self.find(key)
        return F.lit(None).cast("string") if found is None else _string(*found)

    def boolean(self, key: str) -> Column:
        found = self.find(key)
        return F.lit(None).cast("boolean") if found is None else _boolean(*found)

    def any(self, key: str, read: str, test: Callable[[Column], Column]) -> Column:
        """Whether *test* holds for the field, or for an element of a list; never null.  read: long, string or boolean."""
        found = self.find(key)
        if found is None:
            return _no()
        column, kind = found
        reader = {"long": _long, "string": _string, "boolean": _boolean}[read]
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.exists(column, lambda x: F.coalesce(test(reader(x, kind.elementType)), _no())), _no()) if self.lists else _no()
        out = F.coalesce(test(reader(column, kind)), _no())
        if isinstance(kind, T.VariantType) and self.lists:
            items = F.try_variant_get(column, "$", "array<variant>")
            out = out | F.coalesce(F.exists(items, lambda x: F.coalesce(test(reader(x, kind)), _no())), _no())
        return out


def _long(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, "$", "bigint")
    if isinstance(kind, T.StringType):
        return column.try_cast("bigint")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("bigint")
    return F.lit(None).cast("bigint")


def _string(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(column) == "STRING", F.try_variant_get(column, "$", "string"))
    return column if isinstance(kind, T.StringType) else F.lit(None).cast("string")


def _boolean(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(column) == "BOOLEAN", F.try_variant_get(column, "$", "boolean"))
    return column if isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean")
