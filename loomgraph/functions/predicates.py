"""Predicates of Has steps: objects that give a Column for a field; a bare value is equality.

All give true or false, never null.  Comparisons read longs; fractions of literals are cut off.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.fields import Fields


def equal(fields: Fields, key: str, value: Any) -> Column:
    if isinstance(value, bool):
        return fields.any(key, "boolean", lambda x: x == F.lit(value))
    if isinstance(value, (int, float)):
        return fields.any(key, "long", lambda x: x == F.lit(int(value)))
    if isinstance(value, str):
        return fields.any(key, "string", lambda x: x == F.lit(value))
    raise TypeError(f"a {type(value).__name__} can't be compared with a field")


class Predicate:
    def column(self, fields: Fields, key: str) -> Column:
        raise NotImplementedError


@dataclass
class Ne(Predicate):
    """Present and not equal; of a boolean: equal to its opposite."""

    value: Any

    def column(self, fields, key):
        if isinstance(self.value, bool):
            return equal(fields, key, not self.value)
        return fields.present(key) & ~equal(fields, key, self.value)


@dataclass
class Nee(Predicate):
    """Not equal, or absent; of a boolean: equal to its opposite."""

    value: Any

    def column(self, fields, key):
        return equal(fields, key, not self.value) if isinstance(self.value, bool) else ~equal(fields, key, self.value)


@dataclass
class Lt(Predicate):
    value: float

    def column(self, fields, key):
        return fields.any(key, "long", lambda x: x < int(self.value))


@dataclass
class Lte(Predicate):
    value: float

    def column(self, fields, key):
        return fields.any(key, "long", lambda x: x <= int(self.value))


@dataclass
class Gt(Predicate):
    value: float

    def column(self, fields, key):
        return fields.any(key, "long", lambda x: x > int(self.value))


@dataclass
class Gte(Predicate):
    value: float

    def column(self, fields, key):
        return fields.any(key, "long", lambda x: x >= int(self.value))


@dataclass
class Inside(Predicate):
    """Above low and below high; of a list, each side by any element."""

    low: float
    high: float

    def column(self, fields, key):
        return Gt(self.low).column(fields, key) & Lt(self.high).column(fields, key)


@dataclass
class Between(Predicate):
    """From low, below high."""

    low: float
    high: float

    def column(self, fields, key):
        return Gte(self.low).column(fields, key) & Lt(self.high).column(fields, key)


@dataclass
class Outside(Predicate):
    """Below low and above high: both, so only a list can match."""

    low: float
    high: float

    def column(self, fields, key):
        return Lt(self.low).column(fields, key) & Gt(self.high).column(fields, key)


class Within(Predicate):
    def __init__(self, *values: Any):
        self.values = values

    def column(self, fields, key):
        texts = [v for v in self.values if isinstance(v, str)]
        numbers = [int(v) for v in self.values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        out = [equal(fields, key, v) for v in self.values if isinstance(v, bool)]
        if texts:
            out.append(fields.any(key, "string", lambda x: x.isin(texts)))
        if numbers:
            out.append(fields.any(key, "long", lambda x: x.isin(numbers)))
        return or_(*out)


class Without(Predicate):
    """None of the values; an absent field passes."""

    def __init__(self, *values: Any):
        self.values = values

    def column(self, fields, key):
        return ~Within(*self.values).column(fields, key) if self.values else F.lit(True)


class Regex(Predicate):
    """The pattern between ^ and $ as text: an alternation is anchored on one side each."""

    def __init__(self, pattern: str):
        if pattern.startswith("^") or pattern.endswith("$"):
            raise ValueError("the pattern is anchored already")
        self.pattern = f"^{pattern}$"

    def column(self, fields, key):
        return fields.any(key, "string", lambda x: x.rlike(self.pattern))


class Ipv4Range(Predicate):
    """An IPv4 address, with or without a prefix length, inside a network; compared as numbers."""

    def __init__(self, cidr: str):
        self.network = ipaddress.IPv4Network(cidr, strict=False)

    def column(self, fields, key):
        low, high = int(self.network.network_address), int(self.network.broadcast_address)
        return fields.any(key, "string", lambda x: ipv4(x).between(low, high))


def ipv4(address: Column) -> Column:
    """An address as a number, null if it isn't one."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    plain = F.when(address.rlike(rf"^{octet}(\.{octet}){{3}}(/[0-9]{{1,2}})?$"), F.split_part(address, F.lit("/"), F.lit(1)))
    part = [F.split_part(plain, F.lit("."), F.lit(i + 1)).cast("bigint") for i in range(4)]
    return part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]


def test(fields: Fields, key: str, value: Any) -> Column:
    return value.column(fields, key) if isinstance(value, Predicate) else equal(fields, key, value)


def pairs(args: tuple) -> list[tuple[str, Any]]:
    if len(args) % 2:
        raise ValueError("keys and values must come in pairs")
    return list(zip(args[::2], args[1::2]))


def has(fields: Fields, args: tuple) -> Column:
    """All pairs hold; one argument alone: the key is present; none: true."""
    if len(args) == 1:
        return fields.present(args[0])
    return and_(*(test(fields, k, v) for k, v in pairs(args)))


def has_either(fields: Fields, args: tuple) -> Column:
    return fields.present(args[0]) if len(args) == 1 else or_(*(test(fields, k, v) for k, v in pairs(args)))


def metadata(*args: Any) -> dict[str, Any]:
    """Keys and values that a path step's nodes or edges must have."""
    return dict(pairs(args))


# Combinators; an empty conjunction or disjunction is true, and not_ means that some child is false.


def and_(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True)) if columns else F.lit(True)


def or_(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(True)


def not_(*columns: Column) -> Column:
    return ~and_(*columns)


def null(fields: Fields, key: str) -> Column:
    return ~fields.present(key)


def not_null(fields: Fields, key: str) -> Column:
    return fields.present(key)


def active_in(fields: Fields, start: int, to: int, first: str = "Start", last: str = "Last") -> Column:
    return and_(Lte(to).column(fields, first), Gte(start).column(fields, last))


def included_in(fields: Fields, start: int, to: int, first: str = "Start", last: str = "Last") -> Column:
    return and_(Gte(start).column(fields, first), Lte(to).column(fields, last))


def or_term_string(fields: Fields, key: str, values: list[str]) -> Column:
    return Within(*values).column(fields, key)
