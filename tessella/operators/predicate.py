"""Predicate trees over columns, compiled to two-valued Column expressions.

A comparison is false where a side is NULL or the column is unknown; NOT
inverts that, so that a negated comparison holds on NULL.  An empty AND is
true, an empty OR and an empty NOT are false.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidArgument
from tessella.functions.scalar import OPS, kind_of_type, kind_of_value, literal, ordered, other


@dataclass(frozen=True)
class Cmp:
    column: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPS:
            raise InvalidArgument(f"no comparison {self.op}")


@dataclass(frozen=True)
class And:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Not:
    part: object = None


def cmp(column, op, value):
    return Cmp(column, op, value)


def all_of(*parts):
    return And(tuple(parts))


def any_of(*parts):
    return Or(tuple(parts))


def negation(part=None):
    return Not(part)


def columns_of(pred) -> set[str]:
    if isinstance(pred, Cmp):
        return {pred.column}
    parts = pred.parts if isinstance(pred, (And, Or)) else [pred.part] if isinstance(pred, Not) and pred.part is not None else []
    return set().union(*map(columns_of, parts))


def check_columns(pred, known) -> None:
    if pred is not None and (unknown := columns_of(pred) - set(known)):
        raise InvalidArgument(f"unknown column {sorted(unknown)[0]}")


def compile_with(pred, compare) -> Column:
    """``compare`` maps a Cmp to a Column that is NULL or false where it does not hold."""
    if isinstance(pred, Cmp):
        return F.coalesce(compare(pred), F.lit(False))
    if isinstance(pred, And):
        return reduce(lambda a, b: a & b, [compile_with(p, compare) for p in pred.parts], F.lit(True))
    if isinstance(pred, Or):
        return reduce(lambda a, b: a | b, [compile_with(p, compare) for p in pred.parts], F.lit(False))
    if isinstance(pred, Not):
        return F.lit(False) if pred.part is None else ~compile_with(pred.part, compare)
    raise InvalidArgument(f"no predicate: {pred!r}")


def _known(p: Cmp, schema: T.StructType):
    """(column, kind) of a comparison that can hold, else None."""
    if p.column not in schema.names or p.value is None:
        return None
    kind = kind_of_type(schema[p.column].dataType)
    if kind is None:
        raise InvalidArgument(f"column {p.column} is no scalar")
    return F.col(f"`{p.column}`"), kind


def to_column(pred, schema: T.StructType) -> Column:
    """A two-valued column: never NULL."""

    def compare(p: Cmp) -> Column:
        known = _known(p, schema)
        return ordered(*known, p.op, literal(p.value), kind_of_value(p.value)) if known else F.lit(False)

    return compile_with(pred, compare)


def to_filter(pred, schema: T.StructType, holds: bool = True) -> Column:
    """The rows on which ``pred`` holds (or, with ``holds`` false, all others) as
    plain comparisons and IS NULL, which a scan can take; NULL stands for false."""
    if isinstance(pred, Cmp):
        known = _known(pred, schema)
        if not known:
            return F.lit(not holds)
        return (ordered if holds else other)(*known, pred.op, literal(pred.value), kind_of_value(pred.value))
    if isinstance(pred, (And, Or)):
        both = isinstance(pred, And) == holds
        return reduce(lambda a, b: a & b if both else a | b, [to_filter(p, schema, holds) for p in pred.parts], F.lit(isinstance(pred, And) == holds))
    if isinstance(pred, Not):
        return F.lit(not holds) if pred.part is None else to_filter(pred.part, schema, not holds)
    raise InvalidArgument(f"no predicate: {pred!r}")
