"""Scalar semantics as Column expressions: kinds, order across kinds, text forms, truth.

Values are of five kinds, in this order: null, int, float, string, bool.  Values
of one kind compare as usual, int and float as doubles, others by their kind.
"""

from __future__ import annotations

import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidArgument

KINDS = ("null", "int", "float", "string", "bool")
RANK = {k: i for i, k in enumerate(KINDS)}
SPARK_TYPE = {"null": "string", "int": "bigint", "float": "double", "string": "string", "bool": "boolean"}
OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
MIRRORED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
INVERTED = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def kind_of_type(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType,)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "null" if isinstance(dtype, T.NullType) else None


def kind_of_value(value) -> str:
    for kind, types in (("null", type(None)), ("bool", bool), ("int", int), ("float", float), ("string", str)):
        if isinstance(value, types):
            return kind
    raise InvalidArgument(f"a value of {type(value).__name__} is no scalar")


def literal(value) -> Column:
    return F.lit(value).cast(SPARK_TYPE[kind_of_value(value)])


def numeric(kind: str) -> bool:
    return kind in ("int", "float")


def ordered(column: Column, kind: str, op: str, other: Column, other_kind: str) -> Column:
    """``column op other`` for two non-null values of known kinds; NULL where one is NULL."""
    if kind == other_kind:
        return OPS[op](column, other)
    if numeric(kind) and numeric(other_kind):
        return OPS[op](column.cast("double"), other.cast("double"))
    known = F.lit(bool(OPS[op](RANK[kind], RANK[other_kind])))
    return F.when(column.isNotNull() & other.isNotNull(), known)


def other(column: Column, kind: str, op: str, value: Column, value_kind: str) -> Column:
    """Where ``column op value`` does not hold: the inverse comparison, or a NULL; both reach a scan."""
    return column.isNull() | ordered(column, kind, INVERTED[op], value, value_kind)


def compared(column: Column, kind: str, op: str, other: Column, other_kind: str) -> Column:
    """Two-valued comparison in which NULL is below every value and equal to itself."""
    sides = F.when(column.isNull() & other.isNull(), F.lit(bool(OPS[op](0, 0))))
    sides = sides.when(column.isNull(), F.lit(bool(OPS[op](0, 1)))).when(other.isNull(), F.lit(bool(OPS[op](1, 0))))
    return sides.otherwise(ordered(column, kind, op, other, other_kind))


def refuse(message: str) -> Column:
    return F.raise_error(F.lit(f"InvalidArgument: {message}"))


def truth(column: Column, kind: str) -> Column:
    """0, 0.0 and the empty string are false; NULL has no truth."""
    own = {"bool": column, "int": column != 0, "float": column != 0.0, "string": F.octet_length(column) > 0}.get(kind, F.lit(None).cast("boolean"))
    return F.when(column.isNull(), refuse("NULL is neither true nor false").cast("boolean")).otherwise(own)


def text_of_double(x: Column) -> Column:
    """15 significant digits without trailing zeros, as C's %.15g."""
    made = F.format_string("%.15g", x)
    short = F.regexp_replace(F.regexp_replace(made, r"(\.\d*?)0*(e|$)", "$1$2"), r"\.(e|$)", "$1")
    plain = F.when(F.isnan(x), "nan").when(x == math.inf, "inf").when(x == -math.inf, "-inf").otherwise(short)
    return F.when(x.isNull(), "null").otherwise(plain)


def text(column: Column, kind: str) -> Column:
    if kind == "float":
        return text_of_double(column.cast("double"))
    return F.coalesce(column.cast("string"), F.lit("null"))


def arithmetic(op: str, a: Column, ka: str, b: Column, kb: str) -> tuple[Column, str]:
    if op == "+" and "string" in (ka, kb):
        return F.concat(text(a, ka), text(b, kb)), "string"
    if not (numeric(ka) and numeric(kb)):
        raise InvalidArgument(f"{op} needs numbers, not {ka} and {kb}")
    missing = a.isNull() | b.isNull()
    if op == "/":
        divisor = b.cast("double")
        out = F.when(divisor == 0.0, refuse("division by zero").cast("double")).otherwise(a.cast("double") / F.when(divisor != 0.0, divisor))
        return F.when(missing, refuse("arithmetic on NULL").cast("double")).otherwise(out), "float"
    kind = "int" if ka == kb == "int" else "float"
    a, b = a.cast(SPARK_TYPE[kind]), b.cast(SPARK_TYPE[kind])
    out = {"+": operator.add, "-": operator.sub, "*": operator.mul}[op](a, b)
    return F.when(missing, refuse("arithmetic on NULL").cast(SPARK_TYPE[kind])).otherwise(out), kind
