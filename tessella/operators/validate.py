"""Row checks as one error column, and uniqueness as one aggregation per column."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import FailedPrecondition, InvalidArgument
from tessella.functions.scalar import kind_of_type, kind_of_value, text
from tessella.schema import Column, TableSchema


def column_error(c: Column, value: SparkColumn) -> SparkColumn:
    """Why a value of the column's own type breaks its constraints, or NULL."""
    tests = [] if c.nullable else [(value.isNull(), f"{c.name} is null")]
    if c.kind == "string":
        if c.min_length is not None:
            tests.append((F.octet_length(value) < c.min_length, f"{c.name} is too short"))
        if c.max_length is not None:
            tests.append((F.octet_length(value) > c.max_length, f"{c.name} is too long"))
        if c.one_of:
            tests.append((~value.isin(*c.one_of), f"{c.name} is not allowed"))
    if c.kind in ("int", "float"):
        if c.min_value is not None:
            tests.append((value < c.min_value, f"{c.name} is too small"))
        if c.max_value is not None:
            tests.append((value > c.max_value, f"{c.name} is too large"))
    return F.coalesce(*[F.when(t, F.lit(m)) for t, m in tests], F.lit(None).cast("string"))


def row_errors(df: DataFrame, schema: TableSchema) -> DataFrame:
    """``df`` with a column ``error``: the first broken rule of each row, or NULL."""
    return df.withColumn("error", F.coalesce(*[column_error(c, F.col(f"`{c.name}`")) for c in schema.columns], F.lit(None).cast("string")))


def check_types(schema: TableSchema, names, struct: T.StructType) -> None:
    """Declared against actual types; a float column accepts ints."""
    for name in names:
        want, got = schema.get(name).kind, kind_of_type(struct[name].dataType)
        if got not in (want, "null") and not (want == "float" and got == "int"):
            raise InvalidArgument(f"{name} is {want}, not {got}")


def duplicates(df: DataFrame, column: str, ignore_nulls: bool = True) -> DataFrame:
    """(value, count) of values that occur more than once, by text form."""
    kind = kind_of_type(df.schema[column].dataType) or "string"
    value = F.when(F.col(f"`{column}`").isNotNull(), text(F.col(f"`{column}`"), kind))
    rows = df.select(value.alias("value"))
    rows = rows.where("value is not null") if ignore_nulls else rows
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def check_rows(df: DataFrame, schema: TableSchema) -> None:
    bad = row_errors(df.select(*[f"`{n}`" for n in schema.names]), schema).where("error is not null").select("error").head(1)
    if bad:
        raise InvalidArgument(bad[0].error)


def check_unique(df: DataFrame, schema: TableSchema, ignore_nulls: bool = True) -> None:
    """Fails if a unique column repeats a value; one aggregation for all columns."""
    names = [c.name for c in schema.columns if c.unique]
    if not names:
        return
    form = lambda n: F.when(F.col(f"`{n}`").isNotNull(), text(F.col(f"`{n}`"), kind_of_type(df.schema[n].dataType) or "string"))
    counts = [x for n in names for x in (F.count(form(n)), F.count_distinct(form(n)))]
    rows, *found = df.agg(F.count(F.lit(1)), *counts).first()
    for name, count, distinct in zip(names, found[::2], found[1::2]):
        if distinct < count or not ignore_nulls and rows - count > 1:
            raise FailedPrecondition(f"{name} is not unique")


def document_error(document: dict, fields: dict[str, Column]) -> str | None:
    """The first broken rule of one document given as a dict; further fields are allowed."""
    for name, c in fields.items():
        value = document.get(name)
        if value is None:
            if not c.nullable:
                return f"{name} is missing"
            continue
        kind = kind_of_value(value)
        if kind != c.kind and not (c.kind == "float" and kind == "int"):
            return f"{name} is {c.kind}, not {kind}"
        size = len(value.encode()) if kind == "string" else 0
        if kind == "string" and (size < (c.min_length or 0) or c.max_length is not None and size > c.max_length or c.one_of and value not in c.one_of):
            return f"{name} breaks its constraints"
        if kind in ("int", "float") and (c.min_value is not None and value < c.min_value or c.max_value is not None and value > c.max_value):
            return f"{name} is out of range"
    return None
