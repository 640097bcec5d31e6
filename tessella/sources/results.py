"""Results as text: CSV, JSON, text cells, pages.

Sinks for large results are distributed writes; the in-memory forms stream the
rows to the driver for results that a person reads.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, NotFound, OutOfRange
from tessella.functions.scalar import kind_of_type, kind_of_value, text

TYPE_NAMES = {"null": "Null", "int": "Integer", "float": "Float", "string": "String", "bool": "Boolean"}


def text_cells(df: DataFrame) -> DataFrame:
    """Every cell in its text form; NULL stays NULL."""
    out = []
    for f in df.schema.fields:
        column, kind = F.col(f"`{f.name}`"), kind_of_type(f.dataType)
        out.append((F.when(column.isNotNull(), text(column, kind)) if kind else column.cast("string")).alias(f.name))
    return df.select(*out)


def csv_lines(df: DataFrame, sep: str = ",", always_quote: bool = False, quote: str = '"') -> DataFrame:
    """(line): one line a row, quotes doubled; NULL is an empty field."""
    def cell(name):
        c = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        quoted = F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        needs = F.lit(always_quote)
        for mark in (sep, quote, "\n", "\r"):
            needs = needs | F.contains(c, F.lit(mark))
        return F.when(needs, quoted).otherwise(c)

    return text_cells(df).select(F.concat_ws(sep, *[cell(n) for n in df.columns]).alias("line"))


def to_csv(df: DataFrame, sep: str = ",", header: bool = True, always_quote: bool = False, quote: str = '"') -> str:
    def name(n):
        return quote + n.replace(quote, quote * 2) + quote if always_quote or any(m in n for m in (sep, quote, "\n", "\r")) else n

    lines = [sep.join(map(name, df.columns))] if header else []
    lines += [r.line for r in csv_lines(df, sep, always_quote, quote).toLocalIterator()]
    return "".join(x + "\n" for x in lines)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, always_quote: bool = False) -> None:
    df.write.option("header", header).option("sep", sep).option("quoteAll", always_quote).option("escape", '"').csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """(json): one object a row, with NULLs."""
    return df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def to_json(df: DataFrame, metadata: bool = False, indent: int = 0) -> str:
    rows = [json.loads(r.json) for r in json_lines(df).toLocalIterator()]
    types = [TYPE_NAMES.get(kind_of_type(f.dataType), "String") for f in df.schema.fields]
    out = {"columns": df.columns, "types": types, "rows": rows} if metadata else rows
    return json.dumps(out, indent=indent or None, separators=(",", ": " if indent else ":"), ensure_ascii=False)


def total_pages(rows: int, size: int) -> int:
    return math.ceil(rows / size) if size > 0 else 0


def page_bounds(rows: int, size: int, number: int) -> tuple[int, int]:
    """The half-open interval of a page's rows."""
    if size <= 0 or number < 0 or number >= total_pages(rows, size):
        raise OutOfRange(f"no page {number}")
    return number * size, min(rows, (number + 1) * size)


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """One page in a total order."""
    if size <= 0 or number < 0:
        raise OutOfRange(f"no page {number}")
    return df.orderBy(*order).offset(number * size).limit(size)


def column_index(df: DataFrame, name: str) -> int:
    if name not in df.columns:
        raise NotFound(f"no column {name}")
    return df.columns.index(name)


class Cursor:
    """Rows one by one, partition after partition."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.reset()

    def reset(self):
        self._rows, self.current = self.df.toLocalIterator(), None

    def next(self) -> bool:
        self.current = next(self._rows, None)
        return self.current is not None

    def _typed(self, column, kinds, convert):
        value = self.at(column)
        if value is None or kind_of_value(value) not in kinds:
            raise InvalidArgument(f"column {column} holds no such value")
        return convert(value)

    def int_at(self, column) -> int:
        return self._typed(column, ("int",), int)

    def float_at(self, column) -> float:
        """A number as a float."""
        return self._typed(column, ("int", "float"), float)

    def bool_at(self, column) -> bool:
        return self._typed(column, ("bool",), bool)

    def string_at(self, column) -> str:
        return self._typed(column, ("string",), str)

    def is_null(self, column) -> bool:
        return self.at(column) is None

    def type_of(self, column) -> str:
        """The declared type's name."""
        field = self.df.schema[column if isinstance(column, int) else column_index(self.df, column)]
        return TYPE_NAMES.get(kind_of_type(field.dataType), "String")

    def at(self, column):
        return self.current[column if isinstance(column, int) else column_index(self.df, column)]
