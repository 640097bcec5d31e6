"""Statements and expressions of the SQL dialect; str() gives SQL text again."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self):
        if isinstance(self.value, str):
            return "'" + self.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(self.value)


@dataclass(frozen=True)
class Name:
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Negation:
    part: object

    def __str__(self):
        return f"NOT {self.part}"


@dataclass(frozen=True)
class Between:
    value: object
    low: object
    high: object

    def __str__(self):
        return f"({self.value} BETWEEN {self.low} AND {self.high})"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None

    def __str__(self):
        return f"{self.expr} AS {self.alias}" if self.alias else str(self.expr)


@dataclass(frozen=True)
class Select:
    items: tuple | None  # None: all columns
    table: str
    where: object = None

    def __str__(self):
        return f"SELECT {'*' if self.items is None else ', '.join(map(str, self.items))} FROM {self.table}" + _where(self.where)


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple
    rows: tuple

    def __str__(self):
        names = f" ({', '.join(self.columns)})" if self.columns else ""
        return f"INSERT INTO {self.table}{names} VALUES " + ", ".join(f"({', '.join(map(str, r))})" for r in self.rows)


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple  # (column, expression)
    where: object = None

    def __str__(self):
        return f"UPDATE {self.table} SET {', '.join(f'{c} = {e}' for c, e in self.sets)}" + _where(self.where)


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None

    def __str__(self):
        return f"DELETE FROM {self.table}" + _where(self.where)


def _where(expr):
    return "" if expr is None else f" WHERE {expr}"
