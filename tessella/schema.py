"""Declared schemas and their Spark form.

Column constraints travel in the field metadata of a StructType, so that
``StructType.json()`` is the lossless schema codec.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from tessella.errors import AlreadyExists, InvalidArgument, NotFound

TYPES = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "null": T.StringType()}
GRANULARITIES = ("ns", "us", "ms", "s", "m", "h", "d")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = True
    unique: bool = False
    min_length: int | None = None
    max_length: int | None = None
    one_of: tuple[str, ...] = ()
    min_value: float | None = None
    max_value: float | None = None

    def field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.kind], True, {"column": {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v not in (None, ())}})

    @classmethod
    def of(cls, field: T.StructField) -> Column:
        known = dict(field.metadata.get("column", {}))
        if "one_of" in known:
            known["one_of"] = tuple(known["one_of"])
        if not known:
            from tessella.functions.scalar import kind_of_type

            known = {"name": field.name, "kind": kind_of_type(field.dataType) or "string", "nullable": True}
        return cls(**known)


class TableSchema:
    """Ordered columns, with an optional primary key that is declared, not enforced."""

    def __init__(self, columns, primary_key: str | None = None):
        self.columns = list(columns)
        if len({c.name for c in self.columns}) != len(self.columns):
            raise InvalidArgument("a column name occurs twice")
        self.primary_key = None
        if primary_key is not None:
            self.set_primary_key(primary_key)

    @property
    def names(self):
        return [c.name for c in self.columns]

    def get(self, name) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise NotFound(f"no column {name}")

    def add(self, column: Column):
        if column.name in self.names:
            raise AlreadyExists(f"column {column.name} exists")
        self.columns.append(column)

    def remove(self, name):
        self.columns.remove(self.get(name))
        if self.primary_key == name:
            self.primary_key = None

    def update(self, column: Column):
        self.columns[self.columns.index(self.get(column.name))] = column

    def set_primary_key(self, name):
        if name not in self.names:
            raise InvalidArgument(f"no column {name}")
        self.primary_key = name

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def json(self) -> str:
        import json

        return json.dumps({"schema": json.loads(self.struct().json()), "primary_key": self.primary_key})

    @classmethod
    def of_json(cls, text: str) -> TableSchema:
        import json

        got = json.loads(text)
        return cls([Column.of(f) for f in T.StructType.fromJson(got["schema"])], got["primary_key"])


class DocumentSchema:
    """Known fields by name; documents may have others."""

    def __init__(self, fields=()):
        self.fields = {c.name: c for c in fields}

    def add(self, column: Column):
        self.fields[column.name] = column

    def remove(self, name):
        if name not in self.fields:
            raise NotFound(f"no field {name}")
        del self.fields[name]

    def get(self, name) -> Column:
        if name not in self.fields:
            raise NotFound(f"no field {name}")
        return self.fields[name]


class SeriesSchema:
    """Timestamp, tag and value columns, with retention."""

    def __init__(self, timestamp: str = "timestamp", tags=(), values=(), granularity: str = "ms", ttl_seconds: int = 0, max_rows: int = 0, drop_oldest: bool = True):
        if granularity not in GRANULARITIES:
            raise InvalidArgument(f"no granularity {granularity}")
        self.timestamp, self.granularity = timestamp, granularity
        self.tags, self.values = list(tags), list(values)
        self.ttl_seconds, self.max_rows, self.drop_oldest = ttl_seconds, max_rows, drop_oldest

    def _find(self, name):
        return next((g for g in (self.tags, self.values) if any(c.name == name for c in g)), None)

    def _add(self, group, column):
        if column.name == self.timestamp or self._find(column.name) is not None:
            raise AlreadyExists(f"column {column.name} exists")
        group.append(column)

    def add_tag(self, column: Column):
        self._add(self.tags, column)

    def add_value(self, column: Column):
        self._add(self.values, column)

    def get(self, name) -> Column:
        group = self._find(name)
        if group is None:
            raise NotFound(f"no column {name}")
        return next(c for c in group if c.name == name)

    def remove(self, name):
        self._find(name).remove(self.get(name)) if self._find(name) is not None else self.get(name)

    def table(self) -> TableSchema:
        return TableSchema([Column(self.timestamp, "int", nullable=False), *self.tags, *self.values])
