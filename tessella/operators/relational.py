"""Tables: a schema and an immutable DataFrame behind a name.

Each change builds a new DataFrame, checks it, and only then takes its place,
so that a failed change leaves the table as it was.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import AlreadyExists, EngineError, InvalidArgument, NotFound
from tessella.functions.scalar import kind_of_value
from tessella.operators import predicate as P
from tessella.operators.validate import check_rows, check_types, check_unique
from tessella.plans import ast, compiler
from tessella.plans.compiler import SEQ, visible
from tessella.plans.parser import parse, signed
from tessella.schema import Column, TableSchema

#: Changes after which a table's lineage is cut, where the session has a checkpoint folder.
CUT_EVERY = 20


@dataclass
class Table:
    schema: TableSchema
    df: DataFrame
    changes: int = 0


class Relational:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.lock = spark, {}, threading.RLock()

    # catalog

    def create(self, name: str, schema: TableSchema) -> None:
        with self.lock:
            if name in self.tables:
                raise AlreadyExists(f"table {name} exists")
            self.tables[name] = Table(schema, self._empty(schema))

    def register(self, name: str, df: DataFrame, order: str | None = None) -> None:
        """An existing DataFrame as a table; ``order`` is the column by which its rows came."""
        with self.lock:
            if name in self.tables:
                raise AlreadyExists(f"table {name} exists")
            schema = TableSchema([Column.of(f) for f in df.schema.fields])
            self.tables[name] = Table(schema, df.withColumn(SEQ, F.col(order).cast("bigint")) if order else df)

    def drop(self, name: str) -> None:
        with self.lock:
            self._table(name)
            del self.tables[name]

    def names(self) -> list[str]:
        return sorted(self.tables)

    def truncate(self, name: str) -> None:
        with self.lock:
            table = self._table(name)
            self._put(table, table.df.limit(0))

    def _empty(self, schema: TableSchema) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*schema.struct().fields, T.StructField(SEQ, T.LongType())]))

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise NotFound(f"no table {name}")
        return self.tables[name]

    def _put(self, table: Table, df: DataFrame) -> None:
        table.changes += 1
        if table.changes % CUT_EVERY == 0 and self.spark.sparkContext.getCheckpointDir():
            df = df.checkpoint()
        table.df = df

    def table(self, name: str) -> DataFrame:
        table = self._table(name)
        return table.df.select(*[f"`{c}`" for c in visible(table.df)])

    # reading

    def select(self, name: str, columns=None, where=None) -> DataFrame:
        df = self._table(name).df
        P.check_columns(where, visible(df))
        for c in columns or ():
            if c not in visible(df):
                raise InvalidArgument(f"unknown column {c}")
        if where is not None:
            df = df.where(P.to_filter(where, df.schema))
        return df.select(*[f"`{c}`" for c in columns or visible(df)])

    # changes

    def insert(self, name: str, rows, columns=()) -> int:
        """Rows as sequences; all are added or none."""
        with self.lock:
            table = self._table(name)
            names = list(columns) or table.schema.names
            for c in names:
                if c not in table.schema.names:
                    raise InvalidArgument(f"unknown column {c}")
            if any(len(r) != len(names) for r in rows):
                raise InvalidArgument("a row has too few or too many values")
            for r in rows:
                for c, v in zip(names, r):
                    want, got = table.schema.get(c).kind, kind_of_value(v)
                    if got not in (want, "null") and not (want == "float" and got == "int"):
                        raise InvalidArgument(f"{c} is {want}, not {got}")
            full = [tuple(float(v) if v is not None and c.kind == "float" else v for c in table.schema.columns for v in [dict(zip(names, r)).get(c.name)]) for r in rows]
            return self.append(name, self.spark.createDataFrame(full, table.schema.struct()))

    def append(self, name: str, new: DataFrame) -> int:
        """The rows of a DataFrame, in the order of its partitions."""
        with self.lock:
            table = self._table(name)
            check_types(table.schema, table.schema.names, new.schema)
            new = new.select(*[F.col(f"`{c.name}`").cast(f.dataType) for c, f in zip(table.schema.columns, table.schema.struct().fields)])
            check_rows(new, table.schema)
            if SEQ in table.df.columns:
                base = table.df.agg(F.coalesce(F.max(SEQ), F.lit(-1)).alias("m")).first().m + 1
                new = new.withColumn(SEQ, F.monotonically_increasing_id() + base)
            after = table.df.unionByName(new)
            check_unique(after, table.schema)
            count = new.count()
            self._put(table, after)
            return count

    def update(self, name: str, sets: dict, where=None) -> int:
        """``sets``: column to a constant, or to a Column expression."""
        with self.lock:
            df = self._table(name).df
            P.check_columns(where, visible(df))
            for c, v in sets.items():
                _, kind = compiler.scope_of(df)(c)
                got = kind if isinstance(v, type(F.lit(0))) else kind_of_value(v)
                if got not in (kind, "null") and not (kind == "float" and got == "int"):
                    raise InvalidArgument(f"{c} is {kind}, not {got}")
            hit = F.lit(True) if where is None else P.to_column(where, df.schema)
            return self._change(name, {c: (v if isinstance(v, type(F.lit(0))) else F.lit(v)).cast(df.schema[c].dataType) for c, v in sets.items()}, hit)

    def _change(self, name: str, made: dict, hit) -> int:
        table = self._table(name)
        after = table.df.withColumns({c: F.when(hit, v).otherwise(F.col(f"`{c}`")) for c, v in made.items()})
        # one pass counts the rows and computes every new value, so that an error in one shows now
        seen = table.df.where(hit).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*made.values()))).first()
        check_rows(after, table.schema)
        check_unique(after, table.schema)
        self._put(table, after)
        return seen.n

    def update_status(self, name: str, sets: dict, where=None) -> tuple[str, str]:
        """The update as (code, message), ("OK", "") if all went well; nothing is raised."""
        try:
            self.update(name, sets, where)
        except EngineError as e:
            return e.code, str(e)
        return "OK", ""

    def update_with(self, name: str, change, where=None) -> int:
        """``change`` takes and returns a pandas frame of matching rows, batch by batch."""
        with self.lock:
            table = self._table(name)
            df = table.df
            hit = F.lit(True) if where is None else P.to_filter(where, df.schema)
            rest = F.lit(False) if where is None else P.to_filter(where, df.schema, False)

            def run(frames):
                for frame in frames:
                    yield change(frame)

            new = df.where(hit).mapInPandas(run, df.schema)
            after = df.where(rest).unionByName(new)
            check_rows(after, table.schema)
            check_unique(after, table.schema)
            count = df.where(hit).count()
            self._put(table, after)
            return count

    def delete(self, name: str, where=None) -> int:
        with self.lock:
            table = self._table(name)
            P.check_columns(where, visible(table.df))
            if where is None:
                return self._remove(table, F.lit(True), F.lit(False))
            return self._remove(table, *(P.to_filter(where, table.df.schema, holds) for holds in (True, False)))

    def _remove(self, table: Table, hit, rest) -> int:
        count = table.df.where(hit).count()
        self._put(table, table.df.where(rest))
        return count

    # SQL

    def sql(self, text: str) -> DataFrame:
        """The result of a SELECT, or (affected, what) of a change."""
        statement = parse(text)
        df = self._table(statement.table).df
        if isinstance(statement, ast.Select):
            return compiler.select(statement, df)
        with self.lock:
            if isinstance(statement, ast.Insert):
                rows = [[self._constant(e) for e in r] for r in statement.rows]
                return self._affected(self.insert(statement.table, rows, statement.columns), "inserted")
            hit = F.lit(True) if statement.where is None else F.coalesce(compiler.condition(statement.where, df), F.lit(False))
            if isinstance(statement, ast.Update):
                return self._affected(self._change(statement.table, compiler.assignments(statement.sets, df), hit), "updated")
            rest = F.lit(False) if statement.where is None else compiler.unmet(statement.where, df)
            return self._affected(self._remove(self._table(statement.table), hit, rest), "deleted")

    @staticmethod
    def _constant(expr):
        expr = signed(expr)
        if not isinstance(expr, ast.Literal):
            raise InvalidArgument("VALUES takes literals")
        return expr.value

    def _affected(self, count: int, what: str) -> DataFrame:
        return self.spark.createDataFrame([(count, what)], "affected long, operation string")


def last_by(df: DataFrame, keys: list[str], seq: str = SEQ) -> DataFrame:
    """The latest row of each key, by one aggregation with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_")).select(*keys, "_.*")
