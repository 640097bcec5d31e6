"""Keys and values by table: (table, id, value), the last put of a key holds.

The small language reads one key and inserts one pair; its SELECT list is not
read, and its result is always (id, value).
"""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, NotFound, ParseError
from tessella.operators.relational import last_by
from tessella.plans.compiler import SEQ
from tessella.sources.scratch import stored

SCHEMA = f"table string, id string, value string, {SEQ} long"
#: Puts after which the lineage is cut.
CUT_EVERY = 20
VALUE = r"""(?:'((?:\\.|[^'\\])*)'|"((?:\\.|[^"\\])*)"|([A-Za-z_]\w*|\d+))"""
SELECT = re.compile(rf"\s*SELECT\s+(?:\*|[\w\s,]+?)\s+FROM\s+(\w+)\s+WHERE\s+(\w+)\s*(=|!=|<>|<=|>=|<|>)\s*{VALUE}\s*;?\s*$", re.I)
INSERT = re.compile(r"\s*INSERT\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*VALUES\s*\((.*?)\)\s*(?:,.*)?;?\s*$", re.I | re.S)


def get(pairs: DataFrame, table: str, key: str) -> DataFrame:
    """(id, value) of one key of the latest pairs; no rows if it is missing."""
    return last_by(pairs.where((F.col("table") == table) & (F.col("id") == key)), ["table", "id"]).select("id", "value")


def latest(pairs: DataFrame) -> DataFrame:
    return last_by(pairs, ["table", "id"]).where("value is not null").select("table", "id", "value")


def _plain(found) -> str:
    """Escapes are not decoded: a backslash only keeps its character."""
    return next(x for x in found if x is not None)


class KeyValues:
    """Puts and deletes are appended as rows; a delete is a null value."""

    def __init__(self, spark: SparkSession, pairs: DataFrame | None = None):
        self.spark, self.lock, self.puts = spark, threading.RLock(), 0
        self.pairs = pairs if pairs is not None else spark.createDataFrame([], SCHEMA)

    def _add(self, table, key, value):
        with self.lock:
            self.pairs = self.pairs.unionByName(self.spark.createDataFrame([(table, key, value, self._next())], SCHEMA))
            self.puts += 1
            if self.puts % CUT_EVERY == 0:
                self.pairs = stored(self.pairs)

    def load(self, new: DataFrame) -> None:
        """Further puts (table, id, value, __seq), later than all before."""
        with self.lock:
            self.pairs = self.pairs.unionByName(new.withColumn(SEQ, F.col(SEQ) + F.lit(self._next())))

    def _next(self) -> int:
        return self.pairs.agg(F.coalesce(F.max(SEQ), F.lit(-1)).alias("m")).first().m + 1

    def put(self, table: str, key: str, value: str) -> None:
        self._add(table, key, value)

    def delete(self, table: str, key: str) -> None:
        self._add(table, key, None)

    def get(self, table: str, key: str) -> str:
        got = get(self.pairs, table, key).head(1)
        if not got or got[0].value is None:
            raise NotFound(f"no key {key}")
        return got[0].value

    def scan(self) -> DataFrame:
        return latest(self.pairs)

    def execute(self, text: str) -> DataFrame:
        if found := SELECT.match(text):
            table, column, op, *value = found.groups()
            if column.lower() not in ("id", "key") or op != "=":
                raise InvalidArgument("a point query compares id or key by =")
            return get(self.pairs, table, _plain(value)).where("value is not null")
        if found := INSERT.match(text):
            table, names, values = found.groups()
            names = [n.strip().lower() for n in names.split(",")]
            got = [next((x for x in v if x), "") for v in re.findall(VALUE, values)]
            pair = dict(zip(names, got))
            key, value = pair.get("id", pair.get("key")), pair.get("value", pair.get("data"))
            if len(names) != len(got) or key is None or value is None:
                raise InvalidArgument("INSERT needs id or key, and value or data")
            self.put(table, key, value)
            return self.spark.createDataFrame([(1,)], "affected long")
        raise ParseError("expected a point SELECT or an INSERT")
