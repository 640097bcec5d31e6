"""Document collections: (key, doc) with a VARIANT per document, so that a field
may hold values of different kinds; later puts of a key replace earlier ones.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound
from tessella.functions.scalar import OPS, RANK, SPARK_TYPE, kind_of_value, literal, numeric
from tessella.operators import predicate as P
from tessella.operators.relational import last_by
from tessella.operators.validate import document_error
from tessella.plans.compiler import SEQ
from tessella.schema import DocumentSchema
from tessella.sources.scratch import stored


#: Puts after which a collection's lineage is cut.
CUT_EVERY = 20


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def once(value: SparkColumn, body) -> SparkColumn:
    """``body`` of a value that is computed once a row, however often it is used.
    Catalyst puts the text of a column into each place that names it, so that a
    document would be parsed anew at each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _held(doc: SparkColumn, name: str) -> SparkColumn:
    return F.variant_get(doc, _path(name), "variant")


def _kind(value: SparkColumn) -> SparkColumn:
    def named(shape):
        kind = F.when(shape == "STRING", "string").when(shape == "BIGINT", "int").when(shape == "BOOLEAN", "bool")
        return kind.when((shape == "DOUBLE") | (shape == "FLOAT") | shape.startswith("DECIMAL"), "float")

    return once(F.schema_of_variant(value), named)


def kind_column(doc: SparkColumn, name: str) -> SparkColumn:
    """The kind of a field as a string; NULL where it is missing or null."""
    return _kind(_held(doc, name))


def field(doc: SparkColumn, name: str, kind: str) -> SparkColumn:
    return F.try_variant_get(doc, _path(name), SPARK_TYPE[kind])


def compare(doc: SparkColumn, p: P.Cmp) -> SparkColumn:
    """A field against a value: by value in one kind or between numbers, by kind otherwise."""
    if p.value is None:
        return F.lit(False)
    want = kind_of_value(p.value)

    def of_kind(value, got):
        held = lambda kind: F.try_variant_get(value, "$", SPARK_TYPE[kind])
        if numeric(want):
            same = OPS[p.op](held("float"), literal(float(p.value)))
            if want == "int":
                same = F.when(got == "int", OPS[p.op](held("int"), literal(p.value))).otherwise(same)
            out = F.when(got.isin("int", "float"), same)
        else:
            out = F.when(got == want, OPS[p.op](held(want), literal(p.value)))
        for kind, rank in RANK.items():
            out = out.when(got == kind, F.lit(bool(OPS[p.op](rank, RANK[want]))))
        return out

    return once(_held(doc, p.column), lambda value: once(_kind(value), lambda got: of_kind(value, got)))


def matching(docs: DataFrame, where, doc_col: str = "doc") -> DataFrame:
    return docs if where is None else docs.where(P.compile_with(where, lambda p: compare(F.col(doc_col), p)))


def project(doc: SparkColumn, fields) -> SparkColumn:
    """The document with those of ``fields`` that it has."""
    whole = F.from_json(F.to_json(doc), "map<string,variant>")
    return F.to_variant_object(F.map_filter(whole, lambda k, _: k.isin(*fields)))


class Documents:
    def __init__(self, spark: SparkSession):
        self.spark, self.collections, self.lock, self.puts = spark, {}, threading.RLock(), 0

    def create(self, name: str, schema: DocumentSchema | None = None) -> None:
        with self.lock:
            if name in self.collections:
                raise AlreadyExists(f"collection {name} exists")
            self.collections[name] = (schema, self.spark.createDataFrame([], f"key string, json string, {SEQ} long").select("key", F.parse_json("json").alias("doc"), SEQ))

    def register(self, name: str, docs: DataFrame, schema: DocumentSchema | None = None) -> None:
        """A DataFrame (key, doc variant), in one row per key."""
        with self.lock:
            if name in self.collections:
                raise AlreadyExists(f"collection {name} exists")
            self.collections[name] = (schema, docs.select("key", "doc", F.lit(-1).cast("long").alias(SEQ)))

    def drop(self, name: str) -> None:
        with self.lock:
            self._get(name)
            del self.collections[name]

    def names(self) -> list[str]:
        return sorted(self.collections)

    def _get(self, name):
        if name not in self.collections:
            raise NotFound(f"no collection {name}")
        return self.collections[name]

    def put(self, name: str, key: str, document: dict) -> None:
        with self.lock:
            if name not in self.collections:
                self.create(name)
            schema, docs = self._get(name)
            if schema is not None:
                if error := document_error(document, schema.fields):
                    raise InvalidArgument(error)
                for c in schema.fields.values():
                    value = document.get(c.name)
                    if c.unique and value is not None and matching(docs, P.Cmp(c.name, "=", value)).where(F.col("key") != key).head(1):
                        raise FailedPrecondition(f"{c.name} is not unique")
            known = {k: v for k, v in document.items() if kind_of_value(v)}
            self.puts += 1
            if self.puts % CUT_EVERY == 0:
                docs = stored(docs.select("key", F.to_json("doc").alias("json"), SEQ)).select("key", F.parse_json("json").alias("doc"), SEQ)
            seq = docs.agg(F.coalesce(F.max(SEQ), F.lit(-1)).alias("m")).first().m + 1
            new = self.spark.createDataFrame([(key, json.dumps(known), seq)], f"key string, json string, {SEQ} long")
            self.collections[name] = (schema, docs.where(F.col("key") != key).unionByName(new.select("key", F.parse_json("json").alias("doc"), SEQ)))

    def get(self, name: str, key: str) -> dict:
        got = self._get(name)[1].where(F.col("key") == key).select(F.to_json("doc").alias("j")).head(1)
        if not got:
            raise NotFound(f"no document {key}")
        return json.loads(got[0].j)

    def erase(self, name: str, key: str) -> None:
        with self.lock:
            self.get(name, key)
            schema, docs = self._get(name)
            self.collections[name] = (schema, docs.where(F.col("key") != key))

    def count(self, name: str) -> int:
        return self._get(name)[1].count()

    def query(self, name: str, fields=None, where=None) -> DataFrame:
        """(key, doc): matching documents, with the named fields only."""
        schema, docs = self._get(name)
        if schema is not None:
            P.check_columns(where, schema.fields)
            for f in fields or ():
                if f not in schema.fields:
                    raise InvalidArgument(f"unknown field {f}")
        docs = matching(docs, where)
        return docs.select("key", (project(F.col("doc"), fields) if fields else F.col("doc")).alias("doc"))


def document_errors(docs: DataFrame, schema: DocumentSchema, doc_col: str = "doc") -> DataFrame:
    """``docs`` with a column ``error``: the first broken rule of each document, or NULL; further fields are allowed."""

    def error(c, value, kind):
        tests = []
        if not c.nullable:
            tests.append((kind.isNull(), f"{c.name} is missing"))
        fits = kind.isin("int", "float") if c.kind == "float" else kind == c.kind
        tests += [(kind.isNotNull() & ~fits & (kind == k), f"{c.name} is {c.kind}, not {k}") for k in ("int", "float", "string", "bool") if k != c.kind]
        if c.kind == "string":
            text = F.try_variant_get(value, "$", "string")
            broken = (F.octet_length(text) < (c.min_length or 0)) | (F.octet_length(text) > (c.max_length if c.max_length is not None else (1 << 31) - 1))
            tests.append((broken | ~text.isin(*c.one_of) if c.one_of else broken, f"{c.name} breaks its constraints"))
        if c.kind in ("int", "float") and (c.min_value is not None or c.max_value is not None):
            number = F.try_variant_get(value, "$", "double")
            low, high = (float(x) if x is not None else y for x, y in ((c.min_value, -float("inf")), (c.max_value, float("inf"))))
            tests.append(((number < low) | (number > high), f"{c.name} is out of range"))
        return F.coalesce(*[F.when(t, F.lit(m)) for t, m in tests], F.lit(None).cast("string"))

    def first_error(c):
        return once(_held(F.col(doc_col), c.name), lambda value: once(_kind(value), lambda kind: error(c, value, kind)))

    return docs.withColumn("error", F.coalesce(*map(first_error, schema.fields.values()), F.lit(None).cast("string")))


def check_unique(docs: DataFrame, schema: DocumentSchema, ignore_nulls: bool = True) -> None:
    """Fails if two documents share a value of a unique field."""
    for c in schema.fields.values():
        if c.unique and duplicates(docs, c.name, c.kind, ignore_nulls).head(1):
            raise FailedPrecondition(f"{c.name} is not unique")


def upserted(puts: DataFrame) -> DataFrame:
    """(key, doc, __seq) puts reduced to the last one of each key."""
    return last_by(puts.select("key", F.to_json("doc").alias("j"), SEQ), ["key"]).select("key", F.parse_json("j").alias("doc"))


def duplicates(docs: DataFrame, name: str, kind: str, ignore_nulls: bool = True) -> DataFrame:
    """(value, count) of a field's values that more than one document has, by text form."""
    from tessella.operators.validate import duplicates as of_column

    return of_column(docs.select(field(F.col("doc"), name, kind).alias("f")), "f", ignore_nulls)
