"""One object for all surfaces: tables, documents, series, graphs, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella import __version__
from tessella.operators.document import Documents
from tessella.operators.graph import Graphs
from tessella.operators.kv import KeyValues
from tessella.operators.relational import Relational
from tessella.operators.timeseries import TimeSeries
from tessella.plans import graph_language
from tessella.errors import InvalidArgument

PERMISSIONS = ("read", "write", "admin")


class Session:
    """``permission``: read allows queries, write also changes, admin also catalogs."""

    version = __version__

    def __init__(self, spark: SparkSession, permission: str = "admin"):
        if permission not in PERMISSIONS:
            raise InvalidArgument(f"no permission {permission}")
        self.spark, self.permission = spark, permission
        self.tables, self.documents, self.series = Relational(spark), Documents(spark), TimeSeries(spark)
        self.graphs, self.pairs = Graphs(spark), KeyValues(spark)

    def sql(self, text: str) -> DataFrame:
        if self.permission == "read" and not text.lstrip().upper().startswith("SELECT"):
            raise InvalidArgument("this session may only read")
        return self.tables.sql(text)

    def graph(self, text: str) -> DataFrame:
        return graph_language.execute(self.graphs, text)

    def kv(self, text: str) -> DataFrame:
        if self.permission == "read" and not text.lstrip().upper().startswith("SELECT"):
            raise InvalidArgument("this session may only read")
        return self.pairs.execute(text)
