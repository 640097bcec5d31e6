"""Stored intermediate tables that survive lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import FailedPrecondition


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read back: its
    lineage ends there.  Where that is unset on a single machine (master
    ``local``), a folder beside the warehouse takes its place."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise FailedPrecondition("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> tuple[DataFrame, int]:
    """``df`` with a column ``name`` that counts the rows from ``start`` in the
    order of the columns in ``order``, without gaps, and the number of rows.

    The rows are range-sorted and stored with each one's place in its range;
    the sizes of the ranges (as many as shuffle partitions) say where each begins.
    """
    at, place = F.monotonically_increasing_id(), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, rows = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(start + rows)
        rows += sizes.get(p, 0)
    base = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), part.cast("int")) if starts else F.lit(start).cast("long")
    return placed.withColumn(name, place + base).drop("__at"), rows
