"""Reading and writing tables, and the text import and export of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.plans.compiler import SEQ


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by=(), compression: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.format(kind).mode(mode)
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


COMPRESSIONS = ("none", "snappy", "gzip", "lz4", "zstd", "brotli", "uncompressed")


def store_options(path: str, create_if_missing: bool = True, compression: str = "snappy", cache_bytes: int = 0, write_buffer_bytes: int = 128 << 20, max_files: int = 0) -> dict:
    """Options of a table's files as those of Spark's writer and reader: a write
    buffer is a row group, a number of files a bound on their rows; caches and
    open files are Spark's own business."""
    if compression not in COMPRESSIONS:
        raise InvalidArgument(f"no compression {compression}")
    if min(cache_bytes, write_buffer_bytes, max_files) < 0:
        raise InvalidArgument("sizes are not negative")
    return {"path": path, "mode": "append" if create_if_missing else "errorifexists", "compression": compression, "parquet.block.size": str(write_buffer_bytes)}


def import_pairs(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(table, id, value, __seq) from lines; the first comma ends the id."""
    lines = spark.read.text(path).where("value like '%,%'")
    parts = F.split("value", ",", 2)
    return lines.select(F.lit(table).alias("table"), F.trim(parts[0]).alias("id"), F.trim(parts[1]).alias("value"), F.monotonically_increasing_id().alias(SEQ))


def export_pairs(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table laid out for joins on ``keys`` without a shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)
