"""Shared tables, hash buckets and prefix sums used by several operators."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The column of a stage's own row key.
ROW = "_row"
#: Bytes of text that a partition, and a group that is held whole, should have.
PARTITION_BYTES, GROUP_BYTES = 256 << 20, 16 << 20
#: Rows of a file of a stored table of ids.
FILE_ROWS = 250_000
#: Rows of a batch that a Python task turns into strings at once.
SLICE_ROWS = 512
#: Paths of the tables stored in this application that nothing has deleted yet.
STORED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; where that is unset on a single machine
    (master ``local``), a folder beside the warehouse takes its place.  On a
    cluster the setting is needed.
    """
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage
    that survives lost executors and computes its input only once.  Where a
    bound on its ``rows`` is known, it has files of about ``FILE_ROWS`` each."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    STORED.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    STORED.discard(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def sweep(spark: SparkSession, keep=frozenset()) -> None:
    """Deletes the stored tables but those in ``keep``: for callers that have
    written their results and read none of the lazy ones any more."""
    for path in [*STORED - set(keep)]:
        delete_path(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def measured(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, bool, int]:
    """(rows, whether the ids are whole numbers, distinct and not null, bytes of text), in one pass."""
    rows, ids, size = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return rows, rows == ids and isinstance(docs.schema[id_col].dataType, IntegralType), size


def partitions_for(spark: SparkSession, size: int) -> int:
    """Shuffle partitions for ``size`` bytes: the session's number, or more where that leaves too much in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def keyed(docs: DataFrame, id_col: str, text_col: str, name: str = ROW) -> DataFrame:
    """``docs`` with a key ``name`` of each row, distinct and in the order of ids
    (nulls last): the id itself where ids are whole numbers, distinct and not null."""
    if measured(docs, id_col, text_col)[1]:
        return docs.withColumn(name, F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(text_col).asc()]
    return stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "rows")


def slices(batches):
    """Record batches of ``SLICE_ROWS`` rows at most, so that a task holds few texts as strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def buckets_for(n: int) -> int:
    """About sqrt(n): as many hash ranges as rows in each, so that neither the
    table of ranges nor a range grows beyond the root of the input."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def shuffle_key(seed: int, *columns) -> F.Column:
    """A reproducible hash-random hex key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))


def key_range(key, n: int) -> F.Column:
    """The index, below ``n``, of the range of equal width that holds a hex key."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(2**32)).cast("long")


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running sums over a global order, distributed.

    ``sums`` maps a new column to the column it adds up.  Rows are range-sorted;
    each range's totals are added up over the ranges (their number is the
    bound), then each range runs on its own.
    """
    ranged = stored(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    offsets = offsets.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.sum(c).over(own)).alias(n) for n, c in sums.items()])
