"""Time series: ranges, anchored buckets, partitions and retention.

Times are compared in whole seconds, truncated toward zero.
"""

from __future__ import annotations

import math
import threading
from datetime import datetime, timezone

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound
from tessella.functions.scalar import kind_of_type
from tessella.operators import predicate as P
from tessella.operators.validate import check_rows, check_types
from tessella.plans.compiler import SEQ
from tessella.schema import SeriesSchema
from tessella.sources.scratch import numbered

#: Units a second, or seconds a unit.
PARTS = {"ns": 1_000_000_000, "us": 1_000_000, "ms": 1000, "s": 1}
SPANS = {"m": 60, "h": 3600, "d": 86_400}
PARTITION = {"hourly": 3600, "daily": 86_400}
#: The column of a stored series' partition buckets.
BUCKET = "__bucket"
AGGREGATES = ("avg", "min", "max", "sum", "count")


def seconds(column: SparkColumn, granularity: str) -> SparkColumn:
    if granularity in SPANS:
        return column * F.lit(SPANS[granularity]).cast("bigint")
    parts = F.lit(PARTS[granularity]).cast("bigint")
    return column if granularity == "s" else ((column - column % parts) / parts).cast("bigint")


def whole_seconds(value: int, granularity: str) -> int:
    if granularity in SPANS:
        return value * SPANS[granularity]
    return int(value / PARTS[granularity]) if abs(value) < 1 << 50 else (abs(value) // PARTS[granularity]) * (1 if value >= 0 else -1)


def width_seconds(width: int, granularity: str) -> int:
    """A bucket's width; below a second it is one second."""
    if width <= 0:
        raise InvalidArgument("a bucket needs a positive width")
    return max(1, whole_seconds(width, granularity))


def partition_bucket(tsec: SparkColumn, partition: str = "hourly") -> SparkColumn:
    size = F.lit(PARTITION[partition]).cast("bigint")
    return tsec - F.pmod(tsec, size)


def raw_bounds(low: int, high: int, granularity: str) -> tuple[int, int]:
    """The first and last raw time whose seconds, truncated toward zero, lie in [low, high)."""
    if granularity in SPANS:
        n = SPANS[granularity]
        return -(-low // n), (high - 1) // n
    n, last = PARTS[granularity], high - 1
    return low * n if low > 0 else (low - 1) * n + 1, (last + 1) * n - 1 if last >= 0 else last * n


def time_range(df: DataFrame, ts: str, start: int, end: int, granularity: str = "s", where=None, partition_col: str | None = None, partition: str = "hourly", instant: str | None = None) -> DataFrame:
    """Rows with start <= seconds < end that match.

    The bounds are put to the raw column, so that a scan can take them; a
    partition column, if given, prunes files, and so does ``instant``, a
    timestamp column of which ``ts`` holds the seconds.
    """
    if end < start:
        raise InvalidArgument("the end lies before the start")
    low, high = whole_seconds(start, granularity), whole_seconds(end, granularity)
    if partition_col:
        size = PARTITION[partition]
        df = df.where(F.col(partition_col).between(low // size * size, high // size * size))
    if instant and granularity == "s":
        kind = df.schema[instant].dataType.simpleString()
        moment = lambda s: F.lit(str(datetime.fromtimestamp(max(-62_135_596_800, min(253_402_300_799, s)), timezone.utc).replace(tzinfo=None))).cast(kind)
        df = df.where((F.col(instant) >= moment(low - 1)) & (F.col(instant) < moment(high + 1)))
    first, last = raw_bounds(low, high, granularity)
    edge = lambda n: F.lit(max(-(1 << 63), min((1 << 63) - 1, n))).cast("bigint")
    df = df.where((F.col(ts) >= edge(first)) & (F.col(ts) <= edge(last)))
    return df if where is None else df.where(P.to_filter(where, df.schema))


def aggregate(df: DataFrame, ts: str, value: str, what: str, start: int, end: int, width: int, granularity: str = "s", where=None, **pruning) -> DataFrame:
    """(bucket_start, value): buckets anchored at ``start``, in seconds.

    AVG divides by all rows of a bucket, NULLs too; MIN and MAX without a
    finite value are 0; so is the SUM of NULLs.
    """
    if what not in AGGREGATES:
        raise InvalidArgument(f"no aggregate {what}")
    size, low = width_seconds(width, granularity), whole_seconds(start, granularity)
    df = time_range(df, ts, start, end, granularity, where, **pruning)
    tsec = seconds(F.col(ts), granularity)
    n = F.lit(size).cast("bigint")
    bucket = (tsec - F.pmod(tsec - F.lit(low).cast("bigint"), n)).cast("bigint")
    number = F.col(value).cast("double") if kind_of_type(df.schema[value].dataType) in ("int", "float", "bool") else F.lit(None).cast("double")
    total, rows = F.coalesce(F.sum(number), F.lit(0.0)), F.count(F.lit(1))
    low_high = lambda f: F.coalesce(f(F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)), F.lit(0.0))
    out = {"count": rows, "sum": total, "avg": total / rows, "min": low_high(F.min), "max": low_high(F.max)}[what]
    return df.groupBy(bucket.alias("bucket_start")).agg(out.alias("value")).orderBy("bucket_start")


def retain_ttl(df: DataFrame, tsec: SparkColumn, seq: str, ttl: int, spans: int | None = None) -> DataFrame:
    """What is left after rows arrived in the order of ``seq`` and each dropped
    those older than itself by more than ``ttl``: a row stays if no row from it
    on is newer by more.

    The running maximum is distributed: spans of ``seq`` of about the root of
    the row count (or ``spans``) are summed up first, then each runs on its own,
    from the last row backwards, as Spark sums anew for each row a frame that
    only loses rows.
    """
    low, high, count = df.agg(F.min(seq), F.max(seq), F.count(F.lit(1))).first()
    if low is None:
        return df
    step = max(1, -(-(high - low + 1) // (spans or math.isqrt(count) + 1)))
    rows = df.withColumn("_t", tsec).withColumn("_span", F.expr(f"cast((`{seq}` - {low}) div {step} as bigint)"))
    tops = rows.groupBy("_span").agg(F.max("_t").alias("_top"))
    tops = tops.select("_span", F.max("_top").over(Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    own = Window.partitionBy("_span").orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(tops, "_span").withColumn("_newest", F.greatest(F.max("_t").over(own), "_later"))
    return rows.where(F.col("_t") >= F.col("_newest") - ttl).select(*df.columns)


def retain_max_rows(df: DataFrame, tsec: SparkColumn, seq: str, max_rows: int, partition: str = "hourly", drop_oldest: bool = True) -> DataFrame:
    """The newest ``max_rows`` by partition bucket, then by arrival.

    Bucket counts (few rows) say how many rows each bucket keeps; only in the
    one that is cut are rows ranked.
    """
    if max_rows <= 0 or not drop_oldest:
        return df
    rows = df.withColumn("_b", partition_bucket(tsec, partition))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < max_rows)
    rows = rows.join(counts, "_b")
    whole = rows.where(F.col("_newer") + F.col("_n") <= max_rows)
    cut = rows.where(F.col("_newer") + F.col("_n") > max_rows)
    room = counts.where(F.col("_newer") + F.col("_n") > max_rows).select((F.lit(max_rows) - F.col("_newer")).alias("room")).head(1)
    cut = cut.orderBy(F.desc(seq)).limit(int(room[0].room)) if room else cut.limit(0)
    return whole.unionByName(cut).select(*df.columns)


def replay(rows, ttl: int, max_rows: int, partition: str = "hourly", drop_oldest: bool = True):
    """Both rules, row by row: (seq, tsec) in arrival order to the kept seqs.

    Which rows one rule drops depends on what the other has dropped before, so
    this is a fold; it needs the rows of one series in one place.
    """
    size, buckets, count = PARTITION[partition], {}, 0
    for seq, t in rows:
        buckets.setdefault(t // size * size, []).append((seq, t))
        count += 1
        if ttl > 0:
            edge = t - ttl
            for b in [b for b in buckets if b <= edge]:
                kept = [r for r in buckets[b] if r[1] >= edge]
                count -= len(buckets[b]) - len(kept)
                buckets[b] = kept
                if not kept:
                    del buckets[b]
        while max_rows > 0 and drop_oldest and count > max_rows:
            b = min(buckets)
            buckets[b].pop(0)
            count -= 1
            if not buckets[b]:
                del buckets[b]
    return sorted(seq for held in buckets.values() for seq, _ in held)


def retain_both(df: DataFrame, tsec: SparkColumn, seq: str, ttl: int, max_rows: int, series: list[str], partition: str = "hourly", drop_oldest: bool = True) -> DataFrame:
    """Both rules replayed for each series (the columns in ``series``)."""
    import pandas as pd

    slim = df.select(*series, F.col(seq).alias("_seq"), tsec.alias("_t"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series)

    def run(frame):
        frame = frame.sort_values("_seq")
        kept = replay(zip(frame["_seq"].tolist(), frame["_t"].tolist()), ttl, max_rows, partition, drop_oldest)
        return pd.DataFrame({c: [frame[c].iloc[0]] * len(kept) for c in series} | {"_kept": kept})

    kept = slim.groupBy(*series).applyInPandas(run, f"{kinds}, _kept bigint")
    return df.join(kept, [*[df[c].eqNullSafe(kept[c]) for c in series], df[seq] == kept["_kept"]], "left_semi")


class TimeSeries:
    """Series by name over a partitioned, immutable DataFrame each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.series, self.lock = spark, {}, threading.RLock()

    def create(self, name: str, schema: SeriesSchema, partition: str = "hourly") -> None:
        with self.lock:
            if name in self.series:
                raise AlreadyExists(f"series {name} exists")
            df = self.spark.createDataFrame([], schema.table().struct()).withColumn(SEQ, F.lit(0).cast("long"))
            self.series[name] = (schema, partition, df)

    def drop(self, name: str) -> None:
        with self.lock:
            self._get(name)
            del self.series[name]

    def names(self) -> list[str]:
        return sorted(self.series)

    def register(self, name: str, schema: SeriesSchema, df: DataFrame, partition: str = "hourly", order: str | None = None) -> None:
        """An existing DataFrame as a series; ``order`` is the column by which its
        rows came (else the time).  If it has the column ``BUCKET``, as files
        written by ``save`` have, range queries prune by it."""
        with self.lock:
            if name in self.series:
                raise AlreadyExists(f"series {name} exists")
            if SEQ not in df.columns:
                df = df.withColumn(SEQ, F.col(order or schema.timestamp).cast("bigint"))
            self.series[name] = (schema, partition, df)

    def save(self, name: str, path: str) -> None:
        """The series as Parquet, in folders by partition bucket."""
        schema, partition, df = self._get(name)
        bucket = partition_bucket(seconds(F.col(schema.timestamp), schema.granularity), partition)
        df.drop(BUCKET).withColumn(BUCKET, bucket).repartition(F.col(BUCKET), F.col(SEQ) % 16).sortWithinPartitions(BUCKET, schema.timestamp).write.partitionBy(BUCKET).parquet(path)

    def load(self, name: str, schema: SeriesSchema, path: str, partition: str = "hourly") -> None:
        """A series that ``save`` has written."""
        struct = schema.table().struct().add(SEQ, "long").add(BUCKET, "long")
        self.register(name, schema, self.spark.read.schema(struct).parquet(path), partition)

    def _pruning(self, name: str) -> dict:
        _, partition, df = self._get(name)
        return {"partition_col": BUCKET, "partition": partition} if BUCKET in df.columns else {}

    def _get(self, name):
        if name not in self.series:
            raise NotFound(f"no series {name}")
        return self.series[name]

    def append_frame(self, name: str, new: DataFrame, order: str | None = None) -> None:
        """The rows of a DataFrame, in the order of column ``order`` (else of its partitions), then retention.

        What both rules together keep is bounded by ``max_rows``; the fold over
        it and the new rows is sequential.  One rule alone is distributed.
        """
        with self.lock:
            schema, partition, df = self._get(name)
            table = schema.table()
            missing = [c for c in table.names if c not in new.columns]
            if missing:
                raise FailedPrecondition(f"no column {missing[0]}")
            if kind_of_type(new.schema[schema.timestamp].dataType) != "int":
                raise InvalidArgument("the timestamp is no whole number")
            check_types(table, table.names, new.schema)
            if order:
                new = numbered(new, [order], "__place")[0].withColumn(SEQ, F.col("__place"))
            else:
                new = new.withColumn(SEQ, F.monotonically_increasing_id())
            new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in table.struct().fields], SEQ)
            check_rows(new, table)
            base = df.agg(F.coalesce(F.max(SEQ), F.lit(-1)).alias("m")).first().m + 1
            self._retained(name, df.drop(BUCKET).unionByName(new.withColumn(SEQ, F.col(SEQ) + base)))

    def append(self, name: str, rows) -> None:
        """Rows in arrival order, then retention."""
        with self.lock:
            schema, _, df = self._get(name)
            table = schema.table()
            if any(len(r) != len(table.names) for r in rows):
                raise FailedPrecondition("a row has too few or too many values")
            for r in rows:
                if not isinstance(r[0], int) or isinstance(r[0], bool):
                    raise InvalidArgument("the timestamp is no whole number")
            base = df.agg(F.coalesce(F.max(SEQ), F.lit(-1)).alias("m")).first().m + 1
            struct = table.struct()
            full = [tuple(float(v) if v is not None and c.kind == "float" else v for c, v in zip(table.columns, r)) for r in rows]
            new = self.spark.createDataFrame([(*r, base + i) for i, r in enumerate(full)], struct.add(SEQ, "long"))
            check_types(table, table.names, new.schema)
            check_rows(new, table)
            self._retained(name, df.drop(BUCKET).unionByName(new))

    def _retained(self, name: str, df: DataFrame) -> None:
        schema, partition, _ = self._get(name)
        tsec = seconds(F.col(schema.timestamp), schema.granularity)
        if schema.ttl_seconds > 0 and schema.max_rows > 0 and schema.drop_oldest:
            whole = df.withColumn("_all", F.lit(1))
            df = retain_both(whole, tsec, SEQ, schema.ttl_seconds, schema.max_rows, ["_all"], partition).drop("_all")
        elif schema.ttl_seconds > 0:
            df = retain_ttl(df, tsec, SEQ, schema.ttl_seconds)
        else:
            df = retain_max_rows(df, tsec, SEQ, schema.max_rows, partition, schema.drop_oldest)
        self.series[name] = (schema, partition, df)

    def range_query(self, name: str, columns, start: int, end: int, where=None) -> DataFrame:
        schema, partition, df = self._get(name)
        for c in columns or ():
            if c not in schema.table().names:
                raise InvalidArgument(f"unknown column {c}")
        bucket = partition_bucket(seconds(F.col(schema.timestamp), schema.granularity), partition)
        out = time_range(df, schema.timestamp, start, end, schema.granularity, where, **self._pruning(name)).orderBy(bucket, SEQ)
        return out.select(*[f"`{c}`" for c in columns or schema.table().names])

    def aggregate(self, name: str, value: str, what: str, start: int, end: int, width: int, where=None) -> DataFrame:
        schema, _, df = self._get(name)
        if value not in schema.table().names:
            raise InvalidArgument(f"unknown column {value}")
        return aggregate(df, schema.timestamp, value, what, start, end, width, schema.granularity, where, **self._pruning(name))
