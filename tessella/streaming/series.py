"""Series as streams: bucket aggregates with watermarks, and retained state by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.timeseries import replay


def bucket_stream(stream: DataFrame, ts: str, value: str, width: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, min and max by tumbling window; rows later than ``late`` are dropped."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    out = out.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.unix_seconds(F.col("window.start")).alias("bucket_start"), *keys, "n", "total", "low", "high")


def session_stream(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.unix_seconds("w.start").alias("first"), F.unix_seconds("w.end").alias("last"), "n")


def append_stream(stream: DataFrame, path: str, checkpoint: str, ts_seconds: str, partition_seconds: int = 3600):
    """Writes a stream as a table partitioned by its time bucket; returns the running query (start, stop and status are its own)."""
    n = F.lit(partition_seconds).cast("bigint")
    rows = stream.withColumn("bucket", F.col(ts_seconds) - F.pmod(F.col(ts_seconds), n))
    return rows.writeStream.format("parquet").partitionBy("bucket").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained_stream(stream: DataFrame, key: str, seq: str, tsec: str, ttl: int, max_rows: int) -> DataFrame:
    """(key, seq, tsec) kept after each batch under both retention rules, one state per key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(who, frames: Iterator, state):
        import pandas as pd

        held = [*zip(*state.get)] if state.exists else []
        for frame in frames:
            held += [*frame.sort_values(seq)[[seq, tsec]].itertuples(index=False, name=None)]
        kept = set(replay(held, ttl, max_rows))
        held = [(s, t) for s, t in held if s in kept]
        state.update(([s for s, _ in held], [t for _, t in held]))
        yield pd.DataFrame({key: [who[0]] * len(held), seq: [s for s, _ in held], tsec: [t for _, t in held]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{seq}` long, `{tsec}` long", "seqs array<long>, times array<long>", "append", GroupStateTimeout.NoTimeout)
