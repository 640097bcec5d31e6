"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows of a source are shuffled by a seeded key and ranked; a row's fractional
rank (rank - 1/2) / rows of the source spreads each source evenly over [0, 1).
In the order of fractional ranks every run of rows has the mixture of the
whole, so that equal cuts make shards alike, with row counts at most one apart.

Both ranks are distributed: key ranges, then ranges of the fractional rank,
each of about the root of the row count, are counted, and a window runs inside
a range only.

Cases: an empty table gives an empty result; a null source is a source of its
own; a null text counts as no bytes; repeated rows and repeated ids each get a
slot of their own; with fewer rows than shards some shards are empty; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import buckets_for, key_range, shuffle_key, stored

SHARDS = 40
SEED = 31337


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each input row."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
            (F.octet_length(raw) + 16).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            shuffle_key(seed, id_col).alias("_key"),
        ),
        "shard",
    )
    total = rows.count()
    n = buckets_for(total)
    rows = rows.withColumn("_at", key_range(F.col("_key"), n))
    by_source = Window.partitionBy("_null", "_source")
    groups = rows.groupBy("_null", "_source", "_at").agg(F.count(F.lit(1)).alias("_count"))
    groups = groups.select(
        "_null", "_source", "_at",
        F.coalesce(F.sum("_count").over(by_source.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_count").over(by_source).alias("_rows"),
    )
    own = Window.partitionBy("_null", "_source", "_at").orderBy("_key", "doc_id", "size", "text_crc32")
    ranked = rows.join(groups, ["_null", "_source", "_at"]).withColumn("_rank", F.col("_before") + F.row_number().over(own))
    ranked = ranked.withColumn("_part", (F.col("_rank") - 0.5) / F.col("_rows")).withColumn("_at", F.floor(F.col("_part") * n))
    ranked = stored(ranked.select("doc_id", "size", "text_crc32", "_null", "_source", "_rank", "_part", "_at"), "ranked")
    ranges = ranked.groupBy("_at").agg(F.count(F.lit(1)).alias("_count"))
    ranges = ranges.select("_at", F.coalesce(F.sum("_count").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_at").orderBy("_part", "_null", "_source", "_rank")
    placed = ranked.join(ranges, "_at").withColumn("_place", F.col("_before") + F.row_number().over(inside) - 1)
    which = F.expr(f"_place * {shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", which).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


SHARD_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h,
             md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
c AS (SELECT doc_id, source, size, k, xor(4294967295, list_reduce(list_concat([4294967295],
               list_transform(range(size - 16), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32 FROM r, t),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) AS n, count(*) OVER (PARTITION BY source) AS m, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (n - 0.5::DOUBLE) / m, source IS NULL, source, n) - 1 AS place FROM a)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INT AS shard,
       (place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""
