"""Mixing sources to target weights, with DataFrame operations only.

Rows get hash-random keys; key ranges of equal width split every source, a hot
one too, into groups of about the root of the row count.  Sums of the groups
give each group its place in its source (a distributed prefix sum), a window
in the group gives each row its place, and every source is cut at its budget.

Cases: an empty table gives an empty result; a null source is a source of its
own (ordered last); a null text has size 0 and takes nothing; a source of size
0 has target 0; repeated rows and repeated ids each hold a place of their own;
further columns are ignored by ``mix`` and kept by ``materialize``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, buckets_for, key_range, running, shuffle_key, stored, unused

MAX_EPOCHS = 3
SEED = 20240917


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int, weights: dict | None = None) -> DataFrame:
    """(_null, _source, source_size) plus weight and target.

    Without ``weights`` the sources, by code point and null last, weigh 1, 2, 3
    and so on in turn.  A target stops at ``max_epochs`` times the source, and
    the excess goes to the others by weight: with sources in the order of
    size / weight, the level is the largest share of what remains.
    """
    if weights is None:
        sizes = running(sizes.withColumn("_one", F.lit(1)), ["_null", "_source"], {"_rank": "_one"}).drop("_one")
        sizes = sizes.withColumn("weight", ((F.col("_rank") - 1) % 3 + 1).cast("double")).drop("_rank")
    else:
        pairs = [F.when(~F.col("_null") & (F.col("_source") == k), F.lit(float(w))) for k, w in weights.items() if k is not None]
        pairs += [F.when(F.col("_null"), F.lit(float(weights[None])))] if None in weights else []
        sizes = sizes.withColumn("weight", F.coalesce(*pairs, F.lit(0.0)))
    sizes = sizes.withColumn("_cap", F.col("source_size") * max_epochs)
    sizes = sizes.withColumn("_at", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    ordered = running(sizes, ["_at", "_null", "_source"], {"_caps": "_cap", "_weights": "weight"})
    size, weight = sizes.agg(F.sum("source_size"), F.sum("weight")).first()  # one row
    share = (F.lit(size) - F.col("_caps")) / (F.lit(weight) - F.col("_weights"))
    top = ordered.where(F.col("_weights") < F.lit(weight)).agg(F.max(share)).first()[0] if weight else 0.0
    level = max(size / weight, top or 0.0) if weight else 0.0
    return sizes.select("_null", "_source", "weight", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each input row; with its ``row_col``, if given."""
    own_key = [row_col] if row_col else []
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
            word_count(F.col(text_col)).alias("size"),
            shuffle_key(seed, id_col).alias("_key"),
            *own_key,
        ),
        "mix",
    )
    n = buckets_for(rows.count())
    rows = rows.withColumn("_at", key_range(F.col("_key"), n))
    by_source = Window.partitionBy("_null", "_source")
    earlier = by_source.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("_null", "_source", "_at").agg(F.sum("size").alias("_size"))
    groups = groups.select(
        "_null", "_source", "_at",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(by_source).alias("source_size"),
    )
    sizes = rows.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"))
    groups = groups.join(targets(sizes, max_epochs, weights), ["_null", "_source"])
    own = Window.partitionBy("_null", "_source", "_at").orderBy("_key", "doc_id", "size", *own_key).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(groups, ["_null", "_source", "_at"]).withColumn("_before", F.col("_before") + F.sum("size").over(own) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    left = F.greatest(F.lit(0), F.least(F.col("size"), budget % F.col("source_size") - F.col("_before")))
    taken = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")) * F.col("size") + left).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *own_key)


def materialize(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document appears
    once for each time it is taken, the last time cut to the words taken.
    ``id_col`` names distinct keys (a null one is a key too); ``mixed`` has them
    as ``doc_id`` or, if ``mix`` was given them as ``row_col``, under their name."""
    key, size, taken, copy = (unused(docs, c) for c in ("_key", "_size", "_taken", "_copy"))
    plan = mixed.where("taken > 0").select(F.col(id_col if id_col in mixed.columns else "doc_id").alias(key), F.col("size").alias(size), F.col("taken").alias(taken))
    copies = F.ceil(F.col(taken) / F.col(size)).cast("int")
    out = docs.join(plan, docs[id_col].eqNullSafe(plan[key])).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(words < F.col(size), F.array_join(F.slice(pieces, 1, words), "")).otherwise(F.col(text_col))
    return out.withColumn(text_col, cut).select(*docs.columns)


MIX_SQL = f"""
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM r GROUP BY source),
w AS (SELECT source, z, ((n - 1) % 3 + 1)::DOUBLE AS w FROM s),
o AS (SELECT *, sum(3 * z) OVER p AS c, sum(w) OVER p AS cw, sum(z) OVER () AS t, sum(w) OVER () AS tw FROM w
      WINDOW p AS (ORDER BY 3 * z / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT greatest(max(t / tw), coalesce(max(CASE WHEN cw < tw THEN (t - c) / (tw - cw) END), 0)) AS lev FROM o),
g AS (SELECT source, z, least(3 * z::DOUBLE, lev * w) AS target, floor(least(3 * z::DOUBLE, lev * w) + 0.5)::BIGINT AS b FROM w, l),
q AS (SELECT doc_id, size, source,
             (sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before FROM r)
SELECT doc_id, size, z AS source_size, target,
       (CASE WHEN z > 0 THEN (b // z) * size + greatest(0, least(size, b % z - before)) ELSE 0 END)::BIGINT AS taken
FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
"""
