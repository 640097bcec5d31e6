"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import embeddings, mixing, packing, sharding, simhash, sketch, suffix, tokens, toxicity, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_sum_of_squares(spark, sf_dir):
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark, sf_dir):
    return tokens.token_counts(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op3_toxicity(spark, sf_dir):
    scored = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix.digests(suffix.repeated(_table(spark, sf_dir, "documents")))


def op5_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_bottom_k(spark, sf_dir):
    return sketch.against_edits(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_stratified_shards(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op10_cross_polytope(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries():
    return {
        "op1_pack_sum_of_squares": op1_pack_sum_of_squares,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_warc": op5_warc,
        "op6_bottom_k": op6_bottom_k,
        "op7_mix_sources": op7_mix_sources,
        "op8_stratified_shards": op8_stratified_shards,
        "op9_simhash": op9_simhash,
        "op10_cross_polytope": op10_cross_polytope,
    }


def oracle_sql():
    return {
        "op4_suffix_dedup": suffix.DIGESTS_SQL,
        "op5_warc": warc.ROUND_TRIP_SQL,
        "op7_mix_sources": mixing.MIX_SQL,
        "op8_stratified_shards": sharding.SHARD_SQL,
        "op10_cross_polytope": embeddings.LINKS_SQL,
    }
