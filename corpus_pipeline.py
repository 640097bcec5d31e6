"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it as the next one's
documents.  All but the last return the columns of documents.  Ids may be null
or repeated: stages tell rows apart by a key of their own.

1. toxicity: documents that score 0.5 or more go.
2. simhash: of documents joined by a similarity of 0.8 or more of their five-word shingles, as proposed by their SimHash, the one with the smallest id stays.
3. suffix_dedup: passages of 100 bytes or more that came earlier are cut from the texts, by whole characters.
4. mixing: sources are cut or repeated to their targets; a document appears once for each time it is taken, the last time cut to the words taken.
5. packing: the documents' tokens in sequences of 4096.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import mixing, packing, shingles, suffix, toxicity
from tessella.llm.common import STORED, delete_path, fresh_path, keyed, sweep, unused


def toxicity_stage(spark, docs, sf_dir):
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark, docs, sf_dir):
    return shingles.keep_first(docs)


def suffix_stage(spark, docs, sf_dir):
    return suffix.without_repeats(docs)


def mixing_stage(spark, docs, sf_dir):
    row = unused(docs, "_row")
    rows = keyed(docs, "doc_id", "text", row)
    mixed = mixing.materialize(rows, mixing.mix(rows, row_col=row), id_col=row)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("suffix_dedup", suffix_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't train a compressor or tokenise; tests hold each stage against a plain model instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        others, before, path = {*STORED}, path, fresh_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        sweep(spark, others)  # the stage's own tables
        if before:
            delete_path(spark, before)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
