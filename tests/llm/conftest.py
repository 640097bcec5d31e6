import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text, source) rows, over several partitions."""

    def make(rows, parts=3):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


HARD = [
    None, "", " ", "\n\n", "a", "Ünïcode über alles, ça va?", "x" * 30_000, "don't  stop\t\tme\n now ", "tail  ", "\x1cfoo\x1d bar", "<|endoftext|> and a<|ENDOFTEXT|>b",
    " nbsp em　wide", "é combining ́x", "日本語 テキスト 🙂🙂", "1234 5,678.90", "word " * 9000, "same text", "same text", "ΣΑΣ ΟΔΥΣΣΕΥΣ İstanbul", "a\x00b \x85 c",
]


@pytest.fixture(scope="session")
def hard_rows():
    return [(i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(HARD)]
