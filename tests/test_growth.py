"""Steps whose cost must not grow faster than their rows."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from tessella.operators import document as D
from tessella.operators import predicate as P
from tessella.operators import timeseries as TS
from tessella.plans.compiler import SEQ
from tessella.schema import Column, DocumentSchema, SeriesSchema
from tests.test_models import model_retention


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_appended_frames_are_numbered_without_gaps(spark):
    r = random.Random(3)
    came = [(i * 7, 40_000 + i * 60 + r.randrange(-9000, 9000)) for i in range(600)]
    series = TS.TimeSeries(spark)
    series.create("s", SeriesSchema(tags=[Column("n", "int")], granularity="s", ttl_seconds=5000))
    frame = spark.createDataFrame([(t, n) for n, t in came], "timestamp long, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        series.append_frame("s", frame, "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = series.series["s"][2]
    assert {x.n for x in kept.collect()} == model_retention(came, 5000, 0)
    assert all(x[SEQ] == x.n // 7 for x in kept.select(SEQ, "n").collect())  # so spans of it hold as many rows each


def test_retention_never_sums_a_frame_anew(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), F.col("id").alias("t"))
    assert "unboundedfollowing" not in plan(TS.retain_ttl(df, F.col("t"), "seq", 10)).lower()


def test_a_document_is_parsed_once_for_a_comparison(spark):
    docs = spark.range(9).select(F.col("id").cast("string").alias("key"), F.parse_json(F.format_string('{"v":%d}', "id")).alias("doc"))
    for value in ("n5", 5, 2.5, True):
        assert plan(D.matching(docs, P.cmp("v", ">=", value)).select("key")).split("Filter", 1)[1].split("\n")[0].count("parseJson") == 1
    checked = D.document_errors(docs, DocumentSchema([Column("v", "int", nullable=False, max_value=5)])).select("error")
    assert plan(checked).count("parseJson") == 1
    assert [r.error for r in checked.collect()].count("v is out of range") == 3
