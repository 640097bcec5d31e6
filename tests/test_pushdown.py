"""What reaches the scan, and that it changes no rows."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from tessella.operators import predicate as P
from tessella.operators import timeseries as TS
from tessella.plans import compiler
from tessella.plans.parser import parse
from tessella.schema import Column, SeriesSchema
from tessella.session import Session


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    """The filters that the scans take."""
    return "".join(x.split("]")[0] for x in plan(df).split("PushedFilters: [")[1:])


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    r = random.Random(4)
    data = [(i, r.choice([None, -1.5, 0.0, 2.0, float("nan")]), r.choice([None, "a", "b", ""]), r.choice([None, True, False])) for i in range(60)]
    path = str(tmp_path_factory.mktemp("push") / "t")
    spark.createDataFrame(data, "id long, x double, s string, b boolean").write.parquet(path)
    return path


SIDES = [("id", 7), ("id", 2.5), ("x", 0), ("x", 1.5), ("x", "a"), ("x", None), ("s", "a"), ("s", ""), ("s", 5), ("b", True), ("none", 3)]


def trees(r, depth=3):
    if not depth or r.random() < 0.3:
        column, value = r.choice(SIDES)
        return P.cmp(column, r.choice(["=", "!=", "<", "<=", ">", ">="]), value)
    kind = r.randrange(3)
    if kind == 2:
        return P.negation(trees(r, depth - 1))
    return (P.all_of, P.any_of)[kind](*[trees(r, depth - 1) for _ in range(r.randrange(3))])


def test_filters_and_two_valued_columns_agree(spark, rows):
    df, r = spark.read.parquet(rows), random.Random(9)
    for _ in range(25):
        pred = trees(r)
        want = df.select("id", P.to_column(pred, df.schema).alias("v")).collect()
        assert sorted(x.id for x in df.where(P.to_filter(pred, df.schema)).collect()) == sorted(x.id for x in want if x.v), pred
        assert sorted(x.id for x in df.where(P.to_filter(pred, df.schema, False)).collect()) == sorted(x.id for x in want if not x.v), pred


def test_what_a_delete_keeps(spark, rows):
    df = spark.read.parquet(rows)
    for text in ["x > 0", "NOT x > 0", "NOT (x > 0 AND s = 'a')", "x BETWEEN -2 AND 1 OR NOT (s != 'b' OR id < 9)", "NOT x BETWEEN -2 AND 1", "1 < 2 AND 3 > id", "NOT (1 > 2)"]:
        where = parse(f"DELETE FROM t WHERE {text}").where
        gone = {r.id for r in df.where(compiler.condition(where, df)).collect()}
        assert {r.id for r in df.where(compiler.unmet(where, df)).collect()} == set(range(60)) - gone, text


def test_comparisons_reach_the_scan(spark, rows):
    s = Session(spark)
    s.tables.register("t", spark.read.parquet(rows))
    assert "GreaterThan(id,50)" in pushed(s.tables.select("t", ["id"], P.all_of(P.cmp("id", ">", 50), P.any_of(P.cmp("x", "<", 2.0), P.negation(P.cmp("s", "=", "a"))))))
    assert "IsNull(x)" in pushed(s.tables.select("t", ["id"], P.negation(P.cmp("x", "<", 2.0)))) and "GreaterThanOrEqual(x,2.0)" in pushed(s.tables.select("t", ["id"], P.negation(P.cmp("x", "<", 2.0))))
    s.sql("DELETE FROM t WHERE NOT x >= 0.0")
    assert "GreaterThanOrEqual(x,0.0)" in pushed(s.tables.table("t"))
    s.tables.delete("t", P.cmp("id", "<", 10))
    assert "GreaterThanOrEqual(id,10)" in pushed(s.tables.table("t"))


def test_raw_bounds():
    for granularity, unit in (("ms", 1000), ("s", 1), ("m", 60)):
        for low, high in itertools.product((-3, -1, 0, 1, 2, 120), (-2, 0, 1, 3, 180)):
            first, last = TS.raw_bounds(low, high, granularity)
            sec = (lambda t: t * unit) if granularity == "m" else (lambda t: int(t / unit))
            for t in range(-4000, 4000, 1 if unit < 1000 else 7):
                assert (first <= t <= last) == (low <= sec(t) < high), (granularity, low, high, t)


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.range(100).select("id", (F.col("id") * 60_000).alias("ms"), F.timestamp_seconds(F.col("id") * 60).alias("at")).withColumn("sec", F.unix_seconds("at")).write.parquet(path)
    df = spark.read.parquet(path)
    got = TS.time_range(df, "ms", 600_000, 1_200_000, "ms")
    assert "GreaterThanOrEqual(ms,600000)" in pushed(got) and sorted(r.id for r in got.collect()) == list(range(10, 20))
    made = df.withColumn("computed", F.unix_seconds("at"))
    got = TS.time_range(made, "computed", 600, 1200, instant="at")
    assert "GreaterThanOrEqual(at," in pushed(got) and sorted(r.id for r in got.collect()) == list(range(10, 20))


@pytest.fixture
def stored_series(spark, tmp_path):
    s, path = Session(spark), str(tmp_path / "series")
    schema = SeriesSchema("t", tags=[Column("k", "int")], values=[Column("v", "float")], granularity="ms")
    frame = spark.range(2000).select((F.col("id") * 97_000).alias("t"), (F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("v"))
    s.series.create("made", schema)
    s.series.append_frame("made", frame, "t")
    s.series.save("made", path)
    s.series.load("again", schema, path)
    return s


def test_partitions_are_pruned(stored_series):
    s = stored_series
    made, again = (s.series.range_query(n, ["t", "v"], 30_000_000, 60_000_000) for n in ("made", "again"))
    assert [tuple(r) for r in made.collect()] == [tuple(r) for r in again.collect()] and made.count() > 300
    text = plan(again)
    assert "PartitionFilters: [isnotnull(__bucket" in text and "(__bucket" in text.split("PartitionFilters")[1].split("]")[0]
    totals = [s.series.aggregate(n, "v", "sum", 0, 200_000_000, 7_200_000).collect() for n in ("made", "again")]
    assert totals[0] == totals[1]
    s.series.append("again", [(500_000_000, 1, 2.0)])  # a stored series takes further rows
    assert s.series.range_query("again", None, 0, 10**12).count() == 2001


def test_append_frame_checks(spark):
    from tessella.errors import FailedPrecondition, InvalidArgument

    s = Session(spark)
    s.series.create("x", SeriesSchema("t", values=[Column("v", "float", max_value=9.0)], granularity="s", max_rows=3))
    for bad, error in ((spark.range(3), FailedPrecondition), (spark.createDataFrame([("a", 1.0)], "t string, v double"), InvalidArgument), (spark.createDataFrame([(1, 10.0)], "t long, v double"), InvalidArgument)):
        with pytest.raises(error):
            s.series.append_frame("x", bad)
    s.series.append_frame("x", spark.createDataFrame([(9, 1.0, 5), (4, 2.0, 1), (5, 3.0, 2), (6, 4.0, 3)], "t long, v double, n int"), "n")
    s.series.append_frame("x", spark.createDataFrame([(7, 5.0)], "t long, v double"))
    assert [tuple(r) for r in s.series.range_query("x", ["t", "v"], 0, 99).collect()] == [(6, 4.0), (9, 1.0), (7, 5.0)]
