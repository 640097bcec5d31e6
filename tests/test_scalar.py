import math

import pytest

from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.functions import scalar as S


def test_text_of_double(spark):
    values = [0.0, 1.0, 1.5, -2.25, 1e15, 1e14, 123456789012345.0, 1e-4, 1e-5, 0.1 + 0.2, 1 / 3, 1e300, -1e-300, 100000.0, 12345.678901, math.inf, -math.inf, math.nan, 3e22, 0.00012345]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = [r.t for r in df.select(S.text_of_double(F.col("x")).alias("t")).collect()]
    assert got == [*("%.15g" % v for v in values), "null"]


def model(a, op, b, nulls=True):
    ra, rb = S.RANK[S.kind_of_value(a)], S.RANK[S.kind_of_value(b)]
    if not (ra == rb or {ra, rb} <= {1, 2}) or a is None:
        return S.OPS[op](ra, rb)
    return S.OPS[op](a.encode(), b.encode()) if isinstance(a, str) else S.OPS[op](a, b)


VALUES = [None, 0, 3, -7, 2.5, 3.0, "", "a", "é", True, False]


def test_compared_against_model(spark):
    row = spark.range(1)
    for op in S.OPS:
        pairs = [(a, b) for a in VALUES for b in VALUES]
        got = row.select(*[S.compared(S.literal(a), S.kind_of_value(a), op, S.literal(b), S.kind_of_value(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
        assert [*got] == [model(a, op, b) for a, b in pairs]


def test_arithmetic(spark):
    row = spark.range(1)
    value = lambda op, a, b: row.select(S.arithmetic(op, S.literal(a), S.kind_of_value(a), S.literal(b), S.kind_of_value(b))[0]).first()[0]
    assert value("+", 2, 3) == 5 and isinstance(value("+", 2, 3), int)
    assert value("/", 7, 2) == 3.5 and value("/", 4, 2) == 2.0 and value("*", 2, 1.5) == 3.0
    assert value("+", "a", 1) == "a1" and value("+", 1.0, "b") == "1b" and value("+", "x", True) == "xtrue" and value("+", "n", None) == "nnull"
    with pytest.raises(InvalidArgument):
        S.arithmetic("-", S.literal("a"), "string", S.literal(1), "int")
    with pytest.raises(Exception, match="division by zero"):
        value("/", 1, 0)


def test_truth(spark):
    got = spark.range(1).select(*[S.truth(S.literal(v), S.kind_of_value(v)).alias(f"c{i}") for i, v in enumerate([0, 2, 0.0, -1.5, "", "0", True, False])]).first()
    assert [*got] == [False, True, False, True, False, True, True, False]
