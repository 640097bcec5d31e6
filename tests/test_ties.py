"""Rows that share a time: which one counts as the first and the last."""

from datetime import datetime, timedelta

from tessella.plans import registry


def test_first_and_last_of_one_second(spark, tmp_path):
    ids = [5, 2, 9, 0, 7, 1, 8, 3, 6, 4]
    full = [(i, datetime(2024, 1, 1 + i // 5) + timedelta(milliseconds=i), i * 10, "view", float(i), "{}") for i in ids]
    frame = spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["sql_first_last_default_order"](spark, str(tmp_path)).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, 40), (5.0, 90)]
