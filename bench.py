"""Times headline queries; prints one JSON line.

Each query runs to the end (a no-op sink) once to warm up, then three times;
the median counts.  BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def shapes():
    from tessella.operators import graph, timeseries
    from tessella.plans import registry

    def table(s, d, n):
        return s.read.parquet(f"{d}/{n}.parquet")

    return {
        "filter_scan": lambda s, d: registry.sql_query("lineitem", "SELECT * FROM lineitem WHERE l_quantity < 5")(s, d),
        "series_range": lambda s, d: timeseries.time_range(registry.events(s, d), "ts_s", 0, 4_000_000_000),
        "series_sum_60s": lambda s, d: timeseries.aggregate(registry.events(s, d), "ts_s", "value", "sum", 0, 4_000_000_000, 60),
        "time_bucket_first_last": registry.flagship,
        "bfs": lambda s, d: graph.breadth_first(registry.edges(s, d), registry.first_node(s, d)),
        "sql_arith": registry.queries()["sql_arith_div"],
        "update_computed": registry.queries()["dml_update_computed"],
        "retention_ttl": registry.queries()["ts_retention_ttl"],
        "orders_with_lines": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.sum("l_extendedprice")),
    }


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", "/tmp/bench-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = shapes()
    try:
        from tessella.llm import queries as llm

        queries |= {k: q for k, q in llm.queries().items()}
    except ImportError:
        pass
    took = {}
    for name, query in queries.items():
        runs = []
        for k in range(2 if name.startswith("op") else 4):
            began = time.time()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total seconds of headline queries, warm", "value": total, "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
