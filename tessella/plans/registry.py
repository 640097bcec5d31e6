"""Registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import document as D
from tessella.operators import graph as G
from tessella.operators import kv as KV
from tessella.operators import predicate as P
from tessella.operators import timeseries as TS
from tessella.operators import validate as V
from tessella.operators.relational import Relational
from tessella.plans import graph_language
from tessella.plans.compiler import SEQ
from tessella.schema import Column, TableSchema
from tessella.sources import codec, results

START = 1_704_067_200  # 2024-01-01, in seconds


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    """The event stream with whole seconds, and with NULLs in every seventh value."""
    e = table(spark, sf_dir, "events").withColumn("ts_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.withColumn("holed", F.when(F.col("event_id") % 7 != 0, F.col("value")))


EVENTS = "(SELECT *, epoch_us(ts) // 1000000 AS ts_s, CASE WHEN event_id % 7 <> 0 THEN value END AS holed FROM events)"


def session(spark, sf_dir, name) -> Relational:
    db = Relational(spark)
    if name == "events":
        e = events(spark, sf_dir)
        db.register("events", e.select("event_id", "ts_s", "user_id", "event_type", "value", "holed", "props"), "event_id")
        # rows of one second come in the order of their ids
        db.register("metrics", e.select(F.col("ts_s").alias("timestamp"), "event_id", "user_id", "value"), "event_id")
    else:
        db.register(name, table(spark, sf_dir, name))
    return db


def sql_query(name, text, rounded=()):
    def run(spark, sf_dir):
        df = session(spark, sf_dir, "events" if name == "metrics" else name).sql(text)
        return df.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else df

    return run


def predicate_query(name, pred, columns):
    return lambda spark, sf_dir: session(spark, sf_dir, name).select(name, columns, pred)


def series_range(columns, start, end, granularity="s", where=None):
    return lambda spark, sf_dir: TS.time_range(events(spark, sf_dir), "ts_s", start, end, granularity, where, instant="ts").select(*columns)


def series_aggregate(what, value="value", start=START, end=2_000_000_000, width=3600, granularity="s", where=None):
    def run(spark, sf_dir):
        out = TS.aggregate(events(spark, sf_dir), "ts_s", value, what, start, end, width, granularity, where, instant="ts")
        return out.withColumn("value", F.round("value", 6)) if what != "count" else out

    return run


def series_sql(expression, value="value", start=START, end=2_000_000_000, width=3600, where="true", scale="ts_s"):
    rounded = expression if expression.startswith("count") else f"round({expression}, 6)"
    return f"SELECT ({scale} - (({scale} - {start}) % {width} + {width}) % {width})::BIGINT AS bucket_start, {rounded.replace('VALUE', value)} AS value FROM {EVENTS} WHERE {scale} >= {start} AND {scale} < {end} AND {where} GROUP BY 1"


ARRIVAL = "(event_id // 10007 * 10007 + (event_id * 7919) % 10007)"
#: Row by row in the order of arrival: what is too old goes, then the first of the oldest hour beyond 20 rows.
BOTH = f"""WITH RECURSIVE a AS (SELECT event_id, user_id, ts_s, {ARRIVAL} AS s, row_number() OVER (PARTITION BY user_id ORDER BY {ARRIVAL}) AS i FROM {EVENTS}),
r(user_id, i, kept) AS (
  SELECT user_id, 0::BIGINT, []::STRUCT(b BIGINT, s BIGINT, t BIGINT, e BIGINT)[] FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL
  SELECT user_id, i, CASE WHEN len(l) > 20 THEN l[len(l) - 19:] ELSE l END
  FROM (SELECT a.user_id, a.i, list_sort(list_filter(list_append(r.kept, {{'b': a.ts_s // 3600 * 3600, 's': a.s, 't': a.ts_s, 'e': a.event_id}}), lambda x: x.t >= a.ts_s - 2000000)) AS l
        FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1))
SELECT unnest(kept).e AS event_id, user_id FROM (SELECT user_id, arg_max(kept, i) AS kept FROM r GROUP BY user_id)"""


def arrivals(spark, sf_dir) -> DataFrame:
    """Events in an order of arrival that is not that of time: every 10,007 ids in an order of their own."""
    block = F.floor(F.col("event_id") / 10_007).cast("long")
    return events(spark, sf_dir).withColumn("arrival", block * 10_007 + (F.col("event_id") * 7919) % 10_007).select("event_id", "user_id", "ts_s", "arrival")


def retention_ttl(spark, sf_dir):
    return TS.retain_ttl(arrivals(spark, sf_dir).drop("user_id"), F.col("ts_s"), "arrival", 2_000_000).select("event_id")


def retention_rows(spark, sf_dir):
    return TS.retain_max_rows(arrivals(spark, sf_dir).drop("user_id"), F.col("ts_s"), "arrival", 777).select("event_id")


def retention_both(spark, sf_dir):
    return TS.retain_both(arrivals(spark, sf_dir), F.col("ts_s"), "arrival", 2_000_000, 20, ["user_id"]).select("event_id", "user_id")


def partition_buckets(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(TS.partition_bucket(F.col("ts_s"), "daily").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def documents(spark, sf_dir) -> DataFrame:
    """Events as documents (key, doc); every seventh lacks its value, every eleventh holds text in it."""
    e = events(spark, sf_dir)
    value = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('"n'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string"))
    body = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"'), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit(',"value":'), value)).otherwise(""), F.lit("}"))
    return e.select(F.col("event_id").cast("string").alias("key"), F.parse_json(body).alias("doc"), F.col("event_id").alias(SEQ))


def document_query(where):
    return lambda spark, sf_dir: D.matching(documents(spark, sf_dir), where).select("key")


def document_project(spark, sf_dir):
    rows = documents(spark, sf_dir).select("key", D.project(F.col("doc"), ["kind", "value"]).alias("d"))
    return rows.select("key", D.field(F.col("d"), "kind", "string").alias("kind"), D.field(F.col("d"), "value", "string").isNotNull().alias("has_value"), D.field(F.col("d"), "user", "int").isNotNull().alias("has_user"))


def document_upsert(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(F.col("event_id").alias("last"))).alias("j"), F.col("event_id").alias(SEQ))
    kept = D.upserted(e.select("key", F.parse_json("j").alias("doc"), SEQ))
    return kept.select("key", D.field(F.col("doc"), "last", "int").alias("last"))


def edges(spark, sf_dir) -> DataFrame:
    """From each event's user to the user of the third event after it, by day; a multigraph of five types."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    nxt = e.select((F.col("event_id") - 3).alias("event_id"), F.col("user_id").alias("dst"))
    return e.join(nxt, "event_id").select(F.col("event_id").alias("id"), F.col("user_id").alias("src"), "dst", F.col("event_type").alias("type"), F.col("event_id").alias(SEQ))


EDGES = "(SELECT a.event_id AS id, a.user_id AS src, b.user_id AS dst, a.event_type AS type, a.event_id AS seq FROM events a JOIN events b ON b.event_id = a.event_id + 3)"
def nodes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()


def graphs(spark, sf_dir) -> G.Graphs:
    out = G.Graphs(spark)
    out.register("g", nodes(spark, sf_dir), edges(spark, sf_dir))
    return out


def first_node(spark, sf_dir) -> int:
    return edges(spark, sf_dir).orderBy(SEQ).select("src").first().src


#: The nodes within 30 steps of the first, and their distance.
REACH = f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EDGES}), s AS (SELECT src AS n FROM {EDGES} ORDER BY seq LIMIT 1), r(n, d) AS (SELECT n, 0 FROM s UNION SELECT dst, d + 1 FROM r JOIN e ON src = n WHERE d < 30), f AS (SELECT n, min(d) AS d FROM r GROUP BY n)"
#: The nodes within 3 steps in the order of a queue: by level, place of the first parent, and edge.
QUEUE = f"""WITH e AS (SELECT * FROM {EDGES}), l0 AS (SELECT src AS n, 0 AS k, 0 AS s FROM e ORDER BY seq LIMIT 1),
l1 AS (SELECT dst AS n, min(seq) AS s FROM e WHERE src = (SELECT n FROM l0) AND dst NOT IN (SELECT n FROM l0) GROUP BY dst),
r1 AS (SELECT n, row_number() OVER (ORDER BY s) AS k FROM l1),
l2 AS (SELECT dst AS n, min((k, seq)) AS s, arg_min(src, (k, seq)) AS p FROM e JOIN r1 ON src = n WHERE dst NOT IN (SELECT n FROM l0) AND dst NOT IN (SELECT n FROM l1) GROUP BY dst),
r2 AS (SELECT n, row_number() OVER (ORDER BY s) AS k FROM l2),
l3 AS (SELECT dst AS n, min((k, seq)) AS s, arg_min(src, (k, seq)) AS p FROM e JOIN r2 ON src = n WHERE dst NOT IN (SELECT n FROM l0) AND dst NOT IN (SELECT n FROM l1) AND dst NOT IN (SELECT n FROM l2) GROUP BY dst),
q AS (SELECT n, 0 AS lev, 0 AS k, 0 AS s, NULL::BIGINT AS p FROM l0 UNION ALL SELECT n, 1, 0, s, (SELECT n FROM l0) FROM l1
      UNION ALL SELECT n, 2, row_number() OVER (ORDER BY s), 0, p FROM l2 UNION ALL SELECT n, 3, row_number() OVER (ORDER BY s), 0, p FROM l3)"""


def bfs_levels(spark, sf_dir):
    return G.breadth_first(edges(spark, sf_dir), first_node(spark, sf_dir)).select(F.col("id").alias("node_id"), F.col("level").cast("long").alias("level"))


def farthest(spark, sf_dir) -> int:
    return G.breadth_first(edges(spark, sf_dir), first_node(spark, sf_dir)).orderBy(F.desc("level"), F.desc("id")).select("id").first().id


def graph_statement(text, ends=False):
    def run(spark, sf_dir):
        a = first_node(spark, sf_dir)
        return graph_language.execute(graphs(spark, sf_dir), text.format(a=a, b=farthest(spark, sf_dir) if ends else a))

    return run


def shortest_steps(spark, sf_dir):
    path = graph_statement("SHORTEST_PATH g FROM {a} TO {b}", True)(spark, sf_dir)
    return path.groupBy(F.lit(1).cast("long").alias("one")).agg(F.max("step").alias("steps"), F.max_by("node_id", "step").alias("goal")).drop("one")


def node_erased(spark, sf_dir):
    a = first_node(spark, sf_dir)
    return G.erase_node(nodes(spark, sf_dir), edges(spark, sf_dir), a)[1].select("id", "src", "dst")


def edges_dangling(spark, sf_dir):
    known = nodes(spark, sf_dir).where("id % 3 <> 0")
    return G.dangling(known, edges(spark, sf_dir)).select("id")


def pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("last").alias("table"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("value"), F.col("event_id").alias(SEQ))


PERSONS = TableSchema([Column("c_custkey", "int", nullable=False, unique=True), Column("c_name", "string", max_length=18), Column("c_acctbal", "float", min_value=0.0), Column("c_mktsegment", "string", one_of=("BUILDING", "AUTOMOBILE", "MACHINERY"))])


def validated(spark, sf_dir):
    return V.row_errors(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), PERSONS).where("error is not null").select("c_custkey", "error")


def changed(*statements):
    def run(spark, sf_dir):
        db = session(spark, sf_dir, "customer")
        for s in statements:
            db.sql(s)
        return db.table("customer").withColumn("c_acctbal", F.round("c_acctbal", 6))

    return run


def truncated(spark, sf_dir):
    db = session(spark, sf_dir, "customer")
    db.truncate("customer")
    return db.table("customer").select("c_custkey")


def joined_models(spark, sf_dir):
    """Documents looked up by rows: each customer's orders, by one join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


CUSTOMER = "c_custkey, c_name, c_nationkey, {bal} AS c_acctbal, {seg} AS c_mktsegment FROM customer"


def _q():
    """name: (query, SQL or None)."""
    c = P.cmp
    out = {
        "sql_select_star": (sql_query("nation", "SELECT * FROM nation"), "SELECT * FROM nation"),
        "sql_project_filter": (sql_query("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5"),
        "sql_and_or_nested": (sql_query("customer", "SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND (c_mktsegment = 'BUILDING' OR NOT c_nationkey >= 10)"), "SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND (c_mktsegment = 'BUILDING' OR NOT c_nationkey >= 10)"),
        "sql_not_demorgan": (sql_query("events", "SELECT event_id FROM events WHERE NOT (holed > 100 OR user_id = 3)"), f"SELECT event_id FROM {EVENTS} WHERE NOT (holed > 100 OR user_id = 3)"),
        "sql_between": (sql_query("part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9"), "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9"),
        "sql_not_between": (sql_query("part", "SELECT p_partkey FROM part WHERE NOT p_retailprice BETWEEN 950 AND 1500"), "SELECT p_partkey FROM part WHERE NOT p_retailprice BETWEEN 950 AND 1500"),
        "sql_literal_fold_true": (sql_query("nation", "SELECT n_name FROM nation WHERE 1 < 2 OR n_regionkey = 9"), "SELECT n_name FROM nation"),
        "sql_literal_fold_false": (sql_query("nation", "SELECT n_name FROM nation WHERE (NOT (1 < 2)) AND n_regionkey = 1"), "SELECT n_name FROM nation WHERE false"),
        "sql_reversed_operand": (sql_query("supplier", "SELECT s_suppkey FROM supplier WHERE 1000 <= s_acctbal"), "SELECT s_suppkey FROM supplier WHERE 1000 <= s_acctbal"),
        "sql_type_rank_compare": (sql_query("customer", "SELECT c_custkey FROM customer WHERE c_name > 5 AND c_custkey < 'x' AND c_custkey < 50"), "SELECT c_custkey FROM customer WHERE c_custkey < 50"),
        "sql_negative_literal": (sql_query("customer", "SELECT c_custkey FROM customer WHERE c_acctbal < -10.5"), "SELECT c_custkey FROM customer WHERE c_acctbal < -10.5"),
        "sql_arith_int": (sql_query("part", "SELECT p_partkey, p_size * 2 + 1 - p_partkey AS x FROM part"), "SELECT p_partkey, (p_size * 2 + 1 - p_partkey)::BIGINT AS x FROM part"),
        "sql_arith_div": (sql_query("part", "SELECT p_partkey, p_size / 4 AS x, -p_size AS y FROM part", ("x",)), "SELECT p_partkey, round(p_size / 4.0, 6)::DOUBLE AS x, (-p_size)::BIGINT AS y FROM part"),
        "sql_concat": (sql_query("customer", "SELECT c_name + '_' + c_nationkey AS tag FROM customer"), "SELECT c_name || '_' || c_nationkey::VARCHAR AS tag FROM customer"),
        "sql_concat_double": (sql_query("part", "SELECT p_partkey, 'p' + p_retailprice AS tag FROM part"), "SELECT p_partkey, 'p' || CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS tag FROM part"),
        "sql_compare_expr": (sql_query("events", "SELECT event_id, holed < 100 AS low FROM events"), f"SELECT event_id, coalesce(holed < 100, true) AS low FROM {EVENTS}"),
        "sql_bool_expr": (sql_query("orders", "SELECT o_orderkey, NOT (o_totalprice > 1000 AND o_custkey) AS b FROM orders"), "SELECT o_orderkey, NOT (o_totalprice > 1000 AND o_custkey <> 0) AS b FROM orders"),
        "sql_output_names": (sql_query("nation", "SELECT n_nationkey, n_nationkey + 1, n_nationkey * 2 AS twice FROM nation"), "SELECT n_nationkey, n_nationkey::BIGINT + 1 AS expr, n_nationkey::BIGINT * 2 AS twice FROM nation"),
        "sql_time_bucket": (sql_query("events", "SELECT TIME_BUCKET(ts_s, 3600) AS bucket, FIRST(value, ts_s) AS open, LAST(value, ts_s) AS close FROM events"), f"SELECT ts_s // 3600 * 3600 AS bucket, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close FROM {EVENTS} GROUP BY 1"),
        "sql_first_last": (sql_query("events", "SELECT FIRST(user_id, ts_s) AS a, LAST(user_id, ts_s) AS b FROM events"), f"SELECT arg_min(user_id, event_id) AS a, arg_max(user_id, event_id) AS b FROM {EVENTS}"),
        "sql_first_last_default_order": (sql_query("metrics", "SELECT TIME_BUCKET(timestamp, 86400) AS day, FIRST(value) AS a, LAST(user_id) AS b FROM metrics"), f"SELECT ts_s // 86400 * 86400 AS day, arg_min(value, event_id) AS a, arg_max(user_id, event_id) AS b FROM {EVENTS} GROUP BY 1"),
        "sql_bucket_first_last_where": (sql_query("events", "SELECT TIME_BUCKET(ts_s, 7200), LAST(event_type, event_id) FROM events WHERE user_id < 50 AND event_type != 'view'"), f"SELECT ts_s // 7200 * 7200 AS time_bucket, arg_max(event_type, event_id) AS last FROM {EVENTS} WHERE user_id < 50 AND event_type <> 'view' GROUP BY ts_s // 7200"),
        "sql_agg_bare_expr": (sql_query("events", "SELECT TIME_BUCKET(ts_s, 86400) AS day, user_id * 2 AS twice FROM events"), f"SELECT ts_s // 86400 * 86400 AS day, arg_min(user_id, event_id) * 2 AS twice FROM {EVENTS} GROUP BY 1"),
        "sql_first_keeps_null": (sql_query("events", "SELECT TIME_BUCKET(event_id, 7) AS b, FIRST(holed, event_id) AS f FROM events"), f"SELECT event_id // 7 * 7 AS b, NULL::DOUBLE AS f FROM {EVENTS} GROUP BY 1"),
        "sql_empty_global_agg": (sql_query("events", "SELECT FIRST(value) AS a FROM events WHERE user_id < 0"), "SELECT value AS a FROM events WHERE false"),
        "sql_bucket_negative": (sql_query("customer", "SELECT TIME_BUCKET(c_custkey - 700, 100) AS b, FIRST(c_custkey, c_custkey) AS f FROM customer"), "SELECT trunc((c_custkey - 700) / 100.0)::BIGINT * 100 AS b, min(c_custkey) AS f FROM customer GROUP BY 1"),
        "pred_not_two_valued": (lambda s, d: session(s, d, "events").select("events", ["event_id"], P.negation(c("holed", ">", 100))), f"SELECT event_id FROM {EVENTS} WHERE NOT coalesce(holed > 100, false)"),
        "pred_nested": (lambda s, d: session(s, d, "events").select("events", ["event_id"], P.all_of(c("value", ">", 50), P.any_of(c("holed", "<", 200), P.negation(c("event_type", "=", "click"))))), f"SELECT event_id FROM {EVENTS} WHERE value > 50 AND (coalesce(holed < 200, false) OR NOT event_type = 'click')"),
        "pred_empty_and": (predicate_query("region", P.all_of(), ["r_name"]), "SELECT r_name FROM region"),
        "pred_empty_or": (predicate_query("region", P.any_of(), ["r_name"]), "SELECT r_name FROM region WHERE false"),
        "pred_empty_not": (predicate_query("region", P.negation(), ["r_name"]), "SELECT r_name FROM region WHERE false"),
        "pred_type_rank": (predicate_query("nation", P.all_of(c("n_name", ">", 7), c("n_nationkey", "<", "a"), c("n_nationkey", ">=", 2.5)), ["n_name"]), "SELECT n_name FROM nation WHERE n_nationkey >= 2.5"),
        "ts_range_project": (series_range(["event_id", "value"], START + 3600, START + 90_000), f"SELECT event_id, value FROM {EVENTS} WHERE ts_s >= {START + 3600} AND ts_s < {START + 90_000}"),
        "ts_range_where": (series_range(["event_id"], START, START + 700_000, where=P.negation(c("holed", "<", 250))), f"SELECT event_id FROM {EVENTS} WHERE ts_s >= {START} AND ts_s < {START + 700_000} AND NOT coalesce(holed < 250, false)"),
        "ts_range_unknown_column": (series_range(["event_id"], START, 2_000_000_000, where=c("nothing", "=", 1)), f"SELECT event_id FROM {EVENTS} WHERE false"),
        "ts_agg_count": (series_aggregate("count", "holed"), series_sql("count(*)", "holed")),
        "ts_agg_sum": (series_aggregate("sum", "holed"), series_sql("coalesce(sum(VALUE), 0)", "holed")),
        "ts_agg_min": (series_aggregate("min", "holed"), series_sql("coalesce(min(VALUE), 0)", "holed")),
        "ts_agg_max": (series_aggregate("max", "holed"), series_sql("coalesce(max(VALUE), 0)", "holed")),
        "ts_agg_avg": (series_aggregate("avg"), series_sql("sum(VALUE) / count(*)")),
        "ts_agg_avg_null_denominator": (series_aggregate("avg", "holed"), series_sql("coalesce(sum(VALUE), 0) / count(*)", "holed")),
        "ts_agg_anchor_offset": (series_aggregate("sum", start=START + 1234, width=5000), series_sql("sum(VALUE)", start=START + 1234, width=5000)),
        "ts_agg_where": (series_aggregate("count", where=c("event_type", "=", "purchase"), width=86_400), series_sql("count(*)", where="event_type = 'purchase'", width=86_400)),
        "ts_partition_bucket": (partition_buckets, f"SELECT ts_s // 86400 * 86400 AS bucket, count(*) AS rows FROM {EVENTS} GROUP BY 1"),
        "ts_retention_ttl": (retention_ttl, f"SELECT event_id FROM (SELECT event_id, ts_s, max(ts_s) OVER (ORDER BY {ARRIVAL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM {EVENTS}) WHERE ts_s >= m - 2000000"),
        "ts_retention_maxrows": (retention_rows, f"SELECT event_id FROM {EVENTS} ORDER BY ts_s // 3600 DESC, {ARRIVAL} DESC LIMIT 777"),
        "ts_retention_both": (retention_both, BOTH),
        "doc_filter": (document_query(P.all_of(c("value", ">", 100), c("kind", "=", "view"))), "SELECT event_id::VARCHAR AS key FROM events WHERE event_id % 7 <> 0 AND event_type = 'view' AND (event_id % 11 = 0 OR value > 100)"),
        "doc_not_missing": (document_query(P.negation(c("value", "<", 100))), "SELECT event_id::VARCHAR AS key FROM events WHERE NOT (event_id % 7 <> 0 AND event_id % 11 <> 0 AND value < 100)"),
        "doc_mixed_kinds": (document_query(c("value", ">=", "n5")), "SELECT event_id::VARCHAR AS key FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 0 AND 'n' || user_id::VARCHAR >= 'n5'"),
        "doc_project": (document_project, "SELECT event_id::VARCHAR AS key, event_type AS kind, event_id % 7 <> 0 AS has_value, false AS has_user FROM events"),
        "doc_upsert_last_wins": (document_upsert, "SELECT user_id::VARCHAR AS key, max(event_id) AS last FROM events GROUP BY 1"),
        "doc_count": (lambda s, d: documents(s, d).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM events"),
        "graph_out": (lambda s, d: G.neighbors_out(edges(s, d), first_node(s, d)), f"SELECT dst AS node_id FROM {EDGES} WHERE src = (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1)"),
        "graph_in": (lambda s, d: G.neighbors_in(edges(s, d), first_node(s, d)), f"SELECT src AS node_id FROM {EDGES} WHERE dst = (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1)"),
        "graph_edges_out": (lambda s, d: G.edges_out(edges(s, d), first_node(s, d)), f"SELECT id FROM {EDGES} WHERE src = (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1)"),
        "graph_bfs_levels": (bfs_levels, f"{REACH} SELECT n AS node_id, d::BIGINT AS level FROM f"),
        "graph_traverse_bfs": (graph_statement("TRAVERSE g FROM {a} BFS"), f"{REACH} SELECT n AS node_id FROM f"),
        "graph_traverse_dfs": (graph_statement("TRAVERSE g FROM {a} DFS"), f"{REACH} SELECT n AS node_id FROM f"),
        "graph_traverse_limit": (graph_statement("TRAVERSE g FROM {a} BFS LIMIT 7"), f"{QUEUE} SELECT n AS node_id FROM q ORDER BY lev, k, s LIMIT 7"),
        "graph_shortest_len": (shortest_steps, f"{REACH} SELECT d::BIGINT AS steps, n AS goal FROM f ORDER BY d DESC, n DESC LIMIT 1"),
        "graph_connected": (graph_statement("CONNECTED g FROM {a} TO {b}", True), "SELECT true AS value"),
        "graph_unreachable": (graph_statement("SHORTEST_PATH g FROM {a} TO 999999"), "SELECT 1::BIGINT AS step, 1::BIGINT AS node_id WHERE false"),
        "graph_match_typed": (lambda s, d: G.match(edges(s, d), first_node(s, d), "Click"), f"SELECT dst AS node_id FROM {EDGES} WHERE type = 'click' AND src = (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1)"),
        "graph_match_untyped": (graph_statement("MATCH g (a)-[]->(b) WHERE a = {a} RETURN b"), f"SELECT dst AS node_id FROM {EDGES} WHERE src = (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1)"),
        "node_erase_cascade": (node_erased, f"SELECT id, src, dst FROM {EDGES} WHERE src <> (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1) AND dst <> (SELECT src FROM {EDGES} ORDER BY seq LIMIT 1)"),
        "edge_endpoint_check": (edges_dangling, f"SELECT id FROM {EDGES} WHERE src % 3 = 0 OR dst % 3 = 0"),
        "kv_put_last_wins": (lambda s, d: KV.latest(pairs(s, d)).select("id", "value"), "SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS value FROM events GROUP BY 1"),
        "kv_get": (lambda s, d: KV.KeyValues(s, pairs(s, d)).execute("SELECT value FROM last WHERE id = '7'"), "SELECT '7' AS id, arg_max(event_type, event_id) AS value FROM events WHERE user_id = 7 HAVING count(*) > 0"),
        "validate_row_errors": (validated, "SELECT c_custkey, CASE WHEN strlen(c_name) > 18 THEN 'c_name is too long' WHEN c_acctbal < 0 THEN 'c_acctbal is too small' WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'c_mktsegment is not allowed' END AS error FROM customer WHERE error IS NOT NULL"),
        "validate_unique_dups": (lambda s, d: V.duplicates(table(s, d, "events"), "user_id"), "SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 1"),
        "dml_insert": (changed("INSERT INTO customer (c_custkey, c_name) VALUES (-1, 'new'), (-2, 'two')"), "SELECT " + CUSTOMER.format(bal="round(c_acctbal, 6)", seg="c_mktsegment") + " UNION ALL SELECT -1, 'new', NULL, NULL, NULL UNION ALL SELECT -2, 'two', NULL, NULL, NULL"),
        "dml_update_const": (changed("UPDATE customer SET c_mktsegment = 'NONE' WHERE c_acctbal < 0"), "SELECT " + CUSTOMER.format(bal="round(c_acctbal, 6)", seg="CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END")),
        "dml_update_computed": (changed("UPDATE customer SET c_acctbal = c_acctbal * 2 - 5, c_mktsegment = c_mktsegment + '_x' WHERE c_nationkey >= 12"), "SELECT " + CUSTOMER.format(bal="round(CASE WHEN c_nationkey >= 12 THEN c_acctbal * 2 - 5 ELSE c_acctbal END, 6)", seg="CASE WHEN c_nationkey >= 12 THEN c_mktsegment || '_x' ELSE c_mktsegment END")),
        "dml_update_colref": (changed("UPDATE customer SET c_mktsegment = c_name"), "SELECT " + CUSTOMER.format(bal="round(c_acctbal, 6)", seg="c_name")),
        "dml_update_sequential": (changed("UPDATE customer SET c_acctbal = c_acctbal + 1, c_acctbal = c_acctbal * 10 WHERE c_custkey < 100"), "SELECT " + CUSTOMER.format(bal="round(CASE WHEN c_custkey < 100 THEN (c_acctbal + 1) * 10 ELSE c_acctbal END, 6)", seg="c_mktsegment")),
        "dml_delete": (changed("DELETE FROM customer WHERE NOT c_acctbal >= 0"), "SELECT " + CUSTOMER.format(bal="round(c_acctbal, 6)", seg="c_mktsegment") + " WHERE c_acctbal >= 0"),
        "dml_truncate": (truncated, "SELECT c_custkey FROM customer WHERE false"),
        "result_page": (lambda s, d: results.page(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 50, 3), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 150"),
        "result_csv_lines": (lambda s, d: results.csv_lines(table(s, d, "nation"), always_quote=True), "SELECT '\"' || n_nationkey || '\",\"' || n_name || '\",\"' || n_regionkey || '\"' AS line FROM nation"),
        "result_text_cells": (lambda s, d: results.text_cells(table(s, d, "customer").select("c_custkey", "c_name")), "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer"),
        "result_json_lines": (lambda s, d: results.json_lines(table(s, d, "region")), "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region"),
        "codec_rows_json": (lambda s, d: codec.rows_json(table(s, d, "region")), "SELECT '{\"values\":[{\"t\":\"int\",\"v\":' || r_regionkey || '},{\"t\":\"string\",\"v\":\"' || r_name || '\"}],\"version\":1}' AS json FROM region"),
        "cross_model_lookup": (joined_models, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    }
    for name, unit, seconds in (("minutes", "m", 60), ("hours", "h", 3600), ("days", "d", 86_400)):
        # the column holds seconds; read as ``unit`` it is that many seconds each
        out[f"ts_agg_{name}"] = (series_aggregate("count", start=START // 1000, end=2_000_000_000, width=1000, granularity=unit), series_sql("count(*)", start=START // 1000 * seconds, end=2_000_000_000 * seconds, width=1000 * seconds, scale=f"(ts_s * {seconds})"))
    from tessella.plans import surface

    return out | surface.entries()


def flagship(spark, sf_dir) -> DataFrame:
    return _q()["sql_time_bucket"][0](spark, sf_dir)


def queries():
    return {k: q for k, (q, _) in _q().items()}


def oracle_sql():
    return {k: s for k, (_, s) in _q().items() if s is not None}
