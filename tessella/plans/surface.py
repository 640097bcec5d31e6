"""Registered queries of the engine's API: catalogs, changes, errors, codecs, files and results.

Those that return facts have rows (item, value); their SQL states what must come out.
"""

from __future__ import annotations

import io
import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import __version__, auth, repl, service
from tessella.errors import EngineError
from tessella.operators import document as D
from tessella.operators import timeseries as TS
from tessella.operators import validate as V
from tessella.operators.kv import KeyValues
from tessella.plans import ast, registry
from tessella.plans.compiler import SEQ
from tessella.plans.lexer import tokenize
from tessella.plans.parser import parse
from tessella.schema import Column, DocumentSchema, SeriesSchema, TableSchema
from tessella.session import Session
from tessella.sources import codec, files, results
from tessella.streaming import series as streams


def scratch(spark, name: str) -> str:
    """A path of its own in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def facts(find):
    """A query of (item, value) rows from ``find``: (session, path of the tables) to a dict."""

    def run(spark, sf_dir):
        found = find(Session(spark), sf_dir)
        return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in found.items()], "item string, value string")

    return run


def stated(**values) -> str:
    rows = ", ".join("('{}', '{}')".format(k, (v if isinstance(v, str) else json.dumps(v)).replace("'", "''")) for k, v in values.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(item, value)"


def code(call) -> str:
    """The error code of a call, or OK."""
    try:
        call()
    except EngineError as e:
        return e.code
    return "OK"


def table(s: Session, sf_dir: str, name: str) -> DataFrame:
    return registry.table(s.spark, sf_dir, name)


def catalog_tables(s, _):
    for name in ("b", "a", "c"):
        s.tables.create(name, TableSchema([Column("x", "int")]))
    again, missing = code(lambda: s.tables.create("a", TableSchema([]))), code(lambda: s.tables.drop("zz"))
    s.tables.drop("b")
    return {"names": s.tables.names(), "again": again, "missing": missing, "rows": s.tables.table("a").count(), "truncate": code(lambda: s.tables.truncate("b"))}


def catalog_collections(s, _):
    for name in ("docs", "more"):
        s.documents.create(name)
    again, missing = code(lambda: s.documents.create("docs")), code(lambda: s.documents.drop("zz"))
    s.documents.drop("more")
    s.documents.put("implicit", "k", {"a": 1})
    return {"names": s.documents.names(), "again": again, "missing": missing, "count": s.documents.count("implicit")}


def catalog_series(s, _):
    schema = SeriesSchema(values=[Column("v", "float")], granularity="s")
    for name in ("cpu", "disk"):
        s.series.create(name, schema)
    again, missing = code(lambda: s.series.create("cpu", schema)), code(lambda: s.series.drop("zz"))
    s.series.drop("disk")
    return {"names": s.series.names(), "again": again, "missing": missing, "unknown": code(lambda: s.series.range_query("cpu", ["nope"], 0, 9))}


def catalog_graphs(s, _):
    for name in ("g", "h"):
        s.graphs.create(name)
    again, missing = code(lambda: s.graphs.create("g")), code(lambda: s.graphs.drop("zz"))
    s.graphs.drop("h")
    return {"names": s.graphs.names(), "again": again, "missing": missing}


def schema_changes(s, _):
    t = TableSchema([Column("a", "int"), Column("b", "string", max_length=3)], "a")
    t.add(Column("c", "bool"))
    t.update(Column("c", "float", unique=True))
    out = {"again": code(lambda: t.add(Column("c", "bool"))), "missing": code(lambda: t.remove("zz")), "key": code(lambda: t.set_primary_key("zz"))}
    t.remove("a")
    return out | {"names": t.names, "kind": t.get("c").kind, "unique": t.get("c").unique, "primary": t.primary_key}


def document_schema_changes(s, _):
    d = DocumentSchema([Column("a", "int")])
    d.add(Column("a", "string"))
    d.add(Column("b", "int"))
    kind = d.get("a").kind
    d.remove("a")
    return {"kind": kind, "names": sorted(d.fields), "missing": code(lambda: d.get("a")), "remove": code(lambda: d.remove("a"))}


def series_schema_changes(s, _):
    x = SeriesSchema("ts", values=[Column("v", "float")], granularity="ms")
    x.add_tag(Column("host", "string"))
    x.add_value(Column("w", "float"))
    out = {"names": x.table().names, "again": code(lambda: x.add_tag(Column("v", "int"))), "timestamp": code(lambda: x.add_value(Column("ts", "int")))}
    x.remove("v")
    return out | {"after": x.table().names, "missing": code(lambda: x.get("v")), "granularity": code(lambda: SeriesSchema(granularity="week"))}


REFUSED = {
    "where_unknown": "SELECT c_name FROM customer WHERE nope = 1",
    "where_two_columns": "SELECT c_name FROM customer WHERE c_custkey = c_nationkey",
    "where_arithmetic": "SELECT c_name FROM customer WHERE c_custkey + 1 = 2",
    "select_unknown": "SELECT nope FROM customer",
    "text_arithmetic": "SELECT c_name - 1 FROM customer",
    "no_functions": "SELECT UPPER(c_name) FROM customer",
    "unknown_aggregate": "SELECT COUNT(c_custkey) FROM customer",
    "nested_aggregate": "SELECT FIRST(c_custkey) + 1 FROM customer",
    "no_width": "SELECT TIME_BUCKET(c_custkey, 0) FROM customer",
    "set_unknown": "UPDATE customer SET nope = 1",
    "set_kind": "UPDATE customer SET c_custkey = c_custkey / 2",
    "insert_unknown": "INSERT INTO customer (nope) VALUES (1)",
    "insert_kind": "INSERT INTO customer (c_custkey) VALUES (''x'')",
    "no_table": "SELECT * FROM missing",
    "syntax": "SELEC * FROM customer",
}


def refusals(s, sf_dir):
    s.tables.register("customer", table(s, sf_dir, "customer"))
    return {k: code(lambda q=q.replace("''", "'"): s.sql(q)) for k, q in REFUSED.items()}


def insert_rows(spark, sf_dir):
    db = registry.session(spark, sf_dir, "region")
    db.insert("region", [(90, "NINETY"), (91, "x, \"y\"")])
    db.insert("region", [("only a name",)], ["r_name"])
    return db.table("region")


def insert_result(spark, sf_dir):
    db = registry.session(spark, sf_dir, "region")
    made = [db.sql("INSERT INTO region VALUES (90, 'a'), (91, 'b')"), db.sql("UPDATE region SET r_name = 'z' WHERE r_regionkey < 2"), db.sql("DELETE FROM region WHERE r_regionkey >= 90")]
    return made[0].unionByName(made[1]).unionByName(made[2])


def update_status(s, sf_dir):
    s.tables.register("nation", table(s, sf_dir, "nation"))
    good = s.tables.update_status("nation", {"n_name": "x"}, registry.P.cmp("n_nationkey", "<", 3))
    return {"good": good[0], "message": good[1], "unknown": s.tables.update_status("nation", {"nope": 1})[0], "kind": s.tables.update_status("nation", {"n_nationkey": "x"})[0], "changed": s.tables.table("nation").where("n_name = 'x'").count()}


def update_with(spark, sf_dir):
    def change(frame):
        frame["c_acctbal"] = frame["c_acctbal"] * 2 + frame["c_custkey"]
        return frame

    db = registry.session(spark, sf_dir, "customer")
    db.update_with("customer", change, registry.P.negation(registry.P.cmp("c_acctbal", ">=", 0)))
    return db.table("customer").withColumn("c_acctbal", F.round("c_acctbal", 6))


def update_api(spark, sf_dir):
    db = registry.session(spark, sf_dir, "customer")
    db.update("customer", {"c_mktsegment": "NONE", "c_acctbal": 1}, registry.P.cmp("c_acctbal", "<", 0))
    db.delete("customer", registry.P.any_of(registry.P.cmp("c_nationkey", "=", 3), registry.P.cmp("c_nationkey", "=", 7.0)))
    return db.table("customer")


def bulk_series(spark, schema: SeriesSchema, sf_dir) -> TS.TimeSeries:
    out = TS.TimeSeries(spark)
    out.create("events", schema)
    out.append_frame("events", registry.arrivals(spark, sf_dir).withColumnRenamed("ts_s", "timestamp"), "arrival")
    return out


def series_schema(**options) -> SeriesSchema:
    return SeriesSchema(tags=[Column("user_id", "int")], values=[Column("event_id", "int")], granularity="s", **options)


def series_bulk_append(spark, sf_dir):
    return bulk_series(spark, series_schema(ttl_seconds=2_000_000), sf_dir).range_query("events", ["event_id", "user_id"], 0, 4_000_000_000)


def series_bulk_order(spark, sf_dir):
    """Ranges come by partition bucket, then by arrival; ``place`` is a row's place among those of its hour."""
    out = bulk_series(spark, series_schema(), sf_dir).series["events"][2]
    hour = TS.partition_bucket(F.col("timestamp"))
    place = F.row_number().over(Window.partitionBy(hour).orderBy(SEQ))
    return out.select("event_id", hour.alias("hour"), place.cast("long").alias("place"))


def series_pruned(spark, sf_dir):
    path, made, again = scratch(spark, "series"), TS.TimeSeries(spark), TS.TimeSeries(spark)
    made.register("events", series_schema(), registry.events(spark, sf_dir).select(F.col("ts_s").alias("timestamp"), "user_id", "event_id"), "daily")
    made.save("events", path)
    again.load("events", series_schema(), path, "daily")
    return again.range_query("events", ["event_id"], registry.START + 100_000, registry.START + 500_000, registry.P.cmp("user_id", "<", 40))


DOCUMENT = DocumentSchema([Column("user", "int", nullable=False, max_value=100), Column("kind", "string", one_of=("click", "view", "purchase")), Column("value", "float", min_value=1.0)])


def documents_validated(spark, sf_dir):
    return D.document_errors(registry.documents(spark, sf_dir), DOCUMENT).where("error is not null").select("key", "error")


def documents_unique(spark, sf_dir):
    return D.duplicates(registry.documents(spark, sf_dir), "user", "int")


def type_checks(s, sf_dir):
    schema = TableSchema([Column("a", "float"), Column("b", "string"), Column("c", "bool")])
    check = lambda text: code(lambda: V.check_types(schema, schema.names, s.spark.createDataFrame([], text).schema))
    return {"as_declared": check("a double, b string, c boolean"), "int_as_float": check("a long, b string, c boolean"), "text_as_float": check("a string, b string, c boolean"), "int_as_text": check("a double, b int, c boolean"), "int_as_bool": check("a double, b string, c int")}


def graph_not_found(s, sf_dir):
    s.graphs.register("g", registry.nodes(s.spark, sf_dir), registry.edges(s.spark, sf_dir))
    out = {name: code(lambda f=getattr(s.graphs, name): f("g", -5)) for name in ("edges_out", "edges_in", "neighbors_out", "neighbors_in", "node", "edge", "erase_node", "erase_edge")}
    statements = {"verb": "WALK g", "empty": "", "no_graph": "TRAVERSE none FROM 1 BFS", "bad_number": "TRAVERSE g FROM x BFS", "no_order": "TRAVERSE g FROM 1 XFS", "no_where": "MATCH g (a)-[]->(b) RETURN b"}
    return out | {k: code(lambda q=q: s.graph(q)) for k, q in statements.items()}


def graph_edges_in(spark, sf_dir):
    return registry.graphs(spark, sf_dir).edges_in("g", registry.first_node(spark, sf_dir))


def bfs_ranks(spark, sf_dir):
    found = registry.G.breadth_first(registry.edges(spark, sf_dir), registry.first_node(spark, sf_dir))
    return found.select(F.col("id").alias("node_id"), "rank", F.col("parent").alias("parent_id"))


def rows_binary(spark, sf_dir):
    c = registry.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    c = c.select(*[F.col(n).cast(t) for n, t in zip(c.columns, ("long", "string", "double"))])
    return codec.rows_of_bytes(codec.rows_bytes(c), c.schema)


def codecs(s, _):
    table = TableSchema([Column("a", "int", nullable=False, unique=True), Column("b", "string", max_length=9, one_of=("x", "é"))], "a")
    docs = DocumentSchema([Column("k", "float", min_value=1.5)])
    document = {"a": 1, "b": -2.5, "c": "ünï", "d": True, "e": None, "": ""}
    same = lambda a, b: a.columns == b.columns and a.primary_key == b.primary_key
    return {
        "table_json": same(codec.table_schema_from_json(codec.table_schema_to_json(table)), table),
        "table_binary": same(codec.table_schema_from_bytes(codec.table_schema_to_bytes(table)), table),
        "fields_json": codec.document_schema_from_json(codec.document_schema_to_json(docs)).fields == docs.fields,
        "fields_binary": codec.document_schema_from_bytes(codec.document_schema_to_bytes(docs)).fields == docs.fields,
        "document_json": codec.document_from_json(codec.document_to_json(document)) == document,
        "document_binary": codec.document_from_bytes(codec.document_to_bytes(document)) == document,
        "document_form": codec.document_to_json({"a": 1}),
        "value_json": [codec.value_to_json(v) for v in (None, 1, 1.5, "x", False)],
        "bad_magic": code(lambda: codec.document_from_bytes(b"XXXX\1")), "bad_type": code(lambda: codec.value_from_json('{"t":"what","v":1}')),
    }


def through_files(kind):
    def run(spark, sf_dir):
        path, nation = scratch(spark, kind), registry.table(spark, sf_dir, "nation")
        files.write_table(nation, path, kind)
        return files.read_table(spark, path, kind, nation.schema)

    return run


def through_csv(spark, sf_dir):
    path, nation = scratch(spark, "csv"), registry.table(spark, sf_dir, "nation")
    results.write_csv(nation.withColumn("n_name", F.concat("n_name", F.lit(', "quoted"'))), path)
    return files.read_table(spark, path, "csv", nation.schema, header=True, escape='"')


def imported_pairs(spark, sf_dir):
    """Lines of pairs are imported after a put and before another; the latest of each key holds."""
    path = scratch(spark, "pairs")
    c = registry.table(spark, sf_dir, "customer")
    c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(" , "), "c_name", F.lit(", more"))).write.text(path)
    pairs = KeyValues(spark)
    pairs.put("c", "1", "older")
    pairs.load(files.import_pairs(spark, path, "c"))
    pairs.put("c", "2", "newer")
    pairs.delete("c", "3")
    return pairs.scan().select("id", "value")


def exported_pairs(spark, sf_dir):
    path = scratch(spark, "export")
    files.export_pairs(KeyValues(spark, registry.pairs(spark, sf_dir)).scan().select("id", "value"), path)
    return files.read_table(spark, path, "csv", "id string, value string", header=True)


def cursor_facts(s, sf_dir):
    region = table(s, sf_dir, "region").orderBy("r_regionkey")
    c = results.Cursor(region)
    seen = []
    while c.next():
        seen.append(c.int_at("r_regionkey"))
    c.reset()
    c.next()
    return {"rows": seen, "text": c.string_at(1), "float": c.float_at(0), "null": c.is_null(1), "type": [c.type_of(0), c.type_of("r_name")], "wrong": code(lambda: c.bool_at(0)), "unknown": code(lambda: c.at("zz")), "index": results.column_index(region, "r_name")}


def page_facts(s, _):
    return {"pages": [results.total_pages(n, 10) for n in (0, 1, 10, 11, 99)], "none": results.total_pages(5, 0), "bounds": [results.page_bounds(25, 10, k) for k in range(3)], "beyond": code(lambda: results.page_bounds(25, 10, 3)), "negative": code(lambda: results.page_bounds(25, 10, -1))}


def session_facts(s, sf_dir):
    s.tables.register("nation", table(s, sf_dir, "nation"))
    reader = Session(s.spark, "read")
    reader.tables = s.tables
    s.pairs.put("t", "k", "v")
    return {"version": s.version == __version__, "sql": s.sql("SELECT n_name FROM nation WHERE n_nationkey < 3").count(), "read": reader.sql("SELECT n_name FROM nation").count(), "refused": code(lambda: reader.sql("DELETE FROM nation")), "kv": s.kv("SELECT value FROM t WHERE id = 'k'").first().value, "permission": code(lambda: Session(s.spark, "owner"))}


STATEMENTS = ("SELECT a, b + 1 AS c FROM t WHERE NOT (x = 'it' OR y BETWEEN 1 AND 2)", "INSERT INTO t (a) VALUES (1), (-2)", "UPDATE t SET a = b * (c + 2) WHERE a >= 1.5", "DELETE FROM t")


def text_facts(s, _):
    return {"round_trip": all(str(parse(str(parse(q)))) == str(parse(q)) for q in STATEMENTS), "kinds": [type(parse(q)).__name__ for q in STATEMENTS], "select": isinstance(parse(STATEMENTS[0]), ast.Select), "tokens": [t.kind for t in tokenize("SELECT a FROM t WHERE b >= 1.5 ;")], "place": code(lambda: parse("SELECT a\nFROM t WHERE %"))}


def token_facts(s, _):
    secret = b"a secret"
    token = auth.issue("ann", "write", secret)
    claims = auth.verify(token, secret)
    return {"who": claims["sub"], "read": auth.allows(claims, "read"), "write": auth.allows(claims, "write"), "admin": auth.allows(claims, "admin"), "other_secret": code(lambda: auth.verify(token, b"other")), "changed": code(lambda: auth.verify(token + "x", secret)), "role": code(lambda: auth.issue("ann", "owner", secret))}


def service_facts(s, _):
    claims = lambda role: auth.verify(auth.issue("x", role, b"k"), b"k")
    admin, writer, reader = map(claims, ("admin", "write", "read"))
    ask = lambda path, body, who, method="POST": service.answer(s, method, path, json.dumps(body).encode(), who)
    out = {"health": ask("/health", {}, None, "GET")[0], "no_token": ask("/query", {}, None)[0], "no_right": ask("/tables", {"name": "t", "columns": []}, writer)[0], "created": ask("/tables", {"name": "t", "columns": [{"name": "a", "kind": "int"}]}, admin)[0], "no_write": ask("/query", {"query": "INSERT INTO t VALUES (1)"}, reader)[0], "written": ask("/query", {"query": "INSERT INTO t VALUES (1), (2), (3)"}, writer)[0]}
    some = ask("/query", {"query": "SELECT a FROM t", "limit": 2}, reader)[1]
    return out | {"page": [len(some["rows"]), some.get("next")], "rest": len(ask("/query", {"query": "SELECT a FROM t", "limit": 2, "offset": 2}, reader)[1]["rows"]), "too_many": ask("/query", {"query": "SELECT a FROM t", "limit": 10**9}, reader)[0], "missing": ask("/query", {"query": "SELECT a FROM none"}, reader)[0], "nowhere": ask("/nope", {}, reader)[0]}


def shell_facts(s, sf_dir):
    s.tables.register("region", table(s, sf_dir, "region"))
    s.pairs.put("kv", "k", "v")
    out = io.StringIO()
    repl.Shell(s, io.StringIO("SELECT r_regionkey FROM region WHERE r_regionkey = 2\n!1\nSELECT nope FROM region\nget kv k\nhistory\nexit\n"), out).cmdloop()
    text = out.getvalue()
    return {"twice": text.count("r_regionkey\n2\n"), "error": "InvalidArgument" in text, "value": "v\n" in text, "history": "5 history" in text}


def option_facts(s, _):
    made = files.store_options("p", compression="zstd", write_buffer_bytes=1 << 20)
    return {"compression": made["compression"], "group": made["parquet.block.size"], "mode": [files.store_options("p")["mode"], files.store_options("p", create_if_missing=False)["mode"]], "unknown": code(lambda: files.store_options("p", compression="rar")), "negative": code(lambda: files.store_options("p", max_files=-1))}


def stream_appended(spark, sf_dir):
    """The event stream appended to a partitioned table by a streaming query that starts, ends and tells its state."""
    source = f"{sf_dir}/events.parquet"
    path, src = scratch(spark, "stream"), scratch(spark, "source")
    spark.read.parquet(source).select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    query = streams.append_stream(stream, path, path + "-checkpoint", "t")
    query.awaitTermination()
    assert not query.isActive and query.exception() is None
    return spark.read.parquet(path).select("event_id", F.col("bucket").cast("long").alias("bucket"))


def text_matrix(spark, sf_dir):
    return results.text_cells(registry.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"))


E = registry.EVENTS
ARRIVAL = registry.ARRIVAL
NONE, BAD, THERE, FAILED = "NotFound", "InvalidArgument", "AlreadyExists", "FailedPrecondition"


def entries():
    """name: (query, SQL)."""
    return {
        "catalog_tables": (facts(catalog_tables), stated(names=["a", "c"], again=THERE, missing=NONE, rows=0, truncate=NONE)),
        "catalog_collections": (facts(catalog_collections), stated(names=["docs", "implicit"], again=THERE, missing=NONE, count=1)),
        "catalog_series": (facts(catalog_series), stated(names=["cpu"], again=THERE, missing=NONE, unknown=BAD)),
        "catalog_graphs": (facts(catalog_graphs), stated(names=["g"], again=THERE, missing=NONE)),
        "schema_table": (facts(schema_changes), stated(again=THERE, missing=NONE, key=BAD, names=["b", "c"], kind="float", unique=True, primary=None)),
        "schema_document": (facts(document_schema_changes), stated(kind="string", names=["b"], missing=NONE, remove=NONE)),
        "schema_series": (facts(series_schema_changes), stated(names=["ts", "host", "v", "w"], again=THERE, timestamp=THERE, after=["ts", "host", "w"], missing=NONE, granularity=BAD)),
        "sql_refusals": (facts(refusals), stated(**{k: BAD for k in REFUSED} | {"no_table": NONE, "syntax": "ParseError"})),
        "api_insert": (insert_rows, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NINETY' UNION ALL SELECT 91, 'x, \"y\"' UNION ALL SELECT NULL, 'only a name'"),
        "dml_results": (insert_result, "SELECT 2::BIGINT AS affected, 'inserted' AS operation UNION ALL SELECT count(*), 'updated' FROM region WHERE r_regionkey < 2 UNION ALL SELECT 2, 'deleted'"),
        "api_update_status": (facts(update_status), stated(good="OK", message="", unknown=BAD, kind=BAD, changed=3)),
        "api_update_with": (update_with, "SELECT " + registry.CUSTOMER.format(bal="round(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE c_acctbal * 2 + c_custkey END, 6)", seg="c_mktsegment")),
        "api_update_delete": (update_api, "SELECT " + registry.CUSTOMER.format(bal="CASE WHEN c_acctbal < 0 THEN 1 ELSE c_acctbal END", seg="CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END") + " WHERE c_nationkey NOT IN (3, 7)"),
        "ts_bulk_append": (series_bulk_append, f"SELECT event_id, user_id FROM (SELECT event_id, user_id, ts_s, max(ts_s) OVER (ORDER BY {ARRIVAL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM {E}) WHERE ts_s >= m - 2000000"),
        "ts_bulk_order": (series_bulk_order, f"SELECT event_id, ts_s // 3600 * 3600 AS hour, row_number() OVER (PARTITION BY ts_s // 3600 ORDER BY {ARRIVAL}) AS place FROM {E}"),
        "ts_range_pruned": (series_pruned, f"SELECT event_id FROM {E} WHERE ts_s >= {registry.START + 100_000} AND ts_s < {registry.START + 500_000} AND user_id < 40"),
        "validate_documents": (documents_validated, "SELECT event_id::VARCHAR AS key, CASE WHEN user_id > 100 THEN 'user is out of range' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'kind breaks its constraints' WHEN event_id % 7 <> 0 AND event_id % 11 = 0 THEN 'value is float, not string' WHEN event_id % 7 <> 0 AND value < 1 THEN 'value is out of range' END AS error FROM events WHERE error IS NOT NULL"),
        "validate_unique_documents": (documents_unique, "SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 1"),
        "validate_types": (facts(type_checks), stated(as_declared="OK", int_as_float="OK", text_as_float=BAD, int_as_text=BAD, int_as_bool=BAD)),
        "graph_not_found": (facts(graph_not_found), stated(**{k: NONE for k in ("edges_out", "edges_in", "neighbors_out", "neighbors_in", "node", "edge", "erase_node", "erase_edge", "no_graph")} | {k: BAD for k in ("verb", "empty", "bad_number", "no_order", "no_where")})),
        "graph_edges_in": (graph_edges_in, f"SELECT id FROM {registry.EDGES} WHERE dst = (SELECT src FROM {registry.EDGES} ORDER BY seq LIMIT 1)"),
        "graph_bfs_ranks": (bfs_ranks, f"{registry.QUEUE} SELECT n AS node_id, row_number() OVER (ORDER BY lev, k, s) - 1 AS rank, p AS parent_id FROM q"),
        "codec_rows_binary": (rows_binary, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
        "codec_round_trips": (facts(codecs), stated(**{k: True for k in ("table_json", "table_binary", "fields_json", "fields_binary", "document_json", "document_binary")}, document_form='{"fields":{"a":{"t":"int","v":1}},"version":1}', value_json=['{"t":"null","v":null}', '{"t":"int","v":1}', '{"t":"float","v":1.5}', '{"t":"string","v":"x"}', '{"t":"bool","v":false}'], bad_magic=BAD, bad_type=BAD)),
        "file_parquet": (through_files("parquet"), "SELECT * FROM nation"),
        "file_json": (through_files("json"), "SELECT * FROM nation"),
        "file_orc": (through_files("orc"), "SELECT * FROM nation"),
        "file_csv": (through_csv, "SELECT n_nationkey, n_name || ', \"quoted\"' AS n_name, n_regionkey FROM nation"),
        "kv_import": (imported_pairs, "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey = 2 THEN 'newer' ELSE c_name || ', more' END AS value FROM customer WHERE c_custkey <> 3 UNION ALL SELECT '1', 'older' WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1) UNION ALL SELECT '2', 'newer' WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 2)"),
        "kv_export": (exported_pairs, "SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS value FROM events GROUP BY 1"),
        "result_cursor": (facts(cursor_facts), stated(rows=[0, 1, 2, 3, 4], text="AFRICA", float=0.0, null=False, type=["Integer", "String"], wrong=BAD, unknown=NONE, index=1)),
        "result_pages": (facts(page_facts), stated(pages=[0, 1, 1, 2, 10], none=0, bounds=[[0, 10], [10, 20], [20, 25]], beyond="OutOfRange", negative="OutOfRange")),
        "result_text_matrix": (text_matrix, "SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END AS s_acctbal FROM supplier"),
        "session_verbs": (facts(session_facts), stated(version=True, sql=3, read=25, refused=BAD, kv="v", permission=BAD)),
        "statement_texts": (facts(text_facts), stated(round_trip=True, kinds=["Select", "Insert", "Update", "Delete"], select=True, tokens=["keyword", "name", "keyword", "name", "keyword", "name", "op", "number", "op", "end"], place="ParseError")),
        "signed_tokens": (facts(token_facts), stated(who="ann", read=True, write=True, admin=False, other_secret=BAD, changed=BAD, role=BAD)),
        "service_answers": (facts(service_facts), stated(health=200, no_token=401, no_right=403, created=201, no_write=403, written=200, page=[2, 2], rest=1, too_many=400, missing=404, nowhere=404)),
        "shell_lines": (facts(shell_facts), stated(twice=2, error=True, value=True, history=True)),
        "store_options": (facts(option_facts), stated(compression="zstd", group="1048576", mode=["append", "errorifexists"], unknown=BAD, negative=BAD)),
        "stream_append": (stream_appended, f"SELECT event_id, ts_s // 3600 * 3600 AS bucket FROM {E}"),
    }
