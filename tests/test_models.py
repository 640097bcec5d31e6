import random
from collections import deque

import pytest

from pyspark.sql import functions as F

from tessella.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, OutOfRange
from tessella.operators import graph as G
from tessella.operators import predicate as P
from tessella.operators import timeseries as TS
from tessella.schema import Column, DocumentSchema, SeriesSchema
from tessella.session import Session
from tessella.sources import codec, files, results


def rows(df):
    return [tuple(r) for r in df.collect()]


# documents


def test_documents(spark):
    s = Session(spark).documents
    s.create("people", DocumentSchema([Column("id", "int", nullable=False, unique=True), Column("name", "string", nullable=False), Column("age", "int")]))
    s.put("people", "1", {"id": 1, "name": "Ada", "age": 36, "extra": "x"})
    s.put("people", "2", {"id": 2, "name": "Grace"})
    assert [r.key for r in s.query("people", where=P.cmp("age", ">", 35)).collect()] == ["1"]
    assert sorted(r.key for r in s.query("people", where=P.negation(P.cmp("age", ">", 35))).collect()) == ["2"]
    for bad, error in [({"id": 1, "name": "x"}, FailedPrecondition), ({"name": "x"}, InvalidArgument), ({"id": "x", "name": "x"}, InvalidArgument)]:
        with pytest.raises(error):
            s.put("people", "3", bad)
    with pytest.raises(InvalidArgument):
        s.query("people", where=P.cmp("zzz", "=", 1))
    with pytest.raises(InvalidArgument):
        s.query("people", fields=["zzz"])
    s.put("people", "1", {"id": 1, "name": "Ada L"})
    assert s.get("people", "1") == {"id": 1, "name": "Ada L"} and s.count("people") == 2
    s.erase("people", "1")
    with pytest.raises(NotFound):
        s.get("people", "1")
    with pytest.raises(AlreadyExists):
        s.create("people")
    s.put("lazy", "k", {"n": 1.5, "b": True, "s": "t"})
    assert s.names() == ["lazy", "people"]
    got = s.query("lazy", ["b", "nope"]).select(F.to_json("doc").alias("j")).collect()
    assert got[0].j == '{"b":true}'
    s.drop("lazy")
    with pytest.raises(NotFound):
        s.count("lazy")


def test_document_kinds(spark):
    s = Session(spark).documents
    values = {"i": 5, "f": 5.0, "g": 1.5, "s": "5", "t": "b", "b": True, "n": None}
    for k, v in values.items():
        s.put("c", k, {"v": v})
    find = lambda op, v: sorted(r.key for r in s.query("c", where=P.cmp("v", op, v)).collect())
    assert find("=", 5) == ["f", "i"] and find("<", 5) == ["g"] and find(">", 5) == ["b", "s", "t"]
    assert find("<=", "5") == ["f", "g", "i", "s"] and find("=", True) == ["b"] and find("!=", "b") == ["b", "f", "g", "i", "s"]


# series


def test_series(spark):
    s = Session(spark).series
    s.create("cpu", SeriesSchema(tags=[Column("sensor", "int", nullable=False)], values=[Column("value", "int", nullable=False)], granularity="s"))
    s.append("cpu", [(100, 1, 10), (105, 1, 20), (110, 2, 30)])
    assert s.range_query("cpu", None, 100, 110).count() == 2
    assert rows(s.range_query("cpu", ["value"], 100, 200, P.cmp("sensor", "=", 1))) == [(10,), (20,)]
    assert rows(s.aggregate("cpu", "value", "sum", 100, 200, 10)) == [(100, 30.0), (110, 30.0)]
    for bad in (lambda: s.range_query("cpu", None, 5, 4), lambda: s.aggregate("cpu", "value", "sum", 0, 9, 0), lambda: s.append("cpu", [("x", 1, 1)]), lambda: s.aggregate("cpu", "nope", "sum", 0, 9, 1), lambda: s.append("cpu", [(1, None, 1)])):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(FailedPrecondition):
        s.append("cpu", [(1,)])
    s.create("mem", SeriesSchema(values=[Column("value", "int")], granularity="s", ttl_seconds=10))
    s.append("mem", [(0, 1), (5, 2), (20, 3)])
    assert rows(s.range_query("mem", ["timestamp"], 0, 99)) == [(20,)]
    s.create("disk", SeriesSchema(values=[Column("value", "int")], granularity="s", max_rows=2), "daily")
    s.append("disk", [(1, 1), (2, 2), (3, 3)])
    assert rows(s.range_query("disk", ["timestamp"], 0, 99)) == [(2,), (3,)]
    assert s.names() == ["cpu", "disk", "mem"]
    s.drop("disk")
    with pytest.raises(NotFound):
        s.range_query("disk", None, 0, 1)


def test_aggregate_null_negative_and_granularity(spark):
    df = spark.createDataFrame([(-15, 1.0), (-5, None), (5, 3.0), (7, float("inf"))], "ts long, v double")
    get = lambda what, **k: rows(TS.aggregate(df, "ts", "v", what, -20, 20, 10, **k))
    assert get("count") == [(-20, 1), (-10, 1), (0, 2)]
    assert get("avg")[:2] == [(-20, 1.0), (-10, 0.0)] and get("max") == [(-20, 1.0), (-10, 0.0), (0, 3.0)]
    ms = spark.createDataFrame([(1500, 1.0), (1999, 2.0), (2000, 4.0)], "ts long, v double")
    assert rows(TS.aggregate(ms, "ts", "v", "sum", 1200, 3000, 250, "ms")) == [(1, 3.0), (2, 4.0)]
    assert [TS.whole_seconds(-1500, "ms"), TS.whole_seconds(2, "h"), TS.width_seconds(3, "ns")] == [-1, 7200, 1]


def model_retention(arrivals, ttl, max_rows, size=3600):
    kept = []
    for seq, t in arrivals:
        kept.append((seq, t))
        if ttl:
            kept = [r for r in kept if r[1] >= t - ttl]
        while max_rows and len(kept) > max_rows:
            oldest = min(r[1] // size for r in kept)
            kept.remove(next(r for r in kept if r[1] // size == oldest))
    return {s for s, _ in kept}


@pytest.mark.parametrize("ttl, most", [(5000, 0), (0, 17), (9000, 17), (60_000, 5)])
def test_retention_against_model(spark, ttl, most):
    r = random.Random(ttl + most)
    arrivals = [(i * 3, 40_000 + i * 60 + r.randrange(-8000, 8000)) for i in range(150)]
    df = spark.createDataFrame([(s, t, 1) for s, t in arrivals], "seq long, t long, g int").repartition(3)
    if ttl and most:
        got = TS.retain_both(df, F.col("t"), "seq", ttl, most, ["g"])
    elif ttl:
        got = TS.retain_ttl(df, F.col("t"), "seq", ttl, spans=7)
    else:
        got = TS.retain_max_rows(df, F.col("t"), "seq", most)
    assert {x.seq for x in got.collect()} == model_retention(arrivals, ttl, most)


# graphs


@pytest.fixture
def g(spark):
    s = Session(spark)
    s.graphs.create("g")
    for n in (1, 2, 3, 4, 9):
        s.graphs.put_node("g", n, ["L"], {"k": "v"})
    for e in [(10, 1, 2, "KNOWS"), (11, 2, 3, "KNOWS"), (12, 3, 4, "LIKES"), (13, 4, 2, "KNOWS"), (14, 3, 3, "SELF")]:
        s.graphs.put_edge("g", *e)
    return s


def test_graph_language(g):
    assert rows(g.graph("TRAVERSE g FROM 1 BFS")) == [(1,), (2,), (3,), (4,)]
    assert rows(g.graph("traverse g from 1 dfs LIMIT 2")) == [(1,), (2,)]
    assert rows(g.graph("TRAVERSE g FROM 1 BFS LIMIT 0")) == [(1,), (2,), (3,), (4,)]
    assert rows(g.graph("TRAVERSE g FROM 9 DFS")) == [(9,)]
    assert rows(g.graph("MATCH g (a)-[:knows]->(b) WHERE a = 2 RETURN b")) == [(3,)]
    assert rows(g.graph("MATCH g (a)-[]->(b) WHERE a = 3 RETURN b")) == [(4,), (3,)]
    assert rows(g.graph("SHORTEST_PATH g FROM 1 TO 4;")) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(g.graph("SHORTEST_PATH g FROM 1 TO 9")) == [] and rows(g.graph("SHORTEST_PATH none FROM 5 TO 5")) == [(0, 5)]
    assert rows(g.graph("CONNECTED g FROM 1 TO 4")) == [(True,)] and rows(g.graph("CONNECTED g FROM 4 TO 1")) == [(False,)]
    for bad in ("WALK g", "", "TRAVERSE g FROM x BFS", "TRAVERSE g FROM 1 XFS", "TRAVERSE g FROM 1 BFS LIMIT -1", "MATCH g (a)->(b) RETURN b"):
        with pytest.raises(InvalidArgument):
            g.graph(bad)
    for missing in ("TRAVERSE h FROM 1 BFS", "TRAVERSE g FROM 77 BFS"):
        with pytest.raises(NotFound):
            g.graph(missing)


def test_graph_changes(g):
    edges = lambda: g.graphs.get("g")[1]
    assert rows(G.edges_in(edges(), 2)) == [(10,), (13,)] and rows(G.neighbors_in(edges(), 3)) == [(2,), (3,)]
    g.graphs.put_edge("g", 10, 1, 2, "KNOWS")  # moves to the end
    assert rows(G.edges_in(edges(), 2)) == [(13,), (10,)]
    with pytest.raises(InvalidArgument):
        g.graphs.put_edge("g", 99, 1, 77)
    assert g.graphs.node("g", 1).labels == ["L"] and g.graphs.edge("g", 12).type == "LIKES"
    g.graphs.erase_edge("g", 12)
    g.graphs.erase_node("g", 3)
    assert sorted(r[0] for r in rows(edges().select("id"))) == [10, 13]
    for missing in (lambda: g.graphs.node("g", 3), lambda: g.graphs.edge("g", 12), lambda: g.graphs.erase_node("g", 3)):
        with pytest.raises(NotFound):
            missing()


def test_orders_against_model(spark):
    r = random.Random(4)
    links = [(k, r.randrange(12), r.randrange(12)) for k in range(30)]
    ahead = {}
    for _, a, b in links:
        ahead.setdefault(a, []).append(b)
    bfs, seen, queue = [], {0}, deque([0])
    while queue:
        n = queue.popleft()
        bfs.append(n)
        for m in ahead.get(n, ()):
            if m not in seen:
                seen.add(m)
                queue.append(m)
    dfs = []

    def walk(n):
        if n not in dfs:
            dfs.append(n)
            for m in ahead.get(n, ()):
                walk(m)

    walk(0)
    edges = spark.createDataFrame([(k, a, b, "T", [], {}, k) for k, a, b in links], G.EDGE).repartition(3)
    assert [x.id for x in G.breadth_first(edges, 0).orderBy("rank").collect()] == bfs
    assert [x.node_id for x in G.depth_first(edges, 0).collect()] == dfs


# pairs, results, codecs


def test_pairs(spark, tmp_path):
    s = Session(spark)
    s.kv("INSERT INTO t (id, value) VALUES ('a', 'x, y')")
    s.kv("insert into t (key, data) values (b, two);")
    s.kv("INSERT INTO t (id, value) VALUES ('a', 'again')")
    assert rows(s.kv("SELECT anything FROM t WHERE id = 'a'")) == [("a", "again")]
    assert rows(s.kv("SELECT * FROM t WHERE key = nope")) == []
    s.pairs.delete("t", "b")
    with pytest.raises(NotFound):
        s.pairs.get("t", "b")
    assert s.pairs.get("t", "a") == "again" and s.pairs.scan().count() == 1
    for bad in ("SELECT * FROM t WHERE other = 1", "SELECT * FROM t WHERE id > 1", "INSERT INTO t (id, x) VALUES (1, 2)"):
        with pytest.raises(InvalidArgument):
            s.kv(bad)
    (tmp_path / "p.txt").write_text("k1,v1,more\nk2, v2\nbroken\n")
    assert sorted(rows(files.import_pairs(spark, str(tmp_path / "p.txt"), "t").select("id", "value"))) == [("k1", "v1,more"), ("k2", "v2")]


def test_results(spark):
    df = spark.createDataFrame([(1, "alice", True, 1.5), (2, 'bob, the "builder"', False, None)], "id long, name string, active boolean, x double")
    assert results.to_csv(df) == 'id,name,active,x\n1,alice,true,1.5\n2,"bob, the ""builder""",false,\n'
    assert results.to_csv(df.limit(1), ";", False, True, "'") == "'1';'alice';'true';'1.5'\n"
    assert results.to_json(df.limit(1)) == '[{"id":1,"name":"alice","active":true,"x":1.5}]'
    assert results.to_json(df.limit(0), metadata=True) == '{"columns":["id","name","active","x"],"types":["Integer","String","Boolean","Float"],"rows":[]}'
    assert results.total_pages(2, 1) == 2 and results.page_bounds(5, 2, 2) == (4, 5)
    assert [r.id for r in results.page(df, ["id"], 1, 1).collect()] == [2]
    with pytest.raises(OutOfRange):
        results.page_bounds(5, 2, 3)
    cursor = results.Cursor(df.orderBy("id"))
    assert cursor.next() and cursor.at("name") == "alice" and cursor.at(0) == 1 and cursor.next() and not cursor.next()
    with pytest.raises(NotFound):
        results.column_index(df, "zz")


def test_codecs(spark):
    values = [None, 5, -2.5, 'q"\n', True, False, 1 << 62]
    assert codec.row_from_bytes(codec.row_to_bytes(values)) == values
    assert codec.row_from_json(codec.row_to_json(values)) == values
    assert [codec.value_from_json(codec.value_to_json(v)) for v in values] == values
    assert codec.value_to_json(1) == '{"t":"int","v":1}'
    df = spark.createDataFrame([(1, 'a"b', None)], "i long, s string, x double")
    assert [codec.row_from_json(r.json) for r in codec.rows_json(df).collect()] == [[1, 'a"b', None]]
    assert [codec.row_from_bytes(bytes(r.row)) for r in codec.rows_bytes(df).collect()] == [[1, 'a"b', None]]
    assert codec.schema_from_json(codec.schema_to_json(df.schema)) == df.schema
    for bad in ('{"t":"what","v":1}', '{"t":"int","v":"x"}'):
        with pytest.raises(InvalidArgument):
            codec.value_from_json(bad)


def test_streams(spark, tmp_path):
    from tessella.streaming import series

    src = str(tmp_path / "src")
    spark.createDataFrame([(i, 1_700_000_000 + i * 600, i % 2) for i in range(12)], "seq long, t long, k long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("seq long, t long, k long").parquet(src)
    q = series.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "t")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    timed = stream.withColumn("ts", F.timestamp_seconds("t"))
    q = series.bucket_stream(timed, "ts", "seq", "1 hour", "1 hour", ("k",)).writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("buckets").agg(F.sum("n")).first()[0] == 12
    q = series.retained_stream(stream, "k", "seq", "t", 2400, 2).writeStream.outputMode("append").format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("kept").collect()) == [8, 9, 10, 11]
