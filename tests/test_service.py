import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from pyspark.sql import functions as F

from tessella import auth, repl, service
from tessella.errors import InvalidArgument
from tessella.operators import document
from tessella.session import Session

SECRET = b"a secret"


def test_tokens():
    token = auth.issue("ann", "write", SECRET)
    claims = auth.verify(token, SECRET)
    assert claims["sub"] == "ann" and auth.allows(claims, "read") and not auth.allows(claims, "admin")
    for bad in (token + "x", token.replace(".", ""), "", "a.b.c"):
        with pytest.raises(InvalidArgument):
            auth.verify(bad, SECRET)
    with pytest.raises(InvalidArgument):
        auth.verify(token, b"other")
    with pytest.raises(InvalidArgument):
        auth.issue("ann", "owner", SECRET)


def test_service(spark):
    web = service.server(Session(spark), SECRET)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def ask(path, body=None, role=None):
        head = {"Authorization": "Bearer " + auth.issue("x", role, SECRET)} if role else {}
        request = urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", json.dumps(body).encode() if body is not None else None, head)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health")[0] == 200 and ask("/query", {"query": "SELECT * FROM t"})[0] == 401
        assert ask("/tables", {"name": "t", "columns": [{"name": "a", "kind": "int"}]}, "write")[0] == 403
        assert ask("/tables", {"name": "t", "columns": [{"name": "a", "kind": "int"}]}, "admin")[0] == 201
        assert ask("/query", {"query": "INSERT INTO t VALUES (1), (2)"}, "read")[0] == 403
        assert ask("/query", {"query": "INSERT INTO t VALUES (1), (2)"}, "write")[1]["rows"] == [{"affected": 2, "operation": "inserted"}]
        assert ask("/query", {"query": "SELECT a + 1 AS b FROM t WHERE a = 2"}, "read")[1] == {"columns": ["b"], "types": ["Integer"], "rows": [{"b": 3}]}
        assert ask("/query", {"query": "SELECT x FROM none"}, "read")[0] == 404 and ask("/query", {"query": "SELEC"}, "admin")[0] == 400 and ask("/nope", {}, "read")[0] == 404
    finally:
        web.shutdown()


def test_shell(spark, tmp_path):
    s = Session(spark)
    s.tables.register("t", spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string"))
    (tmp_path / "in.txt").write_text("k,v\n")
    out = io.StringIO()
    lines = f"SELECT a FROM t WHERE b = 'y'\n!1\nSELECT nope FROM t\nimport kv {tmp_path}/in.txt\nget kv k\nexport {tmp_path}/out SELECT * FROM t\nhistory\nexit\n"
    repl.Shell(s, io.StringIO(lines), out).cmdloop()
    text = out.getvalue()
    assert text.count("a\n2\n") == 2 and "InvalidArgument" in text and "1 imported" in text and "v\n" in text and "7 history" in text
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2


def test_document_duplicates(spark):
    docs = spark.createDataFrame([("1", '{"a":1}'), ("2", '{"a":1}'), ("3", "{}"), ("4", "{}")], "key string, j string").select("key", F.parse_json("j").alias("doc"))
    assert [tuple(r) for r in document.duplicates(docs, "a", "int").collect()] == [("1", 2)]
    assert document.duplicates(docs, "a", "int", ignore_nulls=False).count() == 2
