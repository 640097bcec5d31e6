"""A thin HTTP layer over a session: GET /health, POST /query, POST /tables.

Requests carry a token as ``Authorization: Bearer``; a query needs read or, if
it changes something, write; a table needs admin.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tessella import auth
from tessella.errors import EngineError, InvalidArgument
from tessella.schema import Column, TableSchema
from tessella.sources import results

#: Rows of one answer; ``next`` in it is the offset of those that follow.
MOST_ROWS = 10_000
STATUS = {"NotFound": 404, "AlreadyExists": 409, "InvalidArgument": 400, "ParseError": 400, "FailedPrecondition": 412}


def answer(session, method: str, path: str, body: bytes, claims: dict | None) -> tuple[int, object]:
    """(status, JSON value) of a request; ``claims`` is None without a valid token."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "version": session.version}
    if claims is None:
        return 401, {"error": "a token is needed"}
    try:
        got = json.loads(body or b"{}")
        if (method, path) == ("POST", "/query"):
            text = str(got.get("query", ""))
            if not auth.allows(claims, "read" if text.lstrip().upper().startswith("SELECT") else "write"):
                return 403, {"error": "not allowed"}
            limit, offset = int(got.get("limit", MOST_ROWS)), int(got.get("offset", 0))
            if not 0 <= limit <= MOST_ROWS or offset < 0:
                raise InvalidArgument(f"limit is 0 to {MOST_ROWS}, offset 0 or more")
            out = json.loads(results.to_json(session.sql(text).offset(offset).limit(limit + 1), metadata=True))
            if len(out["rows"]) > limit:  # there are more than asked for
                out |= {"rows": out["rows"][:limit], "next": offset + limit}
            return 200, out
        if (method, path) == ("POST", "/tables"):
            if not auth.allows(claims, "admin"):
                return 403, {"error": "not allowed"}
            session.tables.create(got["name"], TableSchema([Column(**c) for c in got["columns"]]))
            return 201, {"created": got["name"]}
    except EngineError as e:
        return STATUS.get(e.code, 500), {"error": str(e), "code": e.code}
    except (ValueError, KeyError, TypeError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such path"}


def server(session, secret: bytes, port: int = 0) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _serve(self, method):
            try:
                claims = auth.verify(self.headers.get("Authorization", "").removeprefix("Bearer "), secret)
            except InvalidArgument:
                claims = None
            status, value = answer(session, method, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)), claims)
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._serve("GET")

        def do_POST(self):
            self._serve("POST")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
