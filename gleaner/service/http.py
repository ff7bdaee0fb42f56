"""A small HTTP front: GET /health /stats /metrics, POST /query /ingest. One driver process; Spark does the work."""

from __future__ import annotations

import hmac
import json
import os
import threading
import time
from collections.abc import Callable
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from gleaner.pipeline import Engine
from gleaner.service.trace import Trace, Tracer
from gleaner.streaming.ratelimit import BURST, RATE, refill

MAX_BODY = 1 << 20
MAX_CLIENTS = 50_000
PATHS = ("/health", "/stats", "/metrics", "/query", "/ingest")


class Api:
    """Requests to (status, body); apart from the server, so it can be called by itself."""

    def __init__(self, engine: Engine, ingest_root: str | None = None, key: str | None = None, tracer: Tracer | None = None, index: str | None = None):
        self.engine, self.root, self.key, self.tracer, self.index = engine, ingest_root, key, tracer or Tracer(), index
        self.buckets: dict[str, tuple[float, float]] = {}
        self.writing = threading.Lock()

    def admitted(self, client: str, now: float | None = None) -> bool:
        now = time.monotonic() if now is None else now
        tokens, last = self.buckets.get(client, (BURST, now))
        tokens = refill(tokens, now - last, RATE, BURST)
        ok = tokens >= 1
        if len(self.buckets) >= MAX_CLIENTS:
            self.buckets = {c: b for c, b in self.buckets.items() if now - b[1] < BURST / RATE}
        self.buckets[client] = (tokens - ok, now)
        return ok

    def allowed_path(self, path: str) -> str | None:
        """The real path, if it lies inside the folder that may be read."""
        if not self.root:
            return None
        real, root = os.path.realpath(os.path.join(self.root, path)), os.path.realpath(self.root)
        return real if real == root or real.startswith(root + os.sep) else None

    def handle(self, method: str, target: str, body: bytes = b"", token: str | None = None, client: str = "") -> tuple[int, object]:
        """The status and body of one request, counted."""
        status, out = self._handle(method, target, body, token, client)
        path = urlsplit(target).path
        self.tracer.count(path if path in PATHS else "other", status)
        return status, out

    def _handle(self, method: str, target: str, body: bytes, token: str | None, client: str) -> tuple[int, object]:
        """``token`` is what the header bears; only without one the query's ``api_key`` counts."""
        url = urlsplit(target)
        path = url.path
        if path == "/health":
            if method != "GET":
                return 405, {"error": "GET only"}
            state = self.engine.ready()
            return (200 if state["status"] == "ok" else 503), state
        if token is None:
            token = parse_qs(url.query).get("api_key", [None])[0]
        if self.key and not hmac.compare_digest((token or "").encode(), self.key.encode()):
            return 401, {"error": "wrong or missing key"}
        if path in ("/stats", "/metrics"):
            if method != "GET":
                return 405, {"error": "GET only"}
            return 200, self.engine.stats() if path == "/stats" else self.tracer.metrics(self.engine.stats())
        if path not in ("/query", "/ingest"):
            return 404, {"error": "no such path"}
        if method != "POST":
            return 405, {"error": "POST only"}
        if not self.admitted(client):
            return 429, {"error": "too many requests"}
        if len(body) > MAX_BODY:
            return 413, {"error": "the body is too large"}
        try:
            request = json.loads(body or b"{}")
            if not isinstance(request, dict):
                raise ValueError("the body must be an object")
            return 200, self._query(request) if path == "/query" else self._ingest(request)
        except ValueError as e:
            return 400, {"error": str(e)}
        except FileNotFoundError as e:
            return 404, {"error": str(e)}

    def _query(self, request: dict) -> dict:
        question, filters = request.get("question"), request.get("filters")
        if not isinstance(question, str):
            raise ValueError("a question is needed")
        if filters is not None and not isinstance(filters, dict):
            raise ValueError("filters must be an object")
        top_k = request.get("top_k")
        if top_k is not None and (not isinstance(top_k, int) or isinstance(top_k, bool) or top_k <= 0):
            raise ValueError("top_k must be a positive number")
        trace = Trace(question)
        try:
            with trace.span("filters"):
                self.engine.check_filters(filters)
            with trace.span("answer"):
                row = self.engine.answer(self.engine.questions([question]), filters, top_k).first().asDict(recursive=True)
            trace.meta |= {"hits": len(row["citations"] or []), "confident": row["confident"]}
        finally:
            self.tracer.emit(trace)
        told = trace.to_dict()
        return {
            "query": question, "answer": row["answer"], "confident": row["confident"], "citations": row["citations"] or [], "trace_id": trace.trace_id, "total_ms": told["total_ms"],
            "stage_ms": {s["name"]: s["ms"] for s in told["spans"]}, "hit_count": len(row["citations"] or []), "meta": {"filters": filters or {}, "top_k": top_k or self.engine.retrieval.top_k},
        }

    def _ingest(self, request: dict) -> dict:
        path = self.allowed_path(str(request.get("path", "")))
        if path is None:
            raise ValueError("the path lies outside of the folder that may be read")
        with self.writing:
            counts = self.engine.index_path(path, bool(request.get("recursive", True)))
            if self.index:
                self.engine.save(self.index)
        return counts | self.engine.stats()


def _sent(out: object) -> tuple[bytes, str]:
    if isinstance(out, str):
        return out.encode(), "text/plain"
    return json.dumps(out, ensure_ascii=False, default=str).encode(), "application/json"


def wsgi(api: Api) -> Callable:
    """The same as an application for WSGI servers."""

    def app(environ: dict, start_response: Callable) -> list[bytes]:
        n = int(environ.get("CONTENT_LENGTH") or 0)
        body = environ["wsgi.input"].read(min(n, MAX_BODY + 1)) if n else b""
        token = environ.get("HTTP_AUTHORIZATION", "").removeprefix("Bearer ").strip() or None
        target = environ.get("PATH_INFO", "/") + (f"?{q}" if (q := environ.get("QUERY_STRING")) else "")
        status, out = api.handle(environ["REQUEST_METHOD"], target, body, token, environ.get("REMOTE_ADDR", ""))
        raw, kind = _sent(out)
        start_response(f"{status} {HTTPStatus(status).phrase}", [("Content-Type", kind), ("Content-Length", str(len(raw)))])
        return [raw]

    return app


def serve(engine: Engine, host: str, port: int, ingest_root: str | None, key: str | None, index: str | None = None) -> None:
    """Serves until it is stopped; what is ingested is saved to ``index``."""
    api = Api(engine, ingest_root, key, index=index)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(n, MAX_BODY + 1))
            token = (self.headers.get("Authorization") or "").removeprefix("Bearer ").strip() or None
            status, out = api.handle(self.command, self.path, body, token, self.client_address[0])
            raw, kind = _sent(out)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _do

    ThreadingHTTPServer((host, port), Handler).serve_forever()
