import json

import pytest

from gleaner.functions.retries import with_retries
from gleaner.service import llm
from gleaner.service.http import Api
from gleaner.service.trace import Trace, Tracer


class Fake:
    name = "fake"

    def __init__(self, fail=0, status=None):
        self.calls, self.fail, self.status = 0, fail, status

    def complete(self, messages, **options):
        self.calls += 1
        if self.calls <= self.fail:
            e = RuntimeError("no")
            e.status_code = self.status
            raise e
        return f"answer {self.calls} to {messages[-1]['content']}"


def test_cache_and_retries():
    c = llm.CachedClient(Fake(), entries=5)
    first = c.complete([{"role": "user", "content": "q"}])
    assert c.complete([{"role": "user", "content": "q"}]) == first and c.stats() == {"entries": 1, "hits": 1}
    for i in range(25):
        c.complete([{"role": "user", "content": str(i)}])
    assert c.stats()["entries"] == 5 and c.complete([{"role": "user", "content": "q"}]) == first
    assert "".join(c.stream([{"role": "user", "content": "q"}])) == first
    slept = []
    again = Fake(2, 503)
    assert with_retries(lambda: again.complete([{"content": "x"}]), sleep=slept.append) == "answer 3 to x" and slept == [0.5, 1.0]
    with pytest.raises(RuntimeError):
        with_retries(lambda: Fake(1, 400).complete([]), sleep=slept.append)
    assert llm.base_url(" http://h/ ") == "http://h/v1" == llm.base_url("http://h/v1/")


def test_lru():
    c = llm.LRU(2)
    for k in "abca":
        c.get_or_compute(k, lambda k=k: k)
    assert list(c.data) == ["c", "a"] and c.hit_rate == 0.0 and c.get("c") == "c" and c.hit_rate == 0.2


def test_trace(tmp_path):
    t = Tracer(str(tmp_path / "t.jsonl"))
    x = Trace("q")
    with x.span("a", n=1):
        pass
    t.emit(x)
    assert json.loads((tmp_path / "t.jsonl").read_text())["spans"][0]["name"] == "a" and "gleaner_queries_total 1" in t.metrics({"chunks": 3})
    Tracer(str(tmp_path)).emit(x)  # a folder can't be written: swallowed


def test_durable_cache_and_factory(tmp_path):
    path = str(tmp_path / "answers.db")
    ask = [{"role": "user", "content": "q"}]
    first = llm.CachedClient(Fake(), path=path).complete(ask)
    again = llm.CachedClient(Fake(9), path=path)
    assert again.complete(ask) == first and again.stats() == {"entries": 1, "hits": 1}
    again.clear()
    assert again.stats()["entries"] == 0
    assert llm.build_client("remote", lambda key: Fake()).name == "extractive"  # no key
    assert llm.build_client("remote", lambda key: Fake(), "k", path).complete(ask) == "answer 1 to q"
    with pytest.raises(ValueError):
        llm.build_client("other")
    assert llm.catalogue(lambda: ["b", "a", "a"]) == ["a", "b"] and llm.masked("sk-1234567890abcd") == "sk-1234...abcd" and llm.masked("short") == "***"


def test_streams_fall_back():
    def broken(after):
        def deltas(messages):
            yield from ["x"] * after
            raise RuntimeError("gone")

        return deltas

    assert list(llm.RemoteClient("m", lambda m: "whole", broken(0)).stream([])) == ["whole"]
    assert list(llm.RemoteClient("m", lambda m: "whole", lambda m: iter(["a", "", "b"])).stream([])) == ["a", "b"]
    got = []
    with pytest.raises(RuntimeError):
        got += (part for part in llm.RemoteClient("m", lambda m: "whole", broken(2)).stream([]))


def test_json_log():
    import io

    from gleaner.service.trace import log_as_json

    out = io.StringIO()
    log_as_json("gleaner.test", stream=out).info("made %d", 3, extra={"chunks": 3})
    row = json.loads(out.getvalue())
    assert row["message"] == "made 3" and row["chunks"] == 3 and row["level"] == "INFO"


class Engine:
    broken = False

    def stats(self):
        return {"chunks": 2}

    def ready(self):
        return {"status": "failing" if self.broken else "ok"}

    def questions(self, texts):
        return texts

    def check_filters(self, filters):
        if "odd" in (filters or {}):
            raise ValueError("unknown filter keys: odd")


def test_health_and_keys():
    engine = Engine()
    api = Api(engine, key="k")
    assert api.handle("GET", "/stats?api_key=k")[0] == 200 and api.handle("GET", "/stats?api_key=k", token="x")[0] == 401 and api.handle("GET", "/stats?api_key=x")[0] == 401
    assert api.handle("POST", "/query", b'{"question": "q", "filters": {"odd": 1}}', "k") == (400, {"error": "unknown filter keys: odd"})
    assert api.handle("POST", "/query", b'{"question": "q", "filters": [1]}', "k")[0] == 400 and api.handle("POST", "/query", b'{"question": "q", "top_k": 0}', "k")[0] == 400
    engine.broken = True
    assert api.handle("GET", "/health")[0] == 503


def test_api(tmp_path):
    api = Api(Engine(), str(tmp_path), "k")
    assert api.handle("GET", "/health")[0] == 200 and api.handle("GET", "/stats")[0] == 401 and api.handle("GET", "/stats", token="k") == (200, {"chunks": 2})
    assert api.handle("GET", "/none", token="k")[0] == 404 and api.handle("GET", "/query", token="k")[0] == 405
    assert api.handle("POST", "/query", b"{", "k")[0] == 400 and api.handle("POST", "/query", b"{}", "k")[0] == 400 and api.handle("POST", "/query", b"x" * (1 << 20) + b"x", "k")[0] == 413
    assert api.allowed_path("../x") is None and api.allowed_path("sub/x") == str(tmp_path / "sub/x")
    assert api.handle("POST", "/ingest", b'{"path": "../.."}', "k")[0] == 400
    assert [api.admitted("c", 0.0) for _ in range(21)] == [True] * 20 + [False] and api.admitted("c", 0.1)


def test_wsgi_and_counts():
    import io

    from gleaner.service.http import wsgi

    api, told = Api(Engine(), key="k"), []
    app = wsgi(api)
    call = lambda method, path, **more: json.loads(b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "wsgi.input": io.BytesIO(b""), **more}, lambda *a: told.append(a[0]))))
    assert call("GET", "/stats", QUERY_STRING="api_key=k") == {"chunks": 2} and "error" in call("GET", "/stats", HTTP_AUTHORIZATION="Bearer x")
    assert told == ["200 OK", "401 Unauthorized"]
    assert 'gleaner_requests_total{path="/stats",status="401"} 1' in api.handle("GET", "/metrics", token="k")[1]
