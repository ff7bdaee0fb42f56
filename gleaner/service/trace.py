"""Traces of queries: timed stages, appended as lines of JSON; and counters in the text format of metrics scrapers."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager


class Trace:
    def __init__(self, query: str):
        self.trace_id, self.query, self.began = uuid.uuid4().hex[:16], query, time.perf_counter()
        self.spans: list[dict] = []
        self.meta: dict = {}

    @contextmanager
    def span(self, name: str, **meta: object) -> Iterator[None]:
        t = time.perf_counter()
        try:
            yield
        finally:
            self.spans.append({"name": name, "ms": round((time.perf_counter() - t) * 1000, 2), **meta})

    def stage_ms(self, name: str) -> float:
        return sum(s["ms"] for s in self.spans if s["name"] == name)

    def to_dict(self) -> dict:
        return {"trace_id": self.trace_id, "query": self.query, "total_ms": round((time.perf_counter() - self.began) * 1000, 2), "spans": self.spans, **self.meta}


class Tracer:
    """Appends to a file, or keeps nothing; a disk that fails never fails a query."""

    def __init__(self, path: str | None = None):
        self.path, self.queries, self.ms = path, 0, 0.0
        self.answered: Counter = Counter()

    def count(self, path: str, status: int) -> None:
        """One request that was answered."""
        self.answered[path, status] += 1

    def emit(self, trace: Trace) -> None:
        row = trace.to_dict()
        self.queries += 1
        self.ms += row["total_ms"]
        if self.path:
            try:
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(json.dumps(row, ensure_ascii=False) + "\n")
            except OSError:
                pass

    def metrics(self, stats: dict) -> str:
        rows = {"gleaner_queries_total": self.queries, "gleaner_query_ms_total": round(self.ms, 2), **{f"gleaner_{k}": v for k, v in stats.items() if isinstance(v, (int, float))}}
        requests = "".join(f'gleaner_requests_total{{path="{p}",status="{n}"}} {k}\n' for (p, n), k in sorted(self.answered.items()))
        return ("# TYPE gleaner_requests_total counter\n" + requests if requests else "") + "".join(f"# TYPE {k} {'counter' if k.endswith('_total') else 'gauge'}\n{k} {v}\n" for k, v in rows.items())


class JsonLines(logging.Formatter):
    """Log records as lines of JSON, with whatever was given as ``extra``."""

    _known = frozenset(vars(logging.makeLogRecord({})))

    def format(self, record: logging.LogRecord) -> str:
        row = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        row |= {k: v for k, v in vars(record).items() if k not in self._known and k not in ("message", "asctime")}
        if record.exc_info:
            row["exception"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False, default=str)


def log_as_json(name: str = "gleaner", level: int = logging.INFO, stream=None) -> logging.Logger:
    """The library's logger, writing such lines; calling it again changes the level only."""
    log = logging.getLogger(name)
    if not any(isinstance(h.formatter, JsonLines) for h in log.handlers):
        handler = logging.StreamHandler(stream)
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(level)
    return log
