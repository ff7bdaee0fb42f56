"""Answering with a remote model: client protocol, retries, and a bounded cache of answers. Driver side, no Spark."""

from __future__ import annotations

import sqlite3
import threading
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol, TypeVar

from gleaner.functions.ids import stable_hash
from gleaner.functions.retries import with_retries
from gleaner.operators.answer import NO_ANSWER

V = TypeVar("V")


class LLMClient(Protocol):
    name: str

    def complete(self, messages: list[dict], **options: object) -> str: ...


def base_url(url: str) -> str:
    """Without slashes at the end, and ending in the version."""
    url = url.strip().rstrip("/")
    return url if url.endswith("/v1") else f"{url}/v1"


class LRU:
    """A bounded mapping that forgets what was used least recently, with its hit rate."""

    def __init__(self, size: int):
        self.size, self.hits, self.misses = size, 0, 0
        self.data: OrderedDict = OrderedDict()

    def get(self, key, default=None):
        if key in self.data:
            self.hits += 1
            self.data.move_to_end(key)
            return self.data[key]
        self.misses += 1
        return default

    def put(self, key, value) -> None:
        self.data[key] = value
        self.data.move_to_end(key)
        while len(self.data) > self.size:
            self.data.popitem(last=False)

    def get_or_compute(self, key, make: Callable[[], V]) -> V:
        missing = object()
        value = self.get(key, missing)
        if value is missing:
            value = make()
            self.put(key, value)
        return value

    @property
    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


class RemoteClient:
    """A chat endpoint behind two calls: ``ask(messages, **options)`` gives an answer, ``deltas`` (if there is one) its parts.

    Both come from whichever client library the caller has. A stream that fails before its first part is asked again as a
    whole; what was handed out already stays.
    """

    def __init__(self, name: str, ask: Callable[..., str], deltas: Callable[..., Iterator[str]] | None = None, attempts: int = 3):
        self.name, self.ask, self.deltas, self.attempts = name, ask, deltas, attempts

    def complete(self, messages: list[dict], **options: object) -> str:
        return with_retries(lambda: self.ask(messages, **options), self.attempts)

    def stream(self, messages: list[dict], **options: object) -> Iterator[str]:
        begun = False
        if self.deltas is not None:
            try:
                for part in self.deltas(messages, **options):
                    if part:
                        begun = True
                        yield part
            except Exception:
                if begun:
                    raise
        if not begun:
            yield self.complete(messages, **options)


class ExtractiveClient:
    """No model: says that there is no answer; ``operators.answer`` makes extractive answers as columns."""

    name = "extractive"

    def complete(self, messages: list[dict], **options: object) -> str:
        return NO_ANSWER


def catalogue(models: Callable[[], Iterable[str]], limit: int = 40) -> list[str]:
    """The models that an endpoint names, sorted."""
    return sorted(set(models()))[:limit]


def masked(key: str) -> str:
    """A secret as it may be shown: both ends of a long one, nothing of a short one."""
    return f"{key[:7]}...{key[-4:]}" if len(key) > 12 else "***"


def build_client(provider: str, make: Callable[[str], LLMClient] | None = None, key: str | None = None, cache: str | None = None, entries: int = 2000) -> LLMClient:
    """The client that settings ask for: a remote one (``make`` gets the key) only with a key, else the extractive one; with
    ``cache`` its answers are kept in that file."""
    if provider not in ("remote", "extractive"):
        raise ValueError(f"there is no provider {provider}")
    client = make(key) if provider == "remote" and make is not None and key else ExtractiveClient()
    return CachedClient(client, entries, cache) if cache is not None else client


class CachedClient:
    """Answers of another client, kept by model, temperature and messages; the entries with the fewest hits go first, of equal
    ones the oldest. They live in one SQLite file, so they outlast the process and are shared by threads and processes; without
    a path, in memory."""

    def __init__(self, inner: LLMClient, entries: int = 2000, path: str | None = None):
        self.inner, self.entries, self.name, self.lock = inner, entries, inner.name, threading.Lock()
        self.db = sqlite3.connect(path or ":memory:", check_same_thread=False, isolation_level=None, timeout=30)
        self.db.execute("CREATE TABLE IF NOT EXISTS answers (seq INTEGER PRIMARY KEY AUTOINCREMENT, key TEXT UNIQUE NOT NULL, answer TEXT NOT NULL, hits INTEGER NOT NULL DEFAULT 0)")

    def _one(self, sql: str, *values: object) -> tuple | None:
        with self.lock:
            return self.db.execute(sql, values).fetchone()

    def complete(self, messages: list[dict], **options: object) -> str:
        key = stable_hash(options.get("model", self.name), options.get("temperature", 0), messages)
        held = self._one("UPDATE answers SET hits = hits + 1 WHERE key = ? RETURNING answer", key)
        if held:
            return held[0]
        answer = with_retries(lambda: self.inner.complete(messages, **options))
        self._one("INSERT INTO answers (key, answer) VALUES (?, ?) ON CONFLICT (key) DO UPDATE SET answer = excluded.answer", key, answer)
        # what was just written has no hits yet: it stays, as the newest
        self._one("DELETE FROM answers WHERE seq IN (SELECT seq FROM answers WHERE key <> ? ORDER BY hits, seq LIMIT max(0, (SELECT count(*) FROM answers) - ?))", key, self.entries)
        return answer

    def stats(self) -> dict:
        n, hits = self._one("SELECT count(*), coalesce(sum(hits), 0) FROM answers")
        return {"entries": n, "hits": hits}

    def clear(self) -> None:
        self._one("DELETE FROM answers")

    def stream(self, messages: list[dict], width: int = 24, **options: object) -> Iterator[str]:
        answer = self.complete(messages, **options)
        yield from (answer[i : i + width] for i in range(0, max(len(answer), 1), width))
