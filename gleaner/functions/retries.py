"""Trying again what may succeed the next time."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

V = TypeVar("V")
RETRY_STATUS = (408, 409, 429)


def is_transient(error: Exception) -> bool:
    """Timeouts, conflicts, rate limits, server errors, and errors without a status are worth another try."""
    status = getattr(error, "status_code", None)
    return status is None or status in RETRY_STATUS or status >= 500


def with_retries(call: Callable[[], V], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> V:
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not is_transient(e):
                raise
            sleep(min(2**n / 2, 8))
    raise ValueError("attempts must be positive")
