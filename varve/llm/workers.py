"""Memory of Python workers: what a task held goes back to the system, so that idle workers stay small."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable

import pyarrow as pa


def tidy() -> None:
    """Give free memory back: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Idle:
    """Calls ``release`` once nothing has been in use for ``after`` seconds. Use: ``with idle: ...``."""

    def __init__(self, release: Callable[[], None], after: float = 3.0):
        self.release, self.after = release, after
        self._lock, self._users, self._timer = threading.Lock(), 0, None

    def __enter__(self) -> Idle:
        with self._lock:
            self._users += 1
            if self._timer:
                self._timer.cancel()
                self._timer = None
        return self

    def __exit__(self, *_: object) -> None:
        with self._lock:
            self._users -= 1
            if not self._users:
                self._timer = threading.Timer(self.after, self._end)
                self._timer.daemon = True
                self._timer.start()

    def _end(self) -> None:
        with self._lock:
            if not self._users:
                self.release()
                tidy()
