"""Compaction beside ingestion: one background worker, started every so many commits."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait

from .metrics import Metrics, Timing, now_ms


class CompactionService:
    """run(force) does one compaction and tells whether there was anything to do."""

    def __init__(self, run: Callable[[bool], bool], metrics: Metrics, *, frequency: int = 3, retries: int = 3, retry_delay: float = 60.0):
        self._run, self._metrics, self._frequency, self._retries, self._delay = run, metrics, frequency, retries, retry_delay
        self._pool = ThreadPoolExecutor(1, thread_name_prefix="compaction")
        self._lock, self._single = threading.Lock(), threading.Lock()
        self._commits, self._pending = 0, []
        self._stop = threading.Event()

    @property
    def commits(self) -> int:
        """Since the last compaction."""
        with self._lock:
            return self._commits

    def notify_commit(self) -> Future:
        with self._lock:
            self._commits += 1
        future = self._pool.submit(self._if_due)
        self._pending = [*(f for f in self._pending if not f.done()), future]
        return future

    def _if_due(self, force: bool = False) -> bool:
        if not self._single.acquire(blocking=False):
            return False
        try:
            seen = self.commits
            if not force and seen < self._frequency:
                return False
            return self._with_retries(seen, force)
        finally:
            self._single.release()

    def _with_retries(self, seen: int, force: bool) -> bool:
        for attempt in range(self._retries + 1):
            start = now_ms()
            try:
                done = self._run(force)
            except Exception as e:
                self._metrics.record(Timing("compaction", -1, attempt, start, now_ms(), False, str(e)[:500]))
                if attempt == self._retries or self._stop.wait(self._delay):
                    raise
                continue
            with self._lock:
                self._commits -= seen  # commits that came meanwhile stay counted
            if done:
                self._metrics.record(Timing("compaction", -1, attempt, start, now_ms(), True))
            return done
        return False

    def shutdown(self, final: bool = True, timeout: float = 1800.0) -> list[BaseException]:
        """Waits for work in flight, then compacts once more whatever the count is; returns what failed."""
        until = time.monotonic() + timeout
        wait(self._pending, timeout)
        self._stop.set()
        errors = [e for f in self._pending if f.done() and (e := f.exception())]
        if final and time.monotonic() < until:
            try:
                self._if_due(force=True)
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        self._pool.shutdown(wait=True)
        return errors
