"""Audit output beside the work: one writer thread, whose failures come back to whoever submits next."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor


class AuditWriter:
    """Runs writes one after another on a thread of its own.

    A write that failed is raised by the next ``submit``, ``flush`` or ``close``, and
    nothing is taken after it; what is written must bear being written again.
    """

    def __init__(self) -> None:
        self._pool = ThreadPoolExecutor(max_workers=1, thread_name_prefix="audit")
        self._open: list[Future] = []

    def _reap(self, wait: bool) -> None:
        left = []
        for job in self._open:
            if wait or job.done():
                job.result()
            else:
                left.append(job)
        self._open = left

    def submit(self, write: Callable[[], None]) -> None:
        self._reap(wait=False)
        self._open.append(self._pool.submit(write))

    def flush(self) -> None:
        """Wait until all is written."""
        self._reap(wait=True)

    def close(self) -> None:
        try:
            self.flush()
        finally:
            self._pool.shutdown(wait=True)


class WindowLog:
    """Drawn windows as JSON lines on the driver.

    ``synchronous``: each record is on disk (fsync) before ``append`` returns; otherwise a
    thread writes it.  A record of a window that is logged already must be the same, and
    is not written twice.
    """

    def __init__(self, path: str, synchronous: bool = False) -> None:
        self.path, self.synchronous = path, synchronous
        self._writer = None if synchronous else AuditWriter()
        self._logged = {r["window_id"]: r for r in self.read()}

    def read(self) -> list[dict]:
        """The records so far; a torn last line, left by a crash, is cut off."""
        if not os.path.exists(self.path):
            return []
        with open(self.path, "rb") as f:
            whole = f.read()
        kept = whole[: whole.rfind(b"\n") + 1]
        if kept != whole:
            with open(self.path, "wb") as f:
                f.write(kept)
        return [json.loads(line) for line in kept.splitlines()]

    def append(self, records: Iterable[Mapping]) -> None:
        for record in records:
            line = json.dumps(record, sort_keys=True, separators=(",", ":"))
            told, window = json.loads(line), record["window_id"]
            if window in self._logged:
                if self._logged[window] != told:
                    raise ValueError(f"window {window} is logged otherwise")
                continue
            self._logged[window] = told
            if self._writer:
                self._writer.submit(lambda line=line: self._write(line))
            else:
                self._write(line)

    def _write(self, line: str) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line + "\n")
            f.flush()
            os.fsync(f.fileno())

    def close(self) -> None:
        if self._writer:
            self._writer.close()
