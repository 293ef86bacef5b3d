"""Byte ranges over HTTP, with retries, and opening with retries.

The transport is given (anything like ``requests``), so nothing here needs a
network to be tested. Answers other than 200 and 206 end the attempt, as a
failed one does; there is no endless loop.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.scalars import RETRY_AFTER, RETRY_AFTER_CAP, RETRY_MARKERS

TIMEOUT = 30


class Transport(Protocol):
    def get(self, url: str, headers: dict[str, str], timeout: int) -> Any: ...


def fetch_range(transport: Transport, url: str, start: int, end: int, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The bytes from ``start`` to ``end``, both included. After a failed try it waits 2, 4, 8 .. seconds; after the last it raises."""
    for attempt in range(1, retries + 1):
        try:
            answer = transport.get(url, headers={"Range": f"bytes={start}-{end}"}, timeout=TIMEOUT)
            answer.raise_for_status()
            if answer.status_code in (200, 206):
                # A server that ignores the range sends all.
                return answer.content if answer.status_code == 206 or len(answer.content) <= end - start + 1 else answer.content[start : end + 1]
            raise OSError(f"status {answer.status_code}")
        except Exception:
            if attempt == retries:
                raise
            sleep(2**attempt)
    raise ValueError("at least one try is needed")


class _Answer:
    """A range of a file, as an HTTP answer has it."""

    def __init__(self, content: bytes):
        self.content, self.status_code = content, 206

    def raise_for_status(self) -> None: ...


class FilesTransport:
    """Serves ranges of files whose paths are the addresses: a mounted drive in place of a server."""

    def get(self, url: str, headers: dict[str, str], timeout: int) -> _Answer:
        start, end = map(int, headers["Range"].removeprefix("bytes=").split("-"))
        with open(url, "rb") as f:
            f.seek(start)
            return _Answer(f.read(end - start + 1))


def files_transport() -> FilesTransport:
    return FilesTransport()


def is_retryable(error: str) -> bool:
    return any(m in error.lower() for m in RETRY_MARKERS)


def retry_wait(error: str, attempt: int) -> int:
    asked = re.search(RETRY_AFTER, error.lower())
    return min(int(asked[1]), RETRY_AFTER_CAP) if asked else 2**attempt


def open_with_retry(open_: Callable[[], Any], attempts: int = 3, sleep: Callable[[float], None] = time.sleep, log: Callable[[dict], None] = lambda e: None, file: str = "unknown") -> Any:
    """What ``open_`` gives; errors that may pass are tried again."""
    for attempt in range(1, attempts + 1):
        try:
            return open_()
        except Exception as e:
            if attempt == attempts or not is_retryable(str(e)):
                raise
            wait = retry_wait(str(e), attempt)
            log({"event": "connection_retry", "file": file, "attempt": attempt, "wait_seconds": wait, "error": str(e)})
            sleep(wait)
    raise ValueError("at least one try is needed")


def fetch_ranges(ranges: DataFrame, connect: Callable[[], Transport], retries: int = 3) -> DataFrame:
    """``path``, ``start``, ``piece``, ``error`` for rows of ``path``, ``url``, ``start``, ``end``; a range at a time in memory.

    ``connect`` runs once a task. A range that fails has its error's text, and
    the others go on.
    """
    kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("piece", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport = connect()
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    row = (r["path"], r["start"], fetch_range(transport, r["url"], r["start"], r["end"], retries), "")
                except Exception as e:
                    row = (r["path"], r["start"], None, str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds.types, strict=True)], schema=kinds)

    return ranges.select("path", "url", "start", "end").mapInArrow(run, "path string, start long, piece binary, error string")
