"""Transfers into files that exist or don't: ranges are written at their positions, old files are archived.

A file is made beside its place and put there in one step. Whatever fails, the
file beside it goes, and the old one stays. A task that is run again finds what
was archived in this session and archives it once.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import traceback
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.sources.http import Transport, fetch_range, open_with_retry

#: Bytes that one request asks for, and that are held in memory at most.
PART_BYTES = 8 << 20
OUTCOME = "path string, size long, downloaded long, checksum string, status string, changes long, error string, archived_path string, old_checksum string, events array<struct<level:string,body:string>>"
_COLUMNS = [x.split()[0] for x in OUTCOME.split(", ")]


def sha256_of(file: str) -> str:
    """The checksum of a file, read in blocks."""
    with open(file, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def inside(top: str, path: str) -> str:
    """Where ``path`` is below ``top``; ValueError if it leads out of it."""
    at = os.path.abspath(os.path.join(top, path))
    if at == top or os.path.commonpath([top, at]) != top:
        raise ValueError("the path leads out of the folder")
    return at


def archive(top: str, path: str, version: int, stamp: str) -> tuple[str, str]:
    """Keeps the file ``path`` as a version, and gives the version's path and the file's checksum; OSError if that can't be done.

    The version is another name of the file's content, so the file stays in
    place until it is replaced.
    """
    at, kept = inside(top, path), f".versions/{path}.v{version}_{stamp}"
    to = os.path.join(top, kept)
    if not os.path.exists(to):
        os.makedirs(os.path.dirname(to), exist_ok=True)
        try:
            os.link(at, to)
        except FileExistsError:
            pass
        except OSError:
            half = f"{to}.{uuid.uuid4().hex}"
            shutil.copy2(at, half)
            os.replace(half, to)
    return kept, sha256_of(to)


def _transfer(top: str, row: dict, transport: Transport, retries: int, stamp: str, sleep: Callable[[float], None]) -> tuple:
    path, size, events = row["path"], row["size"] or 0, []
    name = path.rsplit("/", 1)[-1]
    say = lambda level, event, **more: events.append({"level": level, "body": json.dumps({"event": event, **more})})
    kept = old = temp = None
    ranges = [(r["start"], r["end"]) for r in row["ranges"]]
    try:
        at = inside(top, path)
        if row["version"] is not None and os.path.exists(at):
            # A file that can't be archived is transferred all the same, without a version.
            with contextlib.suppress(OSError):
                kept, old = archive(top, path, row["version"], stamp)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        temp = f"{at}.{uuid.uuid4().hex}.temp"
        whole = sum(b - a + 1 for a, b in ranges) >= size
        if os.path.exists(at) and not whole:
            shutil.copyfile(at, temp)
        with open(temp, "r+b" if os.path.exists(temp) else "w+b") as f:
            for a, b in ranges:
                for start in range(a, b + 1, PART_BYTES):
                    end = min(b, start + PART_BYTES - 1)
                    log = lambda e: events.append({"level": "WARNING", "body": json.dumps(e)})
                    piece = open_with_retry(lambda s=start, e=end: fetch_range(transport, row["url"], s, e, retries, sleep), sleep=sleep, log=log, file=name)
                    f.seek(start)
                    f.write(piece)
            f.truncate(size)
        if not os.path.getsize(temp):
            os.remove(temp)
            say("ERROR", "invalid_temp_file", file=name, error="the file beside is empty")
            say("ERROR", "download_failed", file=name, path=path)
            return path, size, 0, "", "failed", 0, "the file beside is empty", kept or "", old or "", events
        checksum = sha256_of(temp)
        os.replace(temp, at)
        say("INFO", "download_success", file=name, path=path)
        return path, size, sum(b - a + 1 for a, b in ranges), checksum, "completed", len(ranges), "", kept or "", old or "", events
    except Exception as e:
        say("ERROR", "download_failed", file=name, error=str(e), traceback=traceback.format_exc())
        if temp and os.path.exists(temp):
            try:
                os.remove(temp)
            except OSError as x:
                say("ERROR", "temp_file_cleanup_error", error=str(x))
        say("ERROR", "download_failed", file=name, path=path)
        return path, size, 0, "", "failed", 0, str(e) or type(e).__name__, kept or "", old or "", events


def transfer(files: DataFrame, folder: str, connect: Callable[[], Transport], stamp: str, retries: int = 3, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """The outcome of each file of ``files``: ``path``, ``url``, ``size``, ``ranges`` (of ``start``, ``end``) and ``version`` (the number under which an old file is archived, or null).

    ``folder`` is seen by all executors; ``connect`` runs once a task. The work
    is done when the result is computed, so who uses it more than once writes
    it first.
    """
    import time

    top, wait = os.path.abspath(folder), sleep or time.sleep
    # The kinds of the outcome's columns, as the schema above has them.
    event = pa.list_(pa.struct([("level", pa.string()), ("body", pa.string())]))
    kinds = pa.schema([(c, event if c == "events" else pa.int64() if c in ("size", "downloaded", "changes") else pa.string()) for c in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport = connect()
        for batch in batches:
            for r in batch.to_pylist():
                out = _transfer(top, r, transport, retries, stamp, wait)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds.types, strict=True)], schema=kinds)

    return files.select("path", "url", "size", "ranges", "version").mapInArrow(run, OUTCOME)
