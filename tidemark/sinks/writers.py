"""Sinks: files, reports, version maps, checkpoints and the index."""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import cleanup, save_positions
from tidemark.operators.results import report
from tidemark.operators.versions import to_map

#: Versions in a file of a map: some megabytes, which a task holds whole when it writes or reads them.
FILE_VERSIONS = 10_000


def write_report(results: DataFrame, at: Column, folder: str) -> None:
    """The session's report as one JSON text, in place of an earlier one."""
    report(results, at).coalesce(1).write.mode("overwrite").text(folder)


def write_versions(versions: DataFrame, folder: str) -> None:
    """Version rows are appended: history is never rewritten."""
    versions.write.mode("append").parquet(folder)


def export_version_map(versions: DataFrame, folder: str, file_versions: int = FILE_VERSIONS) -> None:
    """The map as files of about ``file_versions`` versions at most, each one JSON document; few versions make one file."""
    parts = -(-versions.count() // file_versions)
    to_map(versions, parts).write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)


def write_checkpoints(checkpoints: DataFrame, new: DataFrame, results: DataFrame, folder: str) -> None:
    """Saved positions with the new ones in place, without those of completed files; ``folder`` isn't the one they came from."""
    cleanup(save_positions(checkpoints, new), results).write.mode("overwrite").parquet(folder)


def index_rows(results: DataFrame, local_root: str) -> DataFrame:
    """Name and local path of each completed file."""
    done = results.where("status = 'completed'")
    return done.select(F.substring_index("path", "/", -1).alias("name"), F.concat(F.lit(local_root.rstrip("/") + "/"), "path").alias("local_path"))


def append_index(results: DataFrame, local_root: str, folder: str) -> None:
    """The index rows, separated by tabs, appended."""
    index_rows(results, local_root).write.mode("append").option("sep", "\t").csv(folder)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``path``, ``content`` below a folder that all executors see, and give each file's outcome.

    Each file is written beside its place and then put there in one step, so a
    task that is run again, or two at once, leave whole files. Empty files and
    paths that lead out of the folder are refused. Columns: ``path``, ``size``,
    ``checksum``, ``status``, ``error``.
    """
    top = os.path.abspath(folder)
    kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("checksum", pa.string()), ("status", pa.string()), ("error", pa.string())])

    def put(path: str, content: bytes | None) -> tuple:
        try:
            at = os.path.abspath(os.path.join(top, path))
            if os.path.commonpath([top, at]) != top or at == top:
                raise ValueError("the path leads out of the folder")
            if not content:
                raise ValueError("the file is empty")
            os.makedirs(os.path.dirname(at), exist_ok=True)
            temp = f"{at}.{uuid.uuid4().hex}.temp"
            try:
                with open(temp, "wb") as f:
                    f.write(content)
                os.replace(temp, at)
            except OSError:
                with contextlib.suppress(OSError):
                    os.remove(temp)
                raise
            return path, len(content), hashlib.sha256(content).hexdigest(), "completed", ""
        except (OSError, ValueError) as e:
            return path, len(content or b""), "", "failed", str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [put(r["path"], r["content"]) for r in batch.to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return files.select("path", "content").mapInArrow(run, "path string, size long, checksum string, status string, error string")
