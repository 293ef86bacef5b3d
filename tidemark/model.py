"""Schemas of the file-synchronisation data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


_KINDS = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "BINARY": T.BinaryType(), "STRINGS": T.ArrayType(T.StringType())}


def _schema(text: str, **more: T.DataType) -> T.StructType:
    """A schema from ``name KIND`` pairs and fields of other types after them; needs no session."""
    pairs = (p.split() for p in text.split(", "))
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in pairs] + [T.StructField(n, t) for n, t in more.items()])


#: A flattened tree of remote items; ``parent`` is the path of the folder, '' for the root's children.
INVENTORY = _schema("root STRING, path STRING, parent STRING, name STRING, type STRING, size BIGINT, depth INT")
LOCAL_STATE = _schema("path STRING, size BIGINT, content BINARY")
#: A byte range; ``end`` is the last byte's position.
RANGE = _schema("start BIGINT, end BIGINT")
CHUNK = _schema("path STRING, chunk_idx BIGINT, start BIGINT, end BIGINT, md5 STRING")
#: What became of one file. Missing values are 0 or ''.
STATUS = _schema("path STRING, size BIGINT, downloaded BIGINT, checksum STRING, status STRING, changes BIGINT, error STRING")
SUMMARY = _schema("total_files BIGINT, successful BIGINT, failed BIGINT, total_bytes_transferred BIGINT, total_changed_chunks BIGINT, timestamp STRING")
CHECKPOINT = _schema("path STRING, position BIGINT")
VERSION = _schema("path STRING, version INT, checksum STRING, archived_path STRING, timestamp STRING")
VERSION_MAP = T.MapType(T.StringType(), T.ArrayType(T.StructType(VERSION.fields[1:])))
PROFILES = T.MapType(T.StringType(), _schema("include STRINGS, exclude STRINGS"))
LISTING_ENTRY = _schema("name STRING, type STRING")
PROGRESS = _schema("name STRING, remote_item STRING, local_path STRING, downloaded BIGINT, total_size BIGINT")
#: All fields that any logged event has; each event has some. The completed session's ``summary`` is the whole report.
LOG_EVENT = _schema(
    "event STRING, file STRING, path STRING, error STRING, traceback STRING, attempt INT, wait_seconds INT, type STRING, icloud_path STRING, local_path STRING, max_workers INT, chunk_size BIGINT",
    contents=T.ArrayType(LISTING_ENTRY),
    summary=T.StructType([T.StructField("summary", SUMMARY), T.StructField("details", T.ArrayType(STATUS))]),
)

CHUNK_SIZE = 1024 * 1024


@dataclass(frozen=True)
class RunConfig:
    """Options of a run; ``workers``, ``retries`` and ``chunk_size`` have the documented defaults."""

    email: str | None = None
    workers: int = 4
    retries: int = 3
    chunk_size: int = CHUNK_SIZE
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.workers < 1 or self.retries < 1 or self.chunk_size < 1:
            raise ValueError("workers, retries and chunk_size must be positive")
