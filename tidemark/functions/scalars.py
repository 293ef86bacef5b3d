"""Scalar expressions on paths, ranges, sizes, times and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of an error's text, in lower case, that make it worth another try.
RETRY_MARKERS = ("connection", "remote", "timeout", "reset", "503", "service unavailable", "retry_needed", "internal_failure")
#: Fixed value: seconds that a server may at most make a client wait.
RETRY_AFTER_CAP = 60
#: Fixed value: where an error's text, in lower case, says how long to wait.
RETRY_AFTER = r'retryafter["\s:]+(\d+)'


def clean_path(path: Column) -> Column:
    """Without slashes at the ends and empty parts; the root is ''."""
    return F.array_join(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != ""), "/")


def as_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: Column, root: str) -> Column:
    """``path`` as seen from ``root``; the root itself is '.'."""
    root = root.rstrip("/")
    return F.when(path == root, ".").otherwise(F.substring(path, F.lit(len(root) + 2), F.length(path)))


def parent_path(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """The folders above a path and the path itself, from '.' on."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def is_readable_file(type_: Column, size: Column, openable: Column) -> Column:
    """An item with a type that isn't a folder's, a size, and something to open."""
    return F.coalesce(type_ != "folder", F.lit(False)) & size.isNotNull() & F.coalesce(openable, F.lit(False))


def type_label(readable: Column) -> Column:
    return F.when(readable, "file").otherwise("folder")


def range_length(start: Column, end: Column) -> Column:
    return end - start + 1


def megabytes(count: Column) -> Column:
    """Bytes as megabytes with two decimals; ties go to the even digit."""
    return F.format_string("%.2f", F.bround(count / F.lit(1024.0 * 1024.0), 2))


def content_length(header: Column) -> Column:
    """A header's number; null if it is missing (0) is told apart from one that is no number (null)."""
    return F.when(header.isNull(), F.lit(0).cast("bigint")).otherwise(header.try_cast("bigint"))


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss")


def report_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def archived_path(path: Column, version: Column, stamp: Column) -> Column:
    return F.concat(F.lit(".versions/"), path, F.lit(".v"), version.cast("string"), F.lit("_"), stamp)


def is_retryable(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.exists(F.array(*map(F.lit, RETRY_MARKERS)), lambda m: F.contains(low, m))


def retry_wait(error: Column, attempt: Column) -> Column:
    """Seconds before the next try: what the server asks for, capped, else 2 to the power of the attempt."""
    asked = F.regexp_extract(F.lower(F.coalesce(error, F.lit(""))), RETRY_AFTER, 1)
    backoff = F.pow(F.lit(2), attempt).cast("bigint")
    return F.when(asked != "", F.least(asked.try_cast("bigint"), F.lit(RETRY_AFTER_CAP))).otherwise(backoff)


def backoff_schedule(attempts: Column) -> Column:
    """The waits after each of so many failed tries."""
    return F.transform(F.sequence(F.lit(1), attempts), lambda i: F.pow(F.lit(2), i).cast("bigint"))
