"""Reading what sessions logged: text lines with a JSON object after time and level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_retryable, retry_wait
from tidemark.model import LOG_EVENT

_LINE = r"^(\S+ \S+) - ([A-Z]+) - (\{.*\})$"


def log_parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """``logged_at``, ``level`` and the event's fields; lines of another form, or with broken JSON, are left out."""
    part = lambda i: F.regexp_extract(column, _LINE, i)
    p = lines.select(part(1).alias("logged_at"), part(2).alias("level"), F.from_json(part(3), LOG_EVENT).alias("e"))
    return p.where("e.event IS NOT NULL").select("logged_at", "level", "e.*")


def failure_count(events: DataFrame) -> DataFrame:
    """Failed files: each logs two events, of which the outer one has the path."""
    return events.where("event = 'download_failed' AND path IS NOT NULL").agg(F.count(F.lit(1)).alias("failures"))


def real_transfers(events: DataFrame) -> DataFrame:
    """Successes that weren't files found unchanged."""
    n = lambda e: F.count_if(F.col("event") == e)
    return events.agg((n("download_success") - n("file_unchanged")).alias("transfers"))


def retryable_errors(events: DataFrame) -> DataFrame:
    return events.where("error IS NOT NULL").select("event", "file", "error", is_retryable(F.col("error")).alias("retryable"))


def retry_waits(events: DataFrame) -> DataFrame:
    retries = events.where("event = 'connection_retry'")
    return retries.select("file", "attempt", retry_wait(F.col("error"), F.col("attempt")).alias("wait_seconds"))


def session_reports(events: DataFrame) -> DataFrame:
    """The summary rows of completed sessions."""
    return events.where("event = 'download_completed'").select("logged_at", "summary.summary.*")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event", "level").agg(F.count(F.lit(1)).alias("events"))
