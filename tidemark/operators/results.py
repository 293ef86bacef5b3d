"""What became of a session's files, and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import megabytes, report_stamp


def results_of(plan: DataFrame, failed: Column, error: Column, checksum: Column) -> DataFrame:
    """A row for each file that was to be transferred; unchanged ones have none. A failed one moved no bytes."""
    moved = plan.where("action <> 'unchanged'")
    zero = F.lit(0).cast("bigint")
    return moved.select(
        "path", "size", F.when(failed, zero).otherwise(F.col("bytes")).alias("downloaded"), F.when(failed, "").otherwise(F.coalesce(checksum, F.lit(""))).alias("checksum"),
        F.when(failed, "failed").otherwise("completed").alias("status"), F.when(failed, zero).otherwise(F.col("changes")).alias("changes"), F.when(failed, error).otherwise("").alias("error"),
    )


def session_summary(results: DataFrame) -> DataFrame:
    """One row, also for no results: counts of all, completed and failed, bytes and changed ranges."""
    return results.agg(*_totals())


def _totals() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status") == "completed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"),
        total("downloaded").alias("total_bytes_transferred"), total("changes").alias("total_changed_chunks"),
    ]


def transferred_mb(results: DataFrame) -> DataFrame:
    s = session_summary(results)
    return s.select("total_files", "successful", "failed", megabytes(F.col("total_bytes_transferred")).alias("megabytes"))


def session_details(results: DataFrame) -> DataFrame:
    """The details as rows, in the report's order of columns."""
    return results.select("path", "size", "downloaded", "checksum", "status", "changes", "error")


def report(results: DataFrame, at: Column) -> DataFrame:
    """The report as one JSON text. It holds a session's details whole, as the report does: for sessions of a size that one file may have."""
    details = F.collect_list(F.struct("path", "size", "downloaded", "checksum", "status", "changes", "error")).alias("details")
    one = results.agg(*_totals(), details).withColumn("timestamp", report_stamp(at))
    summary = F.struct("total_files", "successful", "failed", "total_bytes_transferred", "total_changed_chunks", "timestamp").alias("summary")
    return one.select(F.to_json(F.struct(summary, "details")).alias("value"))
