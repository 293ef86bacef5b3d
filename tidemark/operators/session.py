"""A session: what is there, what must be moved, moving it, and what became of it."""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_readable_file
from tidemark.hooks import Registry
from tidemark.logsetup import log_event
from tidemark.model import RunConfig
from tidemark.operators import filters, results, sync
from tidemark.sinks.transfer import transfer
from tidemark.sources.documents import read_versions
from tidemark.sources.http import Transport
from tidemark.sources.local import listing
from tidemark.streaming.progress import shared_folder

VERSIONS_FILE, REPORT_FILE = "tidemark_versions.json", "download_report.json"
#: The columns of a result.
DETAILS = ("path", "size", "downloaded", "checksum", "status", "changes", "error")


@dataclass
class Session:
    """A session's results and events (tables in the shared folder), its versions and its summary."""

    results: DataFrame
    events: DataFrame
    versions: DataFrame
    summary: dict


def invalid_items(items: DataFrame) -> DataFrame:
    """Items that are neither folders nor have a name and an address, each with its warning. They have no result."""
    bad = items.where((F.coalesce("type", F.lit("")) != "folder") & (F.col("name").isNull() | F.col("url").isNull()))
    body = F.to_json(F.struct(F.lit("invalid_item").alias("event"), F.lit("the item has no name or nothing to open").alias("error")))
    return bad.select("path", F.struct(F.lit("WARNING").alias("level"), body.alias("body")).alias("event"))


def unchanged_events(plan: DataFrame) -> DataFrame:
    """What is logged of files that need nothing."""
    name = F.substring_index("path", "/", -1).alias("file")
    say = lambda e: F.struct(F.lit("INFO").alias("level"), F.to_json(F.struct(F.lit(e).alias("event"), name, F.col("path"))).alias("body"))
    return plan.where("action = 'unchanged'").select("path", F.explode(F.array(say("file_unchanged"), say("download_success"))).alias("event"))


def write_report_file(found: DataFrame, summary: dict, file: str) -> None:
    """The report as one JSON document, written a result at a time."""
    with open(file, "w") as f:
        f.write('{"summary": ' + json.dumps(summary) + ', "details": [')
        for i, text in enumerate(_lines(found.orderBy("path").select(F.to_json(F.struct(*DETAILS)).alias("value")))):
            f.write((",\n" if i else "\n") + text)
        f.write("\n]}\n")


def write_versions_file(versions: DataFrame, file: str) -> None:
    """All versions as one JSON document by path, written a path at a time, in place of an earlier one."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("version", "checksum", "archived_path", "timestamp"))), lambda x: x)
    text = versions.groupBy("path").agg(each.alias("list")).orderBy("path").select(F.to_json(F.create_map("path", "list")).alias("value"))
    with open(f"{file}.new", "w") as f:
        f.write("{")
        for i, one in enumerate(_lines(text)):
            f.write((",\n" if i else "\n") + one[1:-1])
        f.write("\n}\n")
    os.replace(f"{file}.new", file)


def _lines(df: DataFrame) -> Iterator[str]:
    return (r["value"] for r in df.toLocalIterator())


def sync_session(
    remote: DataFrame,
    folder: str,
    connect: Callable[[], Transport],
    *,
    config: RunConfig = RunConfig(),
    ranges: DataFrame | None = None,
    hooks: Registry | None = None,
    logger: logging.Logger | None = None,
    at: dt.datetime | None = None,
    source: str = "",
    sleep: Callable[[float], None] | None = None,
) -> Session:
    """Bring ``folder`` (which all executors see) to what ``remote`` has.

    ``remote`` has inventory rows with ``url``. Items without a name or an
    address are left out and warned of; of repeated paths one counts; patterns
    are those of ``config``, and judge folders, too. Compat: files of another size are
    moved whole. Contract: ``ranges`` (``path``, ``start``, ``end``) are what is
    moved of each file that it names, and files that it lacks are unchanged.

    Old files are archived under ``.versions``; results, events and versions
    are tables, the report and the versions are files in the folder as well. Hooks
    are told of each file before anything is moved, and after all has been. Nothing
    that grows with the session is held on the driver.
    """
    spark, now = remote.sparkSession, at or dt.datetime.now()
    stamp, work = now.strftime("%Y%m%dT%H%M%S"), shared_folder(remote.sparkSession)
    hooks = hooks or Registry()
    os.makedirs(folder, exist_ok=True)
    started = {"event": "download_started", "icloud_path": source, "local_path": folder, "max_workers": config.workers, "chunk_size": config.chunk_size}
    if logger:
        log_event(logger, logging.INFO, **started)

    files = remote.where(is_readable_file(F.col("type"), F.col("size"), F.col("url").isNotNull() & F.col("name").isNotNull()))
    files = filters.filter_pruned(files, list(config.include), list(config.exclude))
    files = files.groupBy("path").agg(F.max_by(F.struct("size", "url"), F.struct("size", "url")).alias("f")).select("path", "f.*")
    have = listing(spark, folder).where("type = 'file' AND path NOT LIKE '.versions/%'").select("path", "size")
    plan = sync.sync_plan(files, have)
    if ranges is None:
        wanted = sync.transfer_ranges(plan).select("path", "start", "end")
    else:
        wanted = ranges.select("path", "start", "end")
        named = ranges.select("path").distinct().withColumn("named", F.lit(True))
        action = F.when(F.col("named").isNull(), "unchanged").when(F.col("local_size").isNull(), "new").otherwise("changed")
        plan = plan.join(named, "path", "left").withColumn("action", action).drop("named")
    plan.write.parquet(f"{work}/plan")
    plan = spark.read.parquet(f"{work}/plan")

    history = read_versions(spark, f"{folder}/{VERSIONS_FILE}") if os.path.exists(f"{folder}/{VERSIONS_FILE}") else None
    each = wanted.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    todo = plan.where("action <> 'unchanged'").join(each, "path").join(files.select("path", "url"), "path")
    if history is not None:
        todo = todo.join(history.groupBy("path").agg(F.max("version").alias("last")), "path", "left")
    else:
        todo = todo.withColumn("last", F.lit(None).cast("int"))
    # An old file is archived as the version after the last recorded, or as the first.
    todo = todo.withColumn("version", F.when(F.col("local_size").isNotNull(), F.coalesce(F.col("last"), F.lit(0)) + 1))
    for path in _lines(todo.select(F.col("path").alias("value"))) if hooks.hooks else ():
        hooks.dispatch("before_download", path, f"{folder}/{path}")

    # Moved once: everything else reads what was written.
    spread = todo.repartition(max(config.workers, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    transfer(spread, folder, connect, stamp, config.retries, sleep).write.parquet(f"{work}/moved")
    moved = spark.read.parquet(f"{work}/moved")
    details = moved.select(*DETAILS)

    events = moved.select("path", F.explode("events").alias("event")).unionByName(unchanged_events(plan)).unionByName(invalid_items(remote))
    events = events.select("path", "event.level", F.col("event.body").alias("body"))
    row = results.session_summary(details).first()
    summary = {**row.asDict(), "timestamp": now.strftime("%Y-%m-%d %H:%M:%S")}

    versions = _versions(moved, history, stamp)
    if versions is not None:
        versions.write.parquet(f"{work}/versions")
        versions = spark.read.parquet(f"{work}/versions")
        write_versions_file(versions, f"{folder}/{VERSIONS_FILE}")
    write_report_file(details, summary, f"{folder}/{REPORT_FILE}")
    if logger:
        for r in events.orderBy("path").toLocalIterator():
            logger.log(getattr(logging, r["level"]), r["body"])
        log_event(logger, logging.INFO, event="download_completed", summary={"summary": summary})
    if hooks.hooks:
        for r in details.orderBy("path").toLocalIterator():
            if r["status"] == "completed":
                hooks.dispatch("on_event", "download_progress", remote_item=r["path"], local_path=f"{folder}/{r['path']}", downloaded=r["downloaded"], total_size=r["size"])
            hooks.dispatch("after_download", r["path"], f"{folder}/{r['path']}", r["status"] == "completed")
        hooks.dispatch("on_event", "download_session_completed", summary={"summary": summary})
    return Session(details, events, versions, summary)


def _versions(moved: DataFrame, history: DataFrame | None, stamp: str) -> DataFrame:
    """The history with what was archived, and with version 0 of files that had none."""
    kept = moved.where("archived_path <> ''").select(
        "path", F.regexp_extract("archived_path", r"\.v(\d+)_[^_/]*$", 1).cast("int").alias("version"), F.col("old_checksum").alias("checksum"), "archived_path", F.lit(stamp).alias("timestamp"),
    )
    known = kept if history is None else history.select("path", "version", "checksum", "archived_path", "timestamp").unionByName(kept)
    done = moved.where("status = 'completed'").join(known.select("path").distinct(), "path", "left_anti")
    return known.unionByName(done.select("path", F.lit(0).alias("version"), "checksum", F.col("path").alias("archived_path"), F.lit(stamp).alias("timestamp")))
