"""A command line: plan a sync or do it, list, summarise. ``python -m tidemark.cli --help``.

Inventories are Parquet tables of the inventory schema (with ``url`` where files
are to be transferred), or folders.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.hooks import Registry
from tidemark.logsetup import setup_logging
from tidemark.model import CHUNK_SIZE, RunConfig
from tidemark.operators import filters, inventory, sync
from tidemark.operators.session import sync_session
from tidemark.sources.http import files_transport
from tidemark.sources.local import listing
from tidemark.sources.profiles import Profile, load_profile


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="What a sync of a remote inventory to a local one would do.")
    p.add_argument("remote", help="a Parquet table of inventory rows, or folder:PATH")
    p.add_argument("local", nargs="?", help="the same for the local side")
    p.add_argument("--transfer", action="store_true", help="do what the plan says; the local side is a folder, the addresses are paths on a mounted drive")
    p.add_argument("--email", help="the account that the inventory is of")
    p.add_argument("--log-file", help="write the events of a listing or a transfer to this file, too")
    p.add_argument("--list", metavar="PATH", help="list what a folder holds, and end")
    p.add_argument("--list-shared", action="store_true", help="list the shared roots, and end")
    p.add_argument("--profile", help="a profile of include and exclude patterns")
    p.add_argument("--profile-file", default="profiles.json")
    p.add_argument("--mode", choices=("compat", "contract"), default="compat", help="whether folders are judged by the patterns, too")
    p.add_argument("--chunk-size", type=int, default=CHUNK_SIZE)
    p.add_argument("--max-workers", type=int, default=4)
    p.add_argument("--max-retries", type=int, default=3)
    return p


def _read(spark: SparkSession, at: str) -> DataFrame:
    return listing(spark, at.removeprefix("folder:")) if at.startswith("folder:") else spark.read.parquet(at)


def run(spark: SparkSession, argv: list[str], out=sys.stdout, hooks: Registry | None = None) -> int:
    a = parser().parse_args(argv)
    config = RunConfig(email=a.email, workers=a.max_workers, retries=a.max_retries, chunk_size=a.chunk_size)
    items = _read(spark, a.remote)
    logger = setup_logging(a.log_file) if a.log_file else None
    # Listing the shared roots comes before listing a path, and that before a plan.
    if a.list_shared or a.list is not None:
        rows = inventory.list_shared_roots(items) if a.list_shared else inventory.list_children(items, a.list)
        if logger:
            asked = spark.createDataFrame([(a.list or "",)], "request string")
            said = inventory.shared_listing_event(items) if a.list_shared else inventory.listing_events(items, asked)
            for r in said.collect():  # one row
                logger.log(getattr(logging, r["level"]), r["body"])
        contents = [{"name": r.name, "type": r.type} for r in rows.orderBy("name").toLocalIterator()]
        for c in contents:
            print(f"{c['type']}\t{c['name']}", file=out)
        # Hooks are told of a folder's contents, but not of nothing nor of shared roots.
        if hooks is not None and contents and not a.list_shared:
            hooks.dispatch("on_list_contents", a.list, contents)
        return 0
    if a.local is None:
        print("a local side is needed", file=sys.stderr)
        return 1
    profile = load_profile(a.profile_file, a.profile) if a.profile else Profile()
    if a.transfer:
        there, here = a.remote.removeprefix("folder:"), a.local.removeprefix("folder:")
        if "url" not in items.columns:
            items = items.withColumn("url", F.when(F.col("type") == "file", F.concat(F.lit(there.rstrip("/") + "/"), "path")))
        config = replace(config, include=tuple(profile.include), exclude=tuple(profile.exclude))
        s = sync_session(items.where("root = 'owned'"), here, files_transport, config=config, hooks=hooks, logger=logger, source=there)
        moved = s.summary["total_bytes_transferred"] / 1048576
        print(f"{s.summary['successful']} of {s.summary['total_files']} files transferred, {s.summary['failed']} failed, {moved:.2f} MB", file=out)
        return 0 if not s.summary["failed"] else 1
    keep = filters.filter_pruned if a.mode == "compat" else filters.filter_files
    files = keep(inventory.readable_files(items.where("root = 'owned'")), profile.include, profile.exclude)
    plan = sync.sync_plan(files, inventory.readable_files(_read(spark, a.local)))
    for r in sync.plan_summary(plan).orderBy("action").collect():  # three rows at most
        print(f"{r.action}: {r.files} files, {r.total_bytes / 1048576:.2f} MB", file=out)
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        code = run(spark, sys.argv[1:])
    except KeyboardInterrupt:
        code = 130
    except Exception as e:
        print(e, file=sys.stderr)
        code = 1
    sys.exit(code)


if __name__ == "__main__":
    main()
