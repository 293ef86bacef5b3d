"""Version histories.

``compat``: the first content's checksum is written as version 0. When the content
changes, the one that goes is archived as the next version, and the new one is
not written. So after k contents the history is c1, c1, c2 .. c(k-1), and the
latest checksum is one content behind. ``contract``: each content is a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import archived_path, file_stamp
from tidemark.model import VERSION_MAP

#: Neighbouring versions of a path that stay together where a map is dealt to several texts.
VERSIONS_AT_ONCE = 500


def version_history(contents: DataFrame, mode: str = "compat") -> DataFrame:
    """Versions from contents (``path``, ``seq`` that orders them, ``checksum``): ``path``, ``version``, ``checksum``, ``archived``."""
    order = Window.partitionBy("path").orderBy("seq")
    n = contents.withColumn("version", F.row_number().over(order) - 1)
    if mode == "contract":
        return n.select("path", "version", "checksum", F.lead("seq").over(order).isNotNull().alias("archived"))
    if mode != "compat":
        raise ValueError(f"no mode {mode!r}")
    before = n.withColumn("before", F.lag("checksum").over(order))
    return before.select("path", "version", F.coalesce("before", "checksum").alias("checksum"), (F.col("version") > 0).alias("archived"))


def with_archived_path(history: DataFrame, at) -> DataFrame:
    stamp = file_stamp(at)
    return history.select("path", "version", "checksum", F.when(F.col("archived"), archived_path(F.col("path"), F.col("version"), stamp)).otherwise("").alias("archived_path"), stamp.alias("timestamp"))


def latest_checksum(history: DataFrame) -> DataFrame:
    """The checksum of each path's last version, which is a partial aggregate: no path's versions are brought together."""
    return history.groupBy("path").agg(F.max("version").alias("version"), F.max_by("checksum", "version").alias("checksum"))


def record_versions(history: DataFrame, archived: DataFrame) -> DataFrame:
    """``history`` and new versions for ``archived`` (``path``, ``seq``, ``checksum``), numbered on from each path's last, or from 1."""
    last = history.groupBy("path").agg(F.max("version").alias("last"))
    order = Window.partitionBy("path").orderBy("seq")
    new = archived.withColumn("n", F.row_number().over(order)).join(last, "path", "left")
    new = new.select("path", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("version"), "checksum", F.lit(True).alias("archived"))
    return history.select("path", "version", "checksum", "archived").unionByName(new)


def baseline_missing(files: DataFrame, history: DataFrame) -> DataFrame:
    """Version 0 for files that the history lacks."""
    return files.join(history.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).alias("version"), "checksum")


def stale_latest(contents: DataFrame, history: DataFrame) -> DataFrame:
    """Paths whose latest recorded checksum isn't the current content's."""
    now = contents.groupBy("path").agg(F.max_by("checksum", "seq").alias("current"))
    return now.join(latest_checksum(history), "path").where("current <> checksum").select("path", "version", F.col("checksum").alias("recorded"), "current")


def rollback_target(contents: DataFrame, back: int = 1) -> DataFrame:
    """Contract: the version ``back`` steps before the current one, for paths that have it."""
    history = version_history(contents, "contract")
    last = history.groupBy("path").agg(F.max("version").alias("last"))
    return history.join(last, "path").where(F.col("version") == F.col("last") - back).select("path", "version", "checksum")


def from_map(documents: DataFrame, column: str = "value") -> DataFrame:
    """Version rows from JSON texts; one that can't be read has none."""
    m = documents.select(F.from_json(column, VERSION_MAP).alias("m")).select(F.explode(F.coalesce("m", F.create_map().cast(VERSION_MAP))).alias("path", "list"))
    return m.select("path", F.explode("list").alias("v")).select("path", "v.*")


def to_map(versions: DataFrame, parts: int = 1) -> DataFrame:
    """All versions as JSON texts in the metadata file's form: one, or about ``parts`` that hold like shares.

    A path with many versions has some of them in each of several texts;
    ``from_map`` brings all together again.
    """
    version = F.struct("version", "checksum", "archived_path", "timestamp")
    # Of one path at most a share's versions are dealt alike, so none is a text's bulk.
    part = F.pmod(F.xxhash64("path", F.floor(F.col("version") / VERSIONS_AT_ONCE)), F.lit(parts)) if parts > 1 else F.lit(0)
    lists = versions.groupBy(part.alias("part"), "path").agg(F.array_sort(F.collect_list(version)).alias("list"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "list"))))).alias("value")
    return lists.groupBy("part").agg(text).select("value") if parts > 1 else lists.agg(text)
