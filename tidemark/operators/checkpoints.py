"""Resume positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_position(text: Column) -> Column:
    """The position in a sidecar's JSON; 0 if there is none, or nothing readable."""
    return F.coalesce(F.get_json_object(text, "$.position").try_cast("bigint"), F.lit(0).cast("bigint"))


def resume_positions(saved: DataFrame) -> DataFrame:
    """The last saved position of each key (``key``, ``seq``, ``position``): a partial aggregate, no sort."""
    return saved.groupBy("key").agg(F.max_by("position", "seq").alias("position"))


def cleanup(checkpoints: DataFrame, results: DataFrame) -> DataFrame:
    """Checkpoints of files that aren't completed."""
    return checkpoints.join(results.where("status = 'completed'").select("path"), "path", "left_anti")


def save_positions(checkpoints: DataFrame, new: DataFrame) -> DataFrame:
    """``checkpoints`` with the rows of ``new`` in place of those of the same paths."""
    return checkpoints.join(new.select("path"), "path", "left_anti").unionByName(new)
