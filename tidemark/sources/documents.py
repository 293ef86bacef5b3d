"""Version maps and checkpoint sidecars as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import parse_position
from tidemark.operators.versions import from_map


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Version rows from metadata files (each one JSON document); broken ones have none."""
    return from_map(spark.read.text(path, wholetext=True))


def read_checkpoints(spark: SparkSession, path: str, suffix: str = ".download") -> DataFrame:
    """The file and position of each sidecar that ``path`` (a pattern) finds."""
    texts = spark.read.text(path, wholetext=True)
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    # The path is encoded like an address; a plus sign is no space there.
    decoded = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    own = F.regexp_replace(decoded, f"\\Q{suffix}\\E$", "")
    return texts.select(own.alias("path"), parse_position(F.col("value")).alias("position"))
