"""What must be transferred: remote files against local state.

``compat`` compares sizes: a file whose size is the same counts as unchanged,
whatever it holds, and any other is transferred whole. ``contract`` compares
chunk hashes at their positions and transfers the ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import CHUNK_SIZE


def sync_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Compat: an action for each remote file, from sizes alone.

    Columns: ``path``, ``size``, ``local_size``, ``action`` ("unchanged", "new",
    "size_changed"), ``bytes`` to transfer, ``changes`` (ranges). An empty
    remote file is unchanged and never made locally; an empty local file is as
    good as none. Only paths and sizes are read.
    """
    size, have = F.coalesce("size", F.lit(0).cast("bigint")), F.coalesce("local_size", F.lit(0).cast("bigint"))
    joined = remote.select("path", "size").join(local.select("path", F.col("size").alias("local_size")), "path", "left")
    action = F.when(size == 0, "unchanged").when(have == 0, "new").when(have == size, "unchanged").otherwise("size_changed")
    moves = F.col("action") != "unchanged"
    return joined.withColumn("size", size).withColumn("action", action).select(
        "path", "size", "local_size", "action", F.when(moves, F.col("size")).otherwise(0).cast("bigint").alias("bytes"), moves.cast("bigint").alias("changes")
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def transfer_ranges(plan: DataFrame) -> DataFrame:
    """Compat: the whole file is one range."""
    moved = plan.where("bytes > 0")
    return moved.select("path", F.lit(0).cast("bigint").alias("start"), (F.col("size") - 1).alias("end"), F.col("bytes").alias("length"))


def chunk_table(files: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """A row for each chunk of each file's ``content``, hashed where the file is; no shuffle. Empty files have none."""
    size = F.octet_length("content")
    starts = F.sequence(F.lit(0), size - 1, F.lit(chunk_size))
    cut = files.where(size > 0).select("path", "content", F.posexplode(starts).alias("chunk_idx", "start"))
    piece = F.substring("content", F.col("start") + 1, F.lit(chunk_size))
    cut = cut.select("path", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("start").cast("bigint").alias("start"), piece.alias("piece"))
    return cut.select("path", "chunk_idx", "start", (F.col("start") + F.octet_length("piece") - 1).alias("end"), F.md5("piece").alias("md5"))


def chunk_map(chunks: DataFrame) -> DataFrame:
    """One range for each hash of a file: of equal chunks the last."""
    last = chunks.groupBy("path", "md5").agg(F.max(F.struct("start", "end")).alias("r"))
    return last.select("path", "md5", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def delta_ranges(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Contract: the byte ranges of remote files whose chunks differ from the local ones or are missing there.

    Takes chunk tables of one chunk size; neighbouring ranges are merged. A
    local file that is longer must be cut to the remote size besides.
    """
    theirs = local.select("path", "chunk_idx", F.col("md5").alias("have"))
    changed = remote.join(theirs, ["path", "chunk_idx"], "left").where(~F.col("md5").eqNullSafe(F.col("have")))
    order = Window.partitionBy("path").orderBy("chunk_idx")
    runs = changed.withColumn("run", F.col("chunk_idx") - F.row_number().over(order))
    return runs.groupBy("path", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("chunks")).drop("run")


def file_checksum(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("checksum"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """Files from chunks (``path``, ``start``, ``piece``), put together by position, for files that one value may hold.

    Larger ones are written by position (``sinks.transfer``).
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: F.hex(x["piece"]))
    return chunks.groupBy("path").agg(F.unhex(F.array_join(parts, "")).alias("content"))


def after_transfer(local: DataFrame, results: DataFrame) -> DataFrame:
    """The local state after a session: completed files have the remote size and content checks again as unchanged."""
    done = results.where("status = 'completed'").select("path", F.col("size").alias("new_size"))
    joined = local.select("path", "size").join(done, "path", "full_outer")
    return joined.select("path", F.coalesce("new_size", "size").alias("size"))
