"""Progress as a stream: the last position of each key, kept up to date."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import resume_positions


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can write: below ``spark.checkpoint.dir``, or, in local mode only, a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    named = named or tempfile.mkdtemp(prefix="tidemark-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def positions(stream: DataFrame) -> DataFrame:
    """The running last position of each key of a stream with ``key``, ``seq``, ``position``."""
    return resume_positions(stream)


def write_latest(stream: DataFrame, folder: str, available_now: bool = True):
    """Start a query that writes, for each batch, the keys whose last position changed. A batch that is run again overwrites its own part."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = positions(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put)
    return (q.trigger(availableNow=True) if available_now else q).start()


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """For each key what the last batch that had it wrote."""
    return spark.read.parquet(f"{folder}/out").groupBy("key").agg(F.max_by("position", "batch").alias("position"))


def final_positions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Run the events in ``folder``'s file ``name`` through the stream to their end."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    keyed = events.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.col("event_id").alias("position"))
    out = shared_folder(spark)
    write_latest(keyed, out).awaitTermination()
    return read_latest(spark, out)


#: So many batches' changes are read one by one before they are put together.
BATCHES_A_BASE = 16


def state_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The state (``path``, ``size``) that the batches before ``batch_id`` left: the last base, and the changes since."""
    base = batch_id // BATCHES_A_BASE * BATCHES_A_BASE
    parts = [spark.read.parquet(f"{folder}/base/{base}").withColumn("batch", F.lit(-1))] if base else []
    parts += [spark.read.parquet(f"{folder}/state/{i}").withColumn("batch", F.lit(i)) for i in range(base, batch_id)]
    if not parts:
        return spark.createDataFrame([], "path string, size bigint")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("path").agg(F.max_by("size", "batch").alias("size"))


def sync_batches(snapshots: DataFrame, plan_batch: Callable[[DataFrame, DataFrame], DataFrame], folder: str, available_now: bool = True):
    """Incremental sync: each batch of remote rows (``path``, ``size``) is planned against the state, which then has them.

    Each batch's plan and what it changed are tables in ``folder``; every
    ``BATCHES_A_BASE`` batches the changes are put together. Of several sizes of a
    path in one batch the largest counts. A batch that is run again reads the
    state before it and writes the same.
    """
    spark = snapshots.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("path").agg(F.max("size").alias("size"))
        plan_batch(new, state_before(spark, folder, batch_id)).write.mode("overwrite").parquet(f"{folder}/plan/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{folder}/state/{batch_id}")
        if (batch_id + 1) % BATCHES_A_BASE == 0:
            last = state_before(spark, folder, batch_id).withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
            last.groupBy("path").agg(F.max_by("size", "batch").alias("size")).write.mode("overwrite").parquet(f"{folder}/base/{batch_id + 1}")

    q = snapshots.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put)
    return (q.trigger(availableNow=True) if available_now else q).start()
