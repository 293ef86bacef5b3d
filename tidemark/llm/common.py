"""Helpers that the operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: About as many bytes of a batch are worked on at a time.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, where
    there is one machine, a temporary folder is chosen if that is unset;
    elsewhere it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so neither a lost executor nor a second reader makes
    Spark compute ``df`` again.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def name_of(df: DataFrame, name: str) -> str:
    """The column of ``df`` that Spark means by ``name``, as it is spelled there; an error if there is none or more than one."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [c for c in df.columns if c == name or not exact and c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} column {name!r} among {df.columns}")
    return found[0]


def column(df: DataFrame, name: str) -> Column:
    """The column that ``name_of`` finds."""
    return F.col(quoted(name_of(df, name)))


def quoted(name: str) -> str:
    """A name as Spark reads it whatever its characters."""
    return f"`{name.replace('`', '``')}`"


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each of ``stems`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a detour over ``str``."""
    return column.cast(pa.binary()).to_pylist()


#: What a worker process holds from one task to the next, and what of it the task at hand has asked for.
_HELD: dict[object, object] = {}
_ASKED: set[object] = set()


def held(key: object, make: Callable[[], object]) -> object:
    """``make()``, held by this process for as long as its tasks ask for ``key`` when they start."""
    if key not in _HELD:
        _HELD[key] = make()
    _ASKED.add(key)
    return _HELD[key]


def begin(start: Callable[[], object]) -> object:
    """``start()``; what earlier tasks of this process held and it does not ask for is dropped.

    Spark gives a worker to one stage after another, and what one has put in
    memory would stay beside what the next needs.
    """
    _ASKED.clear()
    step = start()
    if stale := _HELD.keys() - _ASKED:
        for key in stale:
            del _HELD[key]
        give_back()
    return step


def give_back() -> None:
    """Return memory that is free in this process to the system, where it can be."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_schema(fields: list[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])


def append_columns(
    df: DataFrame,
    inputs: dict[str, Column],
    fields: list[T.StructField],
    start: Callable[[], Callable[[list[pa.Array]], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """All columns of ``df`` (or those in ``keep``) and, after them, ``fields`` computed from ``inputs``.

    ``start`` runs once a task and gives a function from the input columns of
    a batch to the new columns. A column of ``df`` that bears the name of a new
    one (upper or lower case alike) is replaced. Rows stay where they are: no
    shuffle.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    # Inside, columns go by number: not all names can be passed to Python.
    work = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], *[c.alias(f"in{i}") for i, c in enumerate(inputs.values())])
    own = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(kept, work.schema.fields, strict=False)]
    schema = T.StructType([*own, *fields])
    n, types = len(kept), arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = begin(start)
        for whole in batches:
            # Rows become Python objects a part of a batch at a time.
            rows = max(1, whole.num_rows * PART_BYTES // max(PART_BYTES, whole.nbytes))
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                out = step([batch.column(n + i) for i in range(batch.num_columns - n)])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*kept, *types.names])
                del batch, out, arrays
            del whole
        del step
        give_back()

    return work.mapInArrow(run, schema)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` or that hold one row."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)
