"""Secret scans with an incremental blob ledger.

Every historical version of every path has a content address (the SHA-256 of
its UTF-8 bytes). A ledger holds the (blob, rule version) pairs that have been
scanned, with what was found. A run scans each blob that some version has and
the ledger lacks once, however many versions share it, and joins the findings
of all blobs, old and new, back to all versions. ``Ledger`` keeps the ledger in
a shared folder from run to run.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import append_columns, column, free_names, materialize, name_of, quoted


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which they are listed, then those added.
RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")
#: Findings of at most this size, estimated from their number, are joined by broadcast.
BROADCAST_BYTES = 32 << 20

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A digest of the rules: other rules are another version, whose pairs the ledger has not."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _quick(rule: Rule) -> re.Pattern:
    """The rule's pattern; a run of one class of characters is only tried where it is long enough."""
    if rule.group == 0 and rule.pattern.endswith("]+"):
        head = re.fullmatch(r"([A-Za-z_]*)(\[[^\]]*\])\+", rule.pattern)
        if head:
            return re.compile(f"{head[1]}{head[2]}{{{rule.least - len(head[1])},}}")
    return re.compile(rule.pattern)


def scanner(rules: tuple[Rule, ...] = RULES):
    """A function from a text to its spans (kind, start, end) in code points, by start, then by the order of rules."""
    ready = [(i, r, _quick(r)) for i, r in enumerate(rules)]

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        found = []
        for i, r, p in ready:
            for m in p.finditer(text or ""):
                if len(m[r.group]) >= r.least:
                    found.append((m.start(), i, m.end(), r.kind))
        return [(kind, a, b) for a, _, b, kind in sorted(found)]

    return scan


def _address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def reduced(ledger: DataFrame) -> DataFrame:
    """A ledger's rows, each (blob, rule version) once: a pair that was written again has the same findings."""
    return ledger.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


class Ledger:
    """A ledger in a folder that all machines share: ``blob``, ``rule_version``, ``spans``.

    Every run adds a table of its own. A table counts once it is complete, so a
    run that was lost leaves nothing behind that is read; a run that is repeated
    may write pairs again, which readers reduce to one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def tables(self) -> list[str]:
        """The complete tables."""
        fs, path = self._files()
        found = [str(f.getPath()) for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(f for f in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def _read(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(*tables) if tables else self.spark.createDataFrame([], LEDGER)

    def read(self) -> DataFrame:
        """All rows, each pair once."""
        return reduced(self._read(self.tables()))

    def append(self, rows: DataFrame) -> DataFrame:
        """Writes ``rows`` as a table of their own and reads them back."""
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.select(*LEDGER.fieldNames()).write.parquet(path)
        return self._read([path])

    def compact(self) -> None:
        """One table in place of all there are; if it is broken off, pairs are written twice at most."""
        old = self.tables()
        if len(old) > 1:
            self.append(reduced(self._read(old)))
            fs, _ = self._files()
            for path in old:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def scan_versions(
    versions: DataFrame,
    ledger: DataFrame | Ledger | None = None,
    *,
    key: list[str],
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Findings for every version, and the ledger's new rows.

    ``versions`` has a row for each version of each path, identified by the
    columns ``key``. The first result has ``key``, ``blob`` and ``spans`` (an
    array of kind, start, end; end exclusive, in code points) for every row;
    the second has ``blob``, ``rule_version`` and ``spans`` for the blobs that
    were scanned now. They have been added to a ``Ledger``; who keeps a
    DataFrame with these columns appends them.

    Text is shuffled once, and of equal blobs one a map task: each task keeps
    the first before the shuffle; what the ledger has is found by addresses
    alone. A null text is the empty blob; null or repeated keys and rows each
    keep their row; no versions give no rows; whole texts are scanned, however
    long; a pair that the ledger holds twice counts once. Keys may have any
    names and come back as they are; columns that are no key are left out.
    """
    keys = versions.select(*[column(versions, k) for k in key])
    a, b, t = free_names(keys, "__blob", "__spans", "__text")
    named = versions.select(*[column(versions, k) for k in key], F.coalesce(column(versions, text), F.lit("")).alias(t)).withColumn(a, _address(F.col(t)))
    found, fresh = _with_spans(named, a, t, b, ledger, rules)
    return found.select(*[F.col(quoted(k)) for k in keys.columns], F.col(a).alias("blob"), F.col(b).alias("spans")), fresh


def _unseen(blobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of ``blobs`` whose address (column ``b``) the ledger lacks; their texts are moved only if many are new."""
    new = materialize(blobs.select("b").distinct().join(ledger.select(F.col("blob").alias("b")).distinct(), "b", "left_anti"), "unseen")
    # By broadcast only if they are few, which is measured.
    return blobs.join(F.broadcast(new) if 100 * new.count() <= BROADCAST_BYTES else new, "b", "left_semi")


def _with_spans(named: DataFrame, address: str, text: str, spans: str, ledger: DataFrame | Ledger | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """``named`` (with its texts and their addresses) and ``spans``; and the ledger's new rows."""
    now, kind = rule_version(rules), to_arrow_type(T.ArrayType(SPAN))
    blobs = named.select(F.col(address).alias("b"), F.col(text).alias("t"))
    had = None
    if ledger is not None:
        had = reduced((ledger.read() if isinstance(ledger, Ledger) else ledger).where(F.col("rule_version") == now).select("blob", "rule_version", "spans"))
        if isinstance(ledger, DataFrame) or ledger.tables():
            blobs = _unseen(blobs, had)
    blobs = blobs.groupBy("b").agg(F.first("t").alias("t"))

    def start():
        scan = scanner(rules)

        def step(columns):
            return [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)] for t in columns[0].to_pylist()], type=kind)]

        return step

    scanned = append_columns(blobs, {"text": F.col("t")}, [T.StructField("spans", T.ArrayType(SPAN))], start)
    scanned = scanned.select(F.col("b").alias("blob"), F.lit(now).alias("rule_version"), "spans")
    fresh = ledger.append(scanned) if isinstance(ledger, Ledger) else materialize(scanned, "ledger")
    every = fresh if had is None else fresh.unionByName(had)
    # Only what has findings is joined by its spans; a blob with very many versions is one row on this side.
    hits = every.where(F.size("spans") > 0).select(F.col("blob").alias(address), F.col("spans").alias(spans))
    # By broadcast only if that is small, which is measured.
    n, total = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()
    small = 100 * n + 60 * total <= BROADCAST_BYTES
    found = named.join(F.broadcast(hits) if small else hits, address, "left")
    return found.withColumn(spans, F.coalesce(spans, F.array().cast(T.ArrayType(SPAN)))), fresh


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mark``; spans are sorted by start."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s, x):
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def redact(versions: DataFrame, ledger: DataFrame | Ledger | None = None, *, text: str = "text", n_chars: str | None = None, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``versions`` with every secret in ``text`` replaced by ``mark``, and the ledger's new rows.

    All rows and columns stay, repeated rows too, in the columns' order and
    under their names; a null text stays null; no rows give none. Overlapping
    spans are masked as one. ``n_chars`` names a column that holds the text's
    length and is to follow. Names are found as Spark finds them (upper or lower
    case alike, unless the session says otherwise); one that fits no column or
    several is an error.
    """
    text, n_chars = name_of(versions, text), n_chars and name_of(versions, n_chars)
    t, a, b, m = free_names(versions, "__text", "__blob", "__spans", "__masked")
    named = versions.withColumn(t, F.coalesce(F.col(quoted(text)), F.lit(""))).withColumn(a, _address(F.col(t)))
    found, fresh = _with_spans(named, a, t, b, ledger, rules)
    hit = F.size(b) > 0
    found = found.withColumn(m, F.when(hit, masked(F.col(t), F.col(b), mark)).otherwise(F.col(quoted(text))))
    new = {text: F.col(m)} | ({n_chars: F.when(hit, F.length(m).cast("long")).otherwise(F.col(quoted(n_chars)))} if n_chars else {})
    return found.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in versions.columns]), fresh
