"""SimHash near-duplicates: anchor-point covering with a Hamming code.

A pair of 64-bit fingerprints that differ in at most three bits differs in at
most one bit of one half. The 31-bit words that stand for a half are covered by
the Hamming code of that length: each word has exactly one code word (its home
anchor) within one bit. A fingerprint is sent to its home anchor and, as a
visitor, to every anchor within two bits (covering radius plus the threshold of
a half), at most 16 a half. Of a linked pair, each one visits the home of the
other. At an anchor, the homes are compared with all visitors.

Nothing grows with the square of a group: equal texts are one fingerprint, each
anchor reports a spanning forest of its links and not the pairs. At an anchor
with many homes, fingerprints meet under finer keys: the other half is cut into
six blocks, and as three bits differ at most, three blocks are alike, so each
choice of three blocks is a key. Only fingerprints that are alike in all this and
still very many are compared all with all, homes dealt out and visitors repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, column, free_names, materialize, name_of, quoted, shuffle_partitions, utf8

#: Differing bits at which fingerprints link; homes of an anchor compared by one task at a time.
THRESHOLD, HOMES_AT_ONCE = 3, 1024
#: Shingles whose hashes are held as single bits at a time, and compared pairs.
_BITS_AT_ONCE, _PAIRS_AT_ONCE = 1 << 16, 1 << 21


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text over shingles of words, repeats included.

    Words are what stands between ASCII white space, with A-Z lower-cased. A
    text of fewer words is one shingle; one without words has the fingerprint 0.
    """
    w = text.lower().split() if text else []
    if not w:
        return 0
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), max(1, len(w) - shingle + 1)
    for a in range(0, n, _BITS_AT_ONCE):
        part = w[a : a + _BITS_AT_ONCE + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(part) >= shingle else [part]
        raw = np.frombuffer(b"".join([digest(b" ".join(g), 42) for g in grams]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes, as a signed long; 0 of none. Bits are in the order that the numbers have in memory."""
    ones = np.zeros(64, np.int64)
    for a in range(0, hashes.size, _BITS_AT_ONCE):
        ones += np.unpackbits(hashes[a : a + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint as a (signed) long. A null text has the fingerprint 0."""

    def start():
        def step(columns):
            return [np.array([fingerprint(t, shingle) for t in utf8(columns[0])], np.uint64).view(np.int64)]

        return step

    return append_columns(docs, {"text": column(docs, text)}, [T.StructField(name, T.LongType())], start)


def _code() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the bit that leads home, and the pairs of bits that lead to the other anchors within two bits.

    Bit ``p - 1`` of a word has the position ``p``; the syndrome of a word is
    the exclusive or of its set positions, and code words have the syndrome 0.
    """
    home, others = np.zeros(32, np.uint32), np.zeros((32, 15), np.uint32)
    for s in range(1, 32):
        home[s] = 1 << (s - 1)
        others[s] = [1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 32) if p < p ^ s]
    return home, others


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape, np.uint32)
    for p in range(1, 32):
        out ^= np.where(words >> np.uint32(p - 1) & np.uint32(1), np.uint32(p), np.uint32(0))
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, index of the fingerprint, and whether it is a visitor, for all fingerprints at all their anchors."""
    home, others = _code()
    at, who, visits = [], [], []
    index = np.arange(fps.size)
    for half in (0, 1):
        word = (fps.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = _syndrome(word)
        off = np.flatnonzero(s)
        near = (word[off, None] ^ others[s[off]]).ravel()
        nearest = word ^ home[s]
        key = np.concatenate([nearest, nearest, near]).astype(np.int64) | half << 32
        at.append(key)
        who.append(np.concatenate([index, index, np.repeat(off, 15)]))
        visits.append(np.concatenate([np.zeros(fps.size, np.int8), np.ones(key.size - fps.size, np.int8)]))
    return np.concatenate(at), np.concatenate(who), np.concatenate(visits)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a in range(0, fps.size, 4096):
            part = fps[a : a + 4096]
            at, who, visits = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[who]), pa.array(visits)], names=["anchor", "fp", "visits"])


class _Anchor:
    """One anchor's homes, and the forest of the links found so far."""

    def __init__(self):
        self.homes = np.zeros(0, np.int64)
        self.over: list[int] = []

    def _top(self, i: int) -> int:
        while self.over[i] != i:
            self.over[i] = i = self.over[self.over[i]]
        return i

    def add(self, fps: np.ndarray, visits: bool, threshold: int) -> list[tuple[int, int]]:
        """Links of ``fps`` to the homes: enough of them to keep together what is linked."""
        edges: list[tuple[int, int]] = []
        if not visits:
            self.over += range(len(self.over), len(self.over) + fps.size)
            self.homes = np.concatenate([self.homes, fps])
        homes = self.homes.view(np.uint64)
        step = max(1, _PAIRS_AT_ONCE // max(1, homes.size))
        for a in range(0, fps.size, step):
            part = fps[a : a + step]
            near = np.bitwise_count(part.view(np.uint64)[:, None] ^ homes[None, :]) <= threshold
            linked = np.flatnonzero(near.any(1))
            first = near[linked].argmax(1)
            edges += [(x, y) for x, y in zip(part[linked].tolist(), self.homes[first].tolist(), strict=True) if x != y]
            row, other = np.nonzero(near[linked])
            for pair in np.unique(first[row] * homes.size + other).tolist():
                i, j = map(self._top, divmod(pair, homes.size))
                if i != j:
                    self.over[j] = i
                    edges.append((int(self.homes[i]), int(self.homes[j])))
        return edges


def _links(threshold: int):
    """Rows sorted by anchor, part and role to links; an anchor may reach over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, _Anchor()
        for batch in batches:
            at, part, visits, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1
            if not at.size:
                continue
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [at.size]])
            n_homes = np.add.reduceat((visits == 0).astype(np.int64), starts)
            # A home always visits its own anchor: with one home, two rows say nothing.
            busy = (n_homes > 0) & (ends - starts > 2)
            edges: list[tuple[int, int]] = []
            busy[[0, -1]] = True
            for g in np.flatnonzero(busy).tolist():
                a, b, h = int(starts[g]), int(ends[g]), int(n_homes[g])
                if (now := (int(at[a]), int(part[a]))) != key:
                    key, anchor = now, _Anchor()
                if h:
                    edges += anchor.add(fps[a : a + h], False, threshold)
                if b > a + h and anchor.homes.size:
                    edges += anchor.add(fps[a + h : b], True, threshold)
            if edges:
                x = np.unique(np.sort(np.array(edges, np.int64), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return run


def links(nodes: DataFrame, homes_at_once: int = HOMES_AT_ONCE) -> DataFrame:
    """Links between the distinct fingerprints in column ``fp``: columns ``a`` and ``b``.

    Not all pairs within the threshold, but enough that what they connect is
    connected. Every fingerprint, however many share an anchor, is compared.
    """
    spark = nodes.sparkSession
    sent = nodes.select("fp").mapInArrow(_to_anchors, "anchor long, fp long, visits byte")
    crowded, few = _crowded(sent, ["anchor"], homes_at_once)
    if crowded is None:
        dealt = sent.select("anchor", F.lit(0).cast("long").alias("part"), "visits", "fp")
    else:
        marked = sent.join(F.broadcast(crowded) if few else crowded, "anchor", "left")
        plain = marked.where("parts IS NULL").select("anchor", F.lit(0).cast("long").alias("part"), "visits", "fp")
        other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
        keys = F.array(*[F.xxhash64(F.lit(i), other.bitwiseAND(F.lit(m))) for i, m in enumerate(_choices())])
        fine = marked.where("parts IS NOT NULL").select("anchor", F.explode(keys).alias("part"), "visits", "fp")
        still, few = _crowded(fine, ["anchor", "part"], homes_at_once)
        if still is not None:
            fine = fine.join(F.broadcast(still) if few else still, ["anchor", "part"], "left")
            mine = F.when(F.col("visits") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
            fine = fine.select("anchor", "part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(mine)).alias("slice"), "visits", "fp")
            fine = fine.select("anchor", F.when(F.col("slice") == 0, F.col("part")).otherwise(F.xxhash64("part", "slice")).alias("part"), "visits", "fp")
        dealt = plain.unionByName(fine)
    n = 2 * shuffle_partitions(spark)
    dealt = dealt.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", "visits")
    return dealt.mapInArrow(_links(THRESHOLD), "a long, b long").distinct()


def _choices() -> list[int]:
    """The bits of each three of the six blocks of a half."""
    bounds = [0, 6, 12, 17, 22, 27, 32]
    blocks = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, 3)]


def _crowded(sent: DataFrame, key: list[str], homes_at_once: int) -> tuple[DataFrame | None, bool]:
    """The keys with more homes than are compared at once and in how many parts they are dealt (none: nothing), and whether they are few enough to be broadcast."""
    found = sent.where("visits = 0").groupBy(*key).count().where(F.col("count") > homes_at_once)
    found = materialize(found.select(*key, F.ceil(F.col("count") / homes_at_once).cast("int").alias("parts")), "crowded")
    n = found.limit(10_001).count()
    return (found if n else None), n <= 10_000


def components(edges: DataFrame) -> DataFrame:
    """The connected components of ``edges`` (``a``, ``b``): columns ``node`` and ``root``.

    Rounds of contraction: each node is merged into the neighbour (or itself)
    that comes first in an order drawn anew each round, the edges are rewritten
    and those within a merged node go. Some constant share of the edges goes in
    each round on average, whatever the shape. At the end the merges are
    composed, last round first.
    """
    edges, rounds = materialize(edges.where("a <> b"), "edges"), []
    while not edges.isEmpty():
        k = len(rounds)
        both = edges.union(edges.select("b", "a"))
        first = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))
        merged = both.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("m"))
        merged = merged.select("node", F.least(F.col("m"), first("node"))["n"].alias("into"))
        merged = materialize(merged, "merged")
        rounds.append(merged)
        x = edges.join(merged.withColumnsRenamed({"node": "a", "into": "x"}), "a").join(merged.withColumnsRenamed({"node": "b", "into": "y"}), "b")
        edges = materialize(x.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].withColumnRenamed("into", "root")
    for merged in reversed(rounds[:-1]):
        later = roots.withColumnsRenamed({"node": "into", "root": "later"})
        roots = merged.join(later, "into", "left").select("node", F.coalesce("later", "into").alias("root"))
        roots = materialize(roots, "roots")
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp`` and ``component_id``.

    Fingerprints that differ in at most three bits link; the component's id is
    the smallest doc_id that can be reached over links, its own included.

    Null and empty texts have the fingerprint 0 and link like any other. Null
    ids are ignored for the smallest id (a component of nulls has a null id);
    repeated ids and rows are kept; an empty table gives no rows; other columns
    are left out; whole texts count, however long.
    """
    slim = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    return _grouped(slim, shingle).select("doc_id", "fp", "component_id")


def with_roots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The same groups, for ``keep_one_each``: ``doc_id``, ``text_hash`` and ``root`` of each row."""
    slim = docs.select(column(docs, doc_id).alias("doc_id"), F.xxhash64(column(docs, text)).alias("text_hash"), column(docs, text).alias("text"))
    return _grouped(slim, shingle).select("doc_id", "text_hash", "root")


def _grouped(slim: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``slim`` but for the text, and ``fp``, ``root`` and ``component_id``."""
    prints = materialize(with_fingerprint(slim, shingle=shingle).drop("text"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    member = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    # A root with few fingerprints is the rule, yet one may have very many: only linked ones are joined.
    linked = member.join(roots.select("root").distinct(), "root", "left_semi").join(least, "root").select("fp", "root", "component_id")
    single = member.join(roots.select("root").distinct(), "root", "left_anti").select("fp", "root", F.col("least").alias("component_id"))
    of = materialize(linked.unionByName(single), "components")
    return prints.join(of, "fp")


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, find: Callable[..., DataFrame] = with_roots) -> DataFrame:
    """The rows of ``docs`` but for the near-duplicates that ``find`` groups: of each group, the row with the smallest id stays.

    Rows are told apart by id and text: an id may be in several groups with
    different texts, and each group keeps its own. Rows of one id and text are
    repeated rows, and one of them stays. Rows whose id is null stay: nothing
    tells them apart. Null and empty texts are a group of their own; no rows
    give none; all columns stay, whatever their names.
    """
    found = materialize(find(docs, doc_id, text, shingle).where("doc_id IS NOT NULL").select("doc_id", "text_hash", "root"), "groups")
    row = F.struct("doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(row).alias("first"))
    gone_id, gone_text = free_names(docs, "__gone", "__text")
    key = [F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)]
    doc_id, text = name_of(docs, doc_id), name_of(docs, text)
    gone = found.join(first, "root").where(row != F.col("first")).select(*key).distinct()
    twice = materialize(found.groupBy("doc_id", "text_hash").count().where("count > 1").select(*key), "repeated")
    same = (F.col(quoted(doc_id)) == F.col(gone_id)) & (F.xxhash64(F.col(quoted(text))) == F.col(gone_text))
    kept = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(twice, same, "left_anti").unionByName(once)
