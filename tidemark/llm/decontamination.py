"""Benchmark decontamination: Wu-Manber search for benchmark windows.

Texts become sequences of words; a window of consecutive benchmark words is a
pattern. All patterns are searched at once. Over the first ``m`` bytes of the
patterns of a length class, a table says for every block of bytes how far the
search may skip before a pattern could end; only where it may not skip, the
hash of the block (the patterns' suffix) and of their first block chooses the
patterns that are then compared byte by byte. The search runs over many places
of many texts at a time ("lanes"), as array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, column, materialize, quoted, slices, utf8

#: Lower-cases A-Z and turns every other ASCII character that is no word character into a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are searched at a time, and bytes of a lane.
_AT_ONCE, _LANE = 4 << 20, 2048


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, letters and non-ASCII characters."""
    return text.translate(_TO_WORDS).split() if text else []


@dataclass
class _Class:
    """The tables for patterns of similar length."""

    m: int
    block: int
    mask: np.uint64
    bits: np.uint64
    shift: np.ndarray
    keys: np.ndarray
    ids: np.ndarray


class WuManber:
    """Finds every occurrence of every pattern: slices of ``blob``, given by start and length.

    Besides ``blob`` it holds about 40 bytes a pattern and a table of skips.
    """

    def __init__(self, blob: bytes, starts: np.ndarray, lengths: np.ndarray, block: int = 8):
        self.blob, self.starts, self.lengths = blob, starts, lengths
        self.classes: list[_Class] = []
        kind = np.frexp(lengths.astype(float))[1]
        padded = np.frombuffer(blob + bytes(8), np.uint8)
        blocks = np.ndarray((len(blob) + 1,), "<u8", padded, 0, (1,))
        for k in np.unique(kind).tolist():
            self.classes.append(self._tables(np.flatnonzero(kind == k), blocks, block))

    def _tables(self, ids: np.ndarray, blocks: np.ndarray, block: int) -> _Class:
        m = int(self.lengths[ids].min())
        block = min(block, m)
        mask = np.uint64((1 << 8 * block) - 1)
        starts = self.starts[ids]
        size = min(24, max(12, (len(ids) * (m - block + 1) * 4).bit_length()))
        bits = np.uint64(64 - size)
        shift = np.full(1 << size, min(255, m - block + 1), np.uint8)
        for j in range(m - block + 1):
            back = m - block - j
            if back <= 255:
                h = ((blocks[starts + j] & mask) * _MIX) >> bits
                np.minimum.at(shift, h, np.uint8(back))
        keys = self._key(blocks[starts] & mask, blocks[starts + m - block] & mask)
        order = np.argsort(keys, kind="stable")
        return _Class(m, block, mask, bits, shift, keys[order], ids[order])

    @staticmethod
    def _key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (first * _MIX2) ^ (last * _MIX)

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of each occurrence."""
        found_at: list[int] = []
        found: list[int] = []
        padded = np.frombuffer(text + bytes(8), np.uint8)
        blocks = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))
        for c in self.classes:
            ends = self._candidates(c, blocks, len(text))
            if not ends.size:
                continue
            key = self._key(blocks[ends - c.m] & c.mask, blocks[ends - c.block] & c.mask)
            low, high = np.searchsorted(c.keys, key, "left"), np.searchsorted(c.keys, key, "right")
            some = np.flatnonzero(high > low)
            for start, a, b in zip((ends[some] - c.m).tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                for k in range(a, b):
                    i = int(c.ids[k])
                    s = int(self.starts[i])
                    if text.startswith(self.blob[s : s + int(self.lengths[i])], start):
                        found_at.append(start)
                        found.append(i)
        return np.array(found_at, np.int64), np.array(found, np.int64)

    @staticmethod
    def _candidates(c: _Class, blocks: np.ndarray, n: int) -> np.ndarray:
        """Where the table allows no skip: the ends of the first ``m`` bytes of possible occurrences."""
        at = np.arange(c.m, n + 1, _LANE, dtype=np.int64)
        stop = np.minimum(at + _LANE, n + 1)
        out = []
        while at.size:
            step = c.shift[((blocks[at - c.block] & c.mask) * _MIX) >> c.bits].astype(np.int64)
            none = step == 0
            if none.any():
                out.append(at[none])
                step[none] = 1
            at += step
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


class WindowIndex:
    """Benchmark windows, their search tables, and the items that have each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.items = [i for i, _ in items]
        blob, at = [], 0
        found: dict[bytes, int] = {}
        starts, lengths, n_words, owned, owner = [], [], [], [], []
        for k, (_, text) in enumerate(items):
            w = words(text)
            if not w:
                continue
            line = b" " + b" ".join(w) + b" "
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
            n = min(window, len(w))
            for a, b in zip(gaps, gaps[n:], strict=False):
                i = found.setdefault(line[a : b + 1], len(starts))
                if i == len(starts):
                    starts.append(at + a)
                    lengths.append(b + 1 - a)
                    n_words.append(n)
                owned.append(i)
                owner.append(k)
            blob.append(line)
            at += len(line)
        self.n_words = np.array(n_words, np.int64)
        # The items of each window, one after another.
        order = np.argsort(np.array(owned, np.int64), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.first = np.searchsorted(np.array(owned, np.int64)[order], np.arange(len(starts) + 1))
        self.search = WuManber(b"".join(blob), np.array(starts, np.int64), np.array(lengths, np.int64))

    def owners(self, pattern: int) -> set[str | None]:
        return {self.items[k] for k in self.owner[self.first[pattern] : self.first[pattern + 1]].tolist()}

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str | None]]]:
        """For each text: its number of words, the hit word ranges (end exclusive, merged), the items found."""
        out: list[tuple[int, list[tuple[int, int]], set[str | None]]] = []
        for a, b in slices([len(t or b"") for t in texts], _AT_ONCE):
            own = [words(t) for t in texts[a:b]]
            joined = [b" " + b" ".join(w) + b" \n" for w in own]
            starts = np.cumsum([0, *map(len, joined)])
            at, pattern = self.search.find(b"".join(joined))
            by: dict[int, list[int]] = {}
            for k, doc in enumerate((np.searchsorted(starts, at, "right") - 1).tolist()):
                by.setdefault(doc, []).append(k)
            for i, w in enumerate(own):
                ks = by.get(i)
                out.append((len(w), *self._ranges(joined[i], at[ks] - starts[i], pattern[ks])) if ks else (len(w), [], set()))
        return out

    def _ranges(self, text: bytes, at: np.ndarray, pattern: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        first = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), at)
        merged: list[tuple[int, int]] = []
        for x, y in sorted(zip(first.tolist(), (first + self.n_words[pattern]).tolist(), strict=True)):
            if merged and x <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
            else:
                merged.append((x, y))
        return merged, set().union(*map(self.owners, set(pattern.tolist())))


def _item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of at most ``block_bytes`` of text (or one item), each read by its own job."""
    slim = items.select(column(items, item_id).cast("string").alias("i"), column(items, item_text).alias("t")).where("t IS NOT NULL")
    total = slim.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes))
    if n == 1:
        return [slim]
    slim = materialize(slim.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))), "items")
    return [slim.where(F.col("b") == k).select("i", "t") for k in range(n)]


def annotate_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    min_share: tuple[int, int] = (1, 20),
    block_bytes: int = 8 << 20,
    prefix: str = "",
) -> DataFrame:
    """Every row of ``docs``, with what it shares with the benchmark ``items``.

    Adds ``n_words`` and ``n_hit`` (words inside any occurrence of a window of
    ``window`` item words), ``n_items``, ``items`` (their ids as strings,
    sorted), ``items_sha256`` and ``contaminated`` (a hit, and hits in at least
    ``min_share`` of the words), and ``hit_ranges`` (of words, end exclusive), each
    name after ``prefix``. Columns of these names are replaced.

    The search tables go to the executors whole: items are taken in blocks of
    about ``block_bytes`` of text, whose size is measured first. More than one
    block means one pass over the documents for each, written between passes.

    Null or empty texts have no words and are clean; items that are null or
    have no words have no window; items without an id are searched for like
    others and count as one item, which is a null at the end of ``items``; equal
    items and repeated rows count by their ids; an empty benchmark leaves
    everything clean, and no documents give no rows; texts of any length are
    searched whole.
    """
    spark = docs.sparkSession
    blocks = _item_blocks(items, item_id, item_text, block_bytes)
    ranges = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    n_words, hit_ranges, found_items = (f"{prefix}{n}" for n in ("n_words", "hit_ranges", "items"))
    found = [T.StructField(n_words, T.LongType()), T.StructField(hit_ranges, ranges), T.StructField(found_items, T.ArrayType(T.StringType()))]
    out = docs.drop(hit_ranges, found_items)
    for k, block in enumerate(blocks):
        index = spark.sparkContext.broadcast(WindowIndex([(r.i, r.t.encode("utf-8", "surrogatepass")) for r in block.collect()], window))
        inputs = {"text": column(docs, text)} | ({"ranges": F.col(hit_ranges), "items": F.col(found_items)} if k else {})

        def start(index=index):
            def step(columns):
                got = index.value.hits(utf8(columns[0]))
                if len(columns) > 1:
                    earlier = zip(columns[1].to_pylist(), columns[2].to_pylist(), strict=True)
                    got = [(n, _union([*r, *((x["a"], x["b"]) for x in r0)]), i | set(i0)) for (n, r, i), (r0, i0) in zip(got, earlier, strict=True)]
                return [[g[0] for g in got], [[{"a": a, "b": b} for a, b in g[1]] for g in got], [sorted(g[2] - {None}) + [None] * (None in g[2]) for g in got]]

            return step

        out = append_columns(out, inputs, found, start)
        if k < len(blocks) - 1:
            out = materialize(out, "contamination")
    hit = F.aggregate(hit_ranges, F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    num, den = min_share
    new = {
        "n_hit": hit,
        "n_items": F.size(found_items).cast("long"),
        "items_sha256": F.sha2(F.array_join(found_items, ","), 256),
        "contaminated": (hit > 0) & (hit * den >= F.col(n_words) * num),
    }
    return out.withColumns({f"{prefix}{k}": c for k, c in new.items()})


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns only, whatever their names.

    Rows are judged one by one, so repeated ones go or stay together; null and
    empty texts stay; no benchmark keeps all, no documents give none.
    """
    marked = annotate_contamination(docs, items, prefix="__c_", **options)
    return marked.where("NOT __c_contaminated").select(*[F.col(quoted(c)) for c in docs.columns])
