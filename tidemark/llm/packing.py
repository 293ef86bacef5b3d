"""Best-fit packing by length patterns and non-negative least squares.

Documents become token ids, and ids pieces of at most a sequence's length.
Only the histogram of piece lengths, which has as many entries as a sequence
has tokens, goes to the driver. There, patterns of one to three lengths that
fill a sequence are enumerated, non-negative least squares fits how often to
repeat each so that together they use up the histogram, the counts are rounded
down, and what is left is packed best-fit decreasing, by counts as well. The
work on the driver does not depend on the number of pieces. A piece finds its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import gc
import json
import operator
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, column, give_back, held, materialize, slices

#: Words whose ids a worker holds in each of two generations. Bytes of text that are looked up at a time.
CACHED_WORDS = 200_000
_AT_ONCE = 1 << 20
#: Latin letters and ASCII marks after them, else nothing, for each line.
_WORD = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|.*)$", re.M)
#: Texts whose ids must come out as the whole tokenizer's.
_PROBES = ("hello world again", "It's\t42 o'clock,  she'll say\nNO!? don't", " élan ÀÉ naïve... ß ", "a\x0bb 中文 字 x1y2 <b> --- \r\n e\u0301", "internationalization ÿ Unverträglichkeit,")


class Merges:
    """Byte-pair merges of many words at a time, as array operations.

    In each step every word that has a known pair has its first pair of the
    least rank merged, so words of one length stay of one length until they are
    done.
    """

    def __init__(self, model: dict, shown: dict[int, str]):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[shown[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size, self.none = max(vocab.values()) + 1, len(pairs)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        # A slot holds the first pair that falls in it; others, few, are found by bisection.
        slot = self._slot(keys)
        self.key, self.rank = np.full(1 << 19, -1, np.int64), np.full(1 << 19, self.none, np.int64)
        _, first = np.unique(slot, return_index=True)
        self.key[slot[first]], self.rank[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(keys.size), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_rank = np.append(keys[rest], np.iinfo(np.int64).max), np.append(rest, self.none)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.rank[slot], self.none)
        odd = np.nonzero((held != keys) & (held >= 0))
        i = np.searchsorted(self.more, keys[odd])
        out[odd] = np.where(self.more[i] == keys[odd], self.more_rank[i], self.none)
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (no empty one) as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, n in enumerate(map(len, words)):
            by.setdefault(n, []).append(i)
        for n, some in by.items():
            for a in range(0, len(some), max(1, 1_000_000 // n)):
                self._merge([words[i] for i in some[a : a + max(1, 1_000_000 // n)]], np.array(some[a : a + max(1, 1_000_000 // n)]), out)
        return out

    def _merge(self, words: list[bytes], who: np.ndarray, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while who.size:
            width = ids.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(who.size, np.int64)
            best = ranks[np.arange(who.size), at] if width > 1 else np.full(who.size, self.none)
            done = best == self.none
            if done.any():
                flat = ids[done].astype("<u4").tobytes()
                for k, i in enumerate(who[done].tolist()):
                    out[i] = flat[4 * width * k : 4 * width * (k + 1)]
                go = ~done
                ids, ranks, who, at, best = ids[go], ranks[go], who[go], at[go], best[go]
                if not who.size:
                    break
            row, stay = np.arange(who.size), np.ones((who.size, width), bool)
            stay[row, at + 1] = False
            ids = ids[stay].reshape(who.size, width - 1)
            ids[row, at] = self.made[best]
            stay = np.ones((who.size, width - 1), bool)
            stay[row, at] = False
            ranks = ranks[stay].reshape(who.size, width - 2)
            for near in (at - 1, at):
                here = np.flatnonzero((near >= 0) & (near < width - 2))
                j = near[here]
                ranks[here, j] = self._ranks(ids[here, j], ids[here, j + 1])


class WordTokenizer:
    """Token ids of texts for a byte-pair tokenizer that drops white space and joins nothing across it.

    A text's ids are those of its words between ASCII white space. The words of
    a batch are split and numbered by Arrow, each different word is looked up
    once, and the ids are gathered by the words' numbers. The letters of a new
    word of Latin letters, and marks after them that are one token group of
    their own, are merged as arrays, many words at a time; any other word goes
    through the whole tokenizer. The ids are the same either way.

    Words are held in two generations: when the young one is full it becomes
    the old one, from which what is met again is taken back.

    Other tokenizers (that keep white space, for one) raise ``ValueError``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        try:
            self.merges = Merges(model, {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)})
            alike = self([t.encode() for t in _PROBES]) == self._ids(list(_PROBES))
        except (KeyError, TypeError):
            alike = False
        if not alike:
            raise ValueError(f"{path}: not a byte-pair tokenizer that drops white space and keeps words apart")
        del model
        give_back()

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of words that are not held."""
        found = _WORD.findall(b"\n".join(new).decode("utf-8", "replace"))
        runs = list(map(str.lower, map(operator.itemgetter(0), found)))
        other = [w.decode("utf-8", "replace") for w, p in zip(new, runs, strict=True) if not p]
        fresh = list(dict.fromkeys(runs))
        if "" in fresh:
            fresh.remove("")
        letters = dict(zip(fresh, self.merges([p.encode() for p in fresh]), strict=True))
        marks = list({m for _, m in found}.difference(self.marks))
        if len(self.marks) > CACHED_WORDS:
            self.marks = {"": b""}
            marks = list({m for _, m in found} - {""})
        self.marks.update(zip(marks, self._ids(marks), strict=True))
        rest, after = iter(self._ids(other)), self.marks
        return [(letters[p] + after[m] if m else letters[p]) if p else next(rest) for p, (_, m) in zip(runs, found, strict=True)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {b"": b""}, self.words
        got = list(map(self.words.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            names = [words[i] for i in missing]
            ids = list(map(self.older.get, names))
            new = [i for i, x in enumerate(ids) if x is None]
            if new:
                for i, x in zip(new, self._learn([names[i] for i in new]), strict=True):
                    ids[i] = x
            self.words.update(zip(names, ids, strict=True))
            for i, x in zip(missing, ids, strict=True):
                got[i] = x
        return got

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings or bytes; null is empty), one after another, and where each text's begin and the last's end."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        numbered = split.flatten().dictionary_encode()
        ids = self._of_words(numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = lists.take(numbered.indices)
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[first] - taken.offsets[0].as_py() if len(taken) else np.zeros(len(texts) + 1, np.int64)

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        ids, at = self.arrays(pa.array(texts, pa.large_binary()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def tokenizer_of_process(path: str) -> WordTokenizer:
    """One tokenizer a worker process: the tasks that it runs one after another share the words, up to one that needs none."""
    gc.set_threshold(200_000, 50, 100)  # words and ids have no cycles, and come by the million
    return held((WordTokenizer, path), lambda: WordTokenizer(path))


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    A document is its ids and then ``end_id``, so none is empty; only longer
    ones than ``capacity`` are cut, and only their last piece may be shorter.
    ``tokenizer`` is the path of the file, which every machine must have.
    """
    piece = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")] + [T.StructField("ids", T.BinaryType())] * with_ids
    pieces = T.StructField("__pieces", T.ArrayType(T.StructType(piece)))
    last = np.array([end_id], "<u4").tobytes()

    def start():
        tokens = tokenizer_of_process(tokenizer)

        def step(columns):
            texts, sizes = columns[0], pc.fill_null(pc.binary_length(columns[0]), 0).to_pylist()
            starts, lengths, sums, raw, ends = [], [], [], [], [0]
            for a, b in slices(sizes, _AT_ONCE):
                ids, at = tokens.arrays(texts.slice(a, b - a))
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = y - x + 1
                    for first in range(0, n, capacity):
                        long = min(capacity, n - first)
                        own = view[4 * (x + first) : 4 * min(x + first + long, y)]
                        crc = zlib.crc32(own)
                        starts.append(first)
                        lengths.append(long)
                        sums.append(zlib.crc32(last, crc) if first + long == n else crc)
                        if with_ids:
                            raw.append(bytes(own) + last if first + long == n else bytes(own))
                    ends.append(len(starts))
            fields = [pa.array(x, pa.int64()) for x in (starts, lengths, sums)] + [pa.array(raw, pa.binary())] * with_ids
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type))).cast(kind)]

        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(pieces.dataType)
        return step

    slim = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("__text"))
    out = append_columns(slim, {"text": F.col("__text")}, [pieces], start, keep=["doc_id"])
    return out.select("doc_id", F.posexplode("__pieces").alias("piece", "p")).select("doc_id", "piece", "p.*")


def enumerate_patterns(counts: np.ndarray) -> np.ndarray:
    """All patterns of one, two and three lengths that fill a sequence, of lengths that occur: rows of lengths, 0 where none.

    ``counts[n]`` pieces have the length ``n``; the last is the capacity, whose
    square over 12 bounds the patterns.
    """
    full = counts.size - 1
    have = np.flatnonzero(counts)
    pairs = have[(have <= full - have) & (counts[full - have] > 0)]
    rows = [np.array([[full, 0, 0]]) if counts[full] else np.zeros((0, 3), int), np.stack([pairs, full - pairs, 0 * pairs], 1)]
    for a in have[have <= full // 3].tolist():
        b = have[(have >= a) & (have <= (full - a) // 2)]
        b = b[counts[full - a - b] > 0]
        rows.append(np.stack([np.full(b.size, a), b, full - a - b], 1))
    return np.concatenate(rows)


def fit_counts(counts: np.ndarray, patterns: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that make the lengths they use as near ``counts`` as can be (least squares)."""
    n, used = counts.size, patterns > 0
    target = counts.astype(float)
    times = lambda x: np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), n)
    back = lambda r: (r[patterns] * used).sum(1)
    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(times(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * np.linalg.norm(back(times(v))) or 1)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x


@dataclass
class Group:
    """``count`` sequences that are filled alike."""

    count: int
    lengths: tuple[int, ...]


def best_fit(counts: np.ndarray) -> list[Group]:
    """Best-fit decreasing, in groups of equal pieces and of equally filled sequences."""
    full = counts.size - 1
    room: dict[int, list[Group]] = {}
    for n in range(full, 0, -1):
        left = int(counts[n])
        spaces = sorted(r for r in room if r >= n)
        while left:
            if not spaces:
                room.setdefault(full, []).append(Group(-(-left // (full // n)), ()))
                spaces = [full]
            r = spaces[0]
            g, fit = room[r][-1], r // n
            take = min(g.count, left // fit) or 1
            m = min(fit, left)
            g.count -= take
            left -= take * m
            if not g.count:
                room[r].pop()
                if not room[r]:
                    del room[r]
                    spaces.pop(0)
            # The space that stays is smaller than n, or the pieces of this length are used up.
            room.setdefault(r - m * n, []).append(Group(take, g.lengths + (n,) * m))
    return [g for gs in room.values() for g in gs]


def plan(counts: np.ndarray) -> list[Group]:
    """Groups of sequences that hold ``counts[n]`` pieces of each length ``n``."""
    left, out = counts.astype(np.int64).copy(), []
    patterns = enumerate_patterns(left)
    if len(patterns):
        x = np.floor(fit_counts(left, patterns) + 1e-6).astype(np.int64)
        for i in np.argsort(-x, kind="stable")[: np.count_nonzero(x)].tolist():
            lengths = tuple(int(v) for v in patterns[i] if v)
            k = min(int(x[i]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if k > 0:
                np.subtract.at(left, list(lengths), k)
                out.append(Group(k, lengths))
    return out + best_fit(left)


class Places:
    """Where the piece of a rank among those of its length goes."""

    def __init__(self, groups: list[Group]):
        rows, used, base = [], {}, 0
        for g in groups:
            at = 0
            for n in g.lengths:
                start = used.get(n, 0)
                rows.append((n << 44 | start, base - start, at))
                used[n] = start + g.count
                at += n
            base += g.count
        self.key, self.base, self.at = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 3

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length.astype(np.int64) << 44 | rank, "right") - 1
        return self.base[i] + rank, self.at[i]


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, salt_rows: int = 5_000) -> DataFrame:
    """A row for each piece of each row of ``docs``, with ``sequence_id`` and ``offset``.

    Columns: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``; a sequence has no gaps from 0. Null and empty
    texts are a piece of ``end_id`` alone; null and repeated ids keep their
    pieces; no rows give none; long texts are cut, never shortened. Other
    columns, whatever their names, are left out. A length that very many pieces
    have is ranked in parts of about ``salt_rows``.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, tokenizer, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    places = spark.sparkContext.broadcast(Places(plan(counts)))
    # A row for each length that occurs, ``capacity`` at most: broadcast.
    parts = spark.createDataFrame([(int(n), int(counts[n]) // salt_rows + 1) for n in np.flatnonzero(counts)], "length long, parts long")
    pieces = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    before = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def start():
        def step(columns):
            length, rank = (c.to_numpy(zero_copy_only=False) for c in columns)
            return [pa.array(x) for x in places.value.find(length, rank)]

        return step

    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return append_columns(ranked, {"length": F.col("length"), "rank": F.col("rank")}, new, start).drop("rank")
