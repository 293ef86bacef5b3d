"""Toxicity by compression distance.

There are two zstandard dictionaries, of ordinary and of toxic text. A document
is read in overlapping windows of words. A window is compressed with the
ordinary dictionary, and with the ordinary and the toxic one together; how many
bytes the toxic one saves is held against several thresholds, and how many
windows pass each is turned into a probability by a logistic model that is
calibrated on labelled documents.

The ordinary dictionary is trained by zstandard. The toxic one is not: toxic
documents consist of ordinary prose for the most part, and dictionaries trained
on their windows, whole or selected, miss many of them (the README has figures).
It holds instead the pieces of their distinctive words, those with runs of
characters that many more toxic than ordinary documents have. Ordinary prose
costs the same on both sides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, column, free_names, quoted, utf8

GRAM = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Saved bytes at which a window counts, for each of the model's counts.
THRESHOLDS = (2, 3, 4, 5)


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample that is fitted on, and sizes of windows and dictionaries.

    The sample is the labelled rows whose hashed ids come first, at most
    ``toxic_rows`` and ``ordinary_rows`` of them, from those of at most
    ``row_bytes`` bytes; the ordinary dictionary is trained on the
    ``row_windows`` windows of each ordinary one whose hashes come first. This
    bounds the driver's memory; scoring reads all. A run of characters counts as
    typical from ``least_docs`` toxic texts and odds of e to the ``least_odds``
    on, a word with such a run from ``least_words`` occurrences on.
    """

    toxic_rows: int = 2000
    ordinary_rows: int = 4000
    row_bytes: int = 32_768
    row_windows: int = 16
    window: int = 8
    hop: int = 4
    ordinary_bytes: int = 20_000
    toxic_bytes: int = 6_000
    least_docs: int = 4
    least_odds: float = 2.5
    least_words: int = 3


def windows(text: bytes | None, window: int, hop: int) -> list[bytes]:
    """Windows of ``window`` words every ``hop`` words, to the end of the text; at least one."""
    w = text.lower().split() if text else []
    n = max(1, -(-(len(w) - window) // hop) + 1) if w else 1
    return [b" " + b" ".join(w[i * hop : i * hop + window]) + b" " for i in range(n)]


def _compressor(content: bytes):
    params = zstd.ZstdCompressionParameters(
        window_log=16, chain_log=16, hash_log=16, search_log=6, min_match=6, target_length=32,
        strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))


def _joined(samples: list[bytes], size: int) -> bytes:
    """Of the different samples as many of the most frequent as fit, the most frequent last, where they cost least."""
    out, left = [], size
    for x, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        if len(x) <= left:
            out.append(x)
            left -= len(x)
    return b"".join(reversed(out))


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on ``samples`` in the order of hashes; of few samples, they themselves."""
    if sum(map(len, samples)) > 4 * size:
        samples = [x for _, x in sorted((zlib.crc32(b"%d " % i + x), x) for i, x in enumerate(sorted(samples)))]
        try:
            return zstd.train_dictionary(size + size // 4, samples, k=32, d=6).as_bytes()[-size:]
        except zstd.ZstdError:
            pass
    return _joined(samples, size)


def _plain(text: bytes) -> list[str]:
    """Words as windows have them (only A-Z lower-cased), as characters."""
    return text.lower().decode("utf-8", "replace").split()


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``GRAM`` characters, and whether it lies in one word (but for a space at either end)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, c.size - GRAM + 1)
    key, inside = c[:n], np.ones(n, bool)
    for i in range(1, GRAM):
        key = key * _MIX + c[i : n + i]
        if i < GRAM - 1:
            inside &= c[i : n + i] != 32
    return key ^ key >> np.uint64(29), inside


def _own(text: bytes) -> np.ndarray:
    """The different runs of characters in a text's words."""
    key, inside = _grams(f" {' '.join(_plain(text))} ")
    return np.unique(key[inside])


def _docs_with(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of characters in words, and how many texts have each; put together some texts at a time."""
    grams, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), 250):
        new, m = np.unique(np.concatenate([_own(t) for t in texts[i : i + 250]]), return_counts=True)
        grams, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, m]), grams.size).astype(np.int64)
    return grams, n


def distinctive(toxic: list[bytes], ordinary: list[bytes], s: Settings) -> list[bytes]:
    """Pieces of words that are typical of toxic texts, as often as they occur: what the toxic dictionary holds.

    A run of five characters is typical if it is in ``least_docs`` toxic texts or more, after
    as many different words and a fifth of its texts at least (a passage that
    many texts repeat is no sign), with odds above ``least_odds``, and if that is no chance: the likelihood ratio
    statistic must exceed what the likeliest of so many grams would have.
    """
    grams, a = _docs_with(toxic)
    n0, n1 = len(ordinary), len(toxic)
    base, chance = np.log((n1 + 1) / (n0 + 1)), 2 * np.log(max(2, grams.size)) + 4
    grams, a = grams[a >= s.least_docs], a[a >= s.least_docs]
    b = np.zeros(grams.size, np.int64)
    for t in ordinary if grams.size else ():
        own = _own(t)
        at = np.minimum(np.searchsorted(grams, own), grams.size - 1)
        b[at[grams[at] == own]] += 1
    e = (a + b) * n1 / (n0 + n1)
    evidence = 2 * (a * np.log(a / e) + b * np.log(np.maximum(b, 1) / (a + b - e)))
    able = (np.log((a + 0.5) / (b + 0.5)) - base > s.least_odds) & (evidence > chance)
    grams, a = grams[able], a[able]
    words = sorted({w for t in toxic for w in _plain(t)})
    hot: dict[str, list[tuple[int, int]]] = {}
    for i in range(0, len(words), 20_000):
        some = words[i : i + 20_000]
        key, inside = _grams("".join(f" {w} " for w in some))
        place = np.flatnonzero(inside & np.isin(key, grams))
        first = np.cumsum([0, *(len(w) + 2 for w in some)])
        which = np.searchsorted(first, place, "right") - 1
        for k, j, p in zip(key[place].tolist(), which.tolist(), (place - first[which]).tolist(), strict=True):
            hot.setdefault(some[j], []).append((p, k))
    # Only words with such a run are counted, each with the word before it.
    pairs = Counter((before, w) for t in toxic for own in [_plain(t)] for before, w in zip(["", *own], own, strict=False) if w in hot)
    after: dict[int, set[str]] = {k: set() for k in grams.tolist()}
    for before, word in pairs:
        for _, k in hot[word]:
            after[k].add(before)
    stay = {k for k, n in zip(grams.tolist(), a.tolist(), strict=True) if len(after[k]) >= max(s.least_docs, n / 5)}
    runs: Counter = Counter()
    for (_, word), n in pairs.items():
        w, end, begin = f" {word} ", -1, 0
        for i in sorted(i for i, k in hot.get(word, ()) if k in stay):
            if i >= end:
                if end > 0:
                    runs[w[begin:end]] += n
                begin = i
            end = i + GRAM
        if end > 0:
            runs[w[begin:end]] += n
    return [r.encode() for r, n in sorted(runs.items()) if n >= s.least_words for _ in range(n)]


@dataclass
class Model:
    """The dictionaries' contents and the calibration. ``prior`` is the score where nothing could be learned."""

    settings: Settings
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0

    def features(self, texts: Iterable[bytes | None]) -> np.ndarray:
        """For each text: what the toxic dictionary saves in its best windows (6 bytes count in each at most), and how many windows, and which share, pass each threshold."""
        plain, both = _compressor(self.ordinary).compress, _compressor(self.ordinary + self.toxic).compress
        out = []
        for t in texts:
            saved = np.array([len(plain(w)) - len(both(w)) for w in windows(t, self.settings.window, self.settings.hop)])
            most = np.minimum(np.sort(saved)[::-1][:4], 6)
            over = (saved[:, None] >= np.array(THRESHOLDS)).sum(0)
            out.append([most[0], most[:2].mean(), most.mean(), *np.log1p(over), *(over[:3] / saved.size)])
        return np.array(out, float).reshape(len(out), 6 + len(THRESHOLDS))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.weights.size:
            return np.full(len(texts), self.prior)
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def dictionaries(rows: list[tuple[bytes, int]], s: Settings = Settings()) -> Model:
    """A model from labelled texts that is not calibrated yet. The rows' order is of no account. Without rows of both classes, every score is the share of toxic rows (0 if none)."""
    toxic, ordinary = sorted(t for t, y in rows if y), sorted(t for t, y in rows if not y)
    if not toxic or not ordinary:
        return Model(s, prior=float(bool(toxic)))
    first = lambda each: sorted(each, key=lambda w: (zlib.crc32(w), w))[: s.row_windows]
    sample = [w for t in ordinary for w in first(windows(t, s.window, s.window))]
    return Model(s, _trained(sample, s.ordinary_bytes) or b" " * 8, _joined(distinctive(toxic, ordinary, s), s.toxic_bytes))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, stands_for: tuple[float, float] = (1, 1)) -> Model:
    """The model with the logistic weights that fit its features ``x`` to labels; an ordinary and a toxic row stand for so many."""
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order].astype(float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    r = np.where(y > 0, stands_for[1], stands_for[0])
    r, w = r / r.mean(), np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a * (r * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(w.size)
        w += np.linalg.solve(h, a.T @ (r * (y - p)) - 0.1 * w)
    model.weights = w
    return model


def train(rows: list[tuple[bytes, int]], s: Settings = Settings(), stands_for: tuple[float, float] = (1, 1)) -> Model:
    """``dictionaries`` and ``calibrate`` in one place."""
    model = dictionaries(rows, s)
    return calibrate(model, model.features(t for t, _ in rows), np.array([y for _, y in rows]), stands_for) if model.ordinary else model


def _train(texts: DataFrame, rows: dict[object, tuple[bytes, int]], s: Settings, stands_for: tuple[float, float]) -> Model:
    """The same for rows by id of ``texts`` (``i``, ``t``), with their features, which are bounded, worked out where the texts are."""
    spark, model = texts.sparkSession, dictionaries(list(rows.values()), s)
    if not model.ordinary:
        return model
    shared = spark.sparkContext.broadcast(model)
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    chosen = [(i, sign(xxhash.xxh64_intdigest(t, 42)), int(y)) for i, (t, y) in rows.items()]
    rows.clear()
    chosen = spark.createDataFrame(chosen, T.StructType([texts.schema["i"], T.StructField("h", T.LongType()), T.StructField("y", T.LongType())]))

    def start():
        return lambda columns: [pa.array(list(shared.value.features(utf8(columns[0]))), pa.list_(pa.float64()))]

    # Bounded by the sample: broadcast. Of equal rows one counts.
    mine = texts.join(F.broadcast(chosen), (texts["i"] == chosen["i"]) & (F.xxhash64(texts["t"]) == chosen["h"])).select(texts["i"], texts["t"], "y")
    got = append_columns(mine, {"text": F.col("t")}, [T.StructField("x", T.ArrayType(T.DoubleType()))], start, keep=["i", "y"]).collect()
    got = list({r.i: r for r in got}.values())
    return calibrate(model, np.array([r.x for r in got]), np.array([r.y for r in got]), stands_for)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that are kept out of training: the id's CRC-32, as text, is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out.

    Rows without id, label or text do not count; of several labels of an id the
    highest counts, of repeated rows of an id one. The sample's ids (twice the
    bound, as labels may lack a document) are joined by broadcast: their number
    is bounded.
    """
    known = labels.select(column(labels, doc_id).alias("i"), column(labels, label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("i"))
    rows: dict[object, tuple[bytes, int]] = {}
    texts = docs.select(column(docs, doc_id).alias("i"), column(docs, text).alias("t")).where(F.octet_length("t").between(1, settings.row_bytes))
    taken, bound = [0, 0], False
    for y, most in ((1, settings.toxic_rows), (0, settings.ordinary_rows)):
        some = known.where((F.col("y") > 0) == bool(y)).orderBy("h", "i").limit(2 * most)
        got = texts.join(F.broadcast(some), "i").orderBy("h", "i", "t").limit(most).select("i", "t").collect()
        each = {r.i: r.t for r in reversed(got)}
        rows |= {i: (t.encode("utf-8", "surrogatepass"), y) for i, t in each.items()}
        taken[y], bound = len(each), bound or len(got) >= most
        del got, each
    if not bound or not all(taken):
        return _train(texts, rows, settings, (1, 1))
    # Each class was cut on its own: a row stands for its share of all that could have been taken.
    able = texts.select("i").join(known, "i").groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.countDistinct("i").alias("n"))
    n = {r.y: r.n for r in able.collect()}
    return _train(texts, rows, settings, (n[0] / taken[0], n[1] / taken[1]))


def annotate_toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` (0 to 1, of the whole text) and ``predicted`` (1 from 0.5).

    Only the text is scored, whole, however long. Null and empty texts are
    scored as one empty window; rows are scored one by one, so repeated ones
    alike; no rows give none. Columns of these names are replaced; no shuffle.
    """
    scored = _scored(docs, model, text, "score")
    return scored.withColumns({"held_out": held_out(column(docs, doc_id)), "predicted": (F.col("score") >= 0.5).cast("int")})


def drop_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns only, whatever their names.

    Null and empty texts are scored as an empty window; repeated rows go or stay
    together; no rows give none. Labels that are missing, null or all alike
    leave nothing to learn: every row's score is the share of toxic labels then.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text, settings=settings)
    (name,) = free_names(docs, "__toxicity")
    return _scored(docs, model, text, name).where(F.col(name) < 0.5).select(*[F.col(quoted(c)) for c in docs.columns])


def _scored(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def step(columns):
            return [pa.array(shared.value.score(utf8(columns[0])), pa.float64())]

        return step

    return append_columns(docs, {"text": column(docs, text)}, [T.StructField(name, T.DoubleType())], start)
