"""Near-duplicates by the Jaccard similarity of their shingles, confirmed exactly.

First come the pairs that SimHash finds: a set's fingerprint is that of its
shingles, and fingerprints within three bits meet at the anchors of the Hamming
code (``simhash.links``). Pairs at similarity 0.8 are about ten bits apart, which
anchors can't cover, so there is a second source of candidates for what isn't
linked yet: texts that share one of 24 bands of four minhashes. A pair at 0.8 is
missed there with a probability of 3e-6, one above it with less. Each candidate
pair's similarity is computed from the whole sets of (64-bit hashes of) shingles.

Nothing returned grows with the square of a group: texts with equal sets are one
node. In a bucket (nodes that share a band), a few leaders are compared with all
others; what that connects needs no more comparison, and only buckets whose nodes
are not one component yet go on, with more leaders from outside their largest
component. At the end every pair of a bucket was compared or is connected. From
the second round on pairs are first held against a bound, so that sets are
fetched for few that aren't similar: where the parities of the shingles' numbers
in 512 bins differ, the sets differ by a shingle at least. The bound is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, column, materialize, utf8
from tidemark.llm.simhash import components, links, majority

SHINGLE, BANDS, BAND_ROWS = 5, 24, 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
#: Shingles whose minhashes are taken at a time; nodes with candidates that are looked up by broadcast at most.
_AT_ONCE, _FEW = 2048, 200_000
#: Bins of a set's parities; words of 64 bits that hold them.
_BINS = 512
_WORDS = _BINS // 64


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a UTF-8 text; words as for SimHash, and a text of fewer is one shingle."""
    w = text.lower().split() if text else []
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [w] if w else []
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join({digest(b" ".join(g), 42) for g in grams}), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The bands' keys, as signed longs; none of an empty set."""
    if not hashes.size:
        return []
    least = np.full(_FACTORS.size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, hashes.size, _AT_ONCE):
        x = hashes[a : a + _AT_ONCE, None] * _FACTORS
        np.minimum(least, (x ^ x >> np.uint64(32)).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def parities(hashes: np.ndarray) -> list[int]:
    """For each of 512 bins whether an odd number of the hashes falls in it: eight signed longs."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % _BINS, minlength=_BINS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def sketches(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``keep``) and ``node`` (the hash of the set); ``bands``, ``shingles``, ``fp`` (its SimHash) and ``parities`` once a task for each node, otherwise null."""
    longs = T.ArrayType(T.LongType())

    def start():
        seen: set[int] = set()

        def step(columns):
            node, keys, sets, fps, odd = [], [], [], [], []
            for t in utf8(columns[0]):
                s = shingles(t, shingle)
                node.append(int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)))
                new = node[-1] not in seen
                seen.add(node[-1])
                keys.append(bands(s) if new else None)
                sets.append(s.view(np.int64) if new else None)
                fps.append(majority(s) if new else None)
                odd.append(parities(s) if new else None)
            many = pa.list_(pa.int64())
            return [pa.array(node, pa.int64()), pa.array(keys, many), pa.array(sets, many), pa.array(fps, pa.int64()), pa.array(odd, many)]

        return step

    kinds = {"node": T.LongType(), "bands": longs, "shingles": longs, "fp": T.LongType(), "parities": longs}
    return append_columns(docs, {"text": column(docs, text)}, [T.StructField(n, k) for n, k in kinds.items()], start, keep)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have a Jaccard similarity of 0.8 or more."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return x.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes that SimHash's anchors find: of each fingerprint one node, with those of linked fingerprints and with its other nodes."""
    some = nodes.where("n > 0").select("node", "fp")
    stands = materialize(some.groupBy("fp").agg(F.min("node").alias("stands")), "prints")
    found = materialize(links(stands.select("fp")), "links")
    of = lambda fp, node: stands.select(F.col("fp").alias(fp), F.col("stands").alias(node))
    far = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    same = some.join(stands, "fp").where("node <> stands").select(F.col("stands").alias("x"), F.col("node").alias("y"))
    return materialize(far.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "close")


def _parted(at: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of buckets, with new labels, of buckets whose nodes are not one component."""
    if found is not None:
        at = at.drop("label").join(found, at["node"] == found["node"], "left").drop(found["node"])
        at = materialize(at.withColumn("label", F.coalesce("root", "node")).drop("root"), "rest")
    parted = at.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")
    return at.join(parted, "bucket", "left_semi")


def roots(sketched: DataFrame) -> DataFrame:
    """The components of the nodes in the output of ``sketches``: columns ``node`` and ``root``, for linked nodes only."""
    first = sketched.where("shingles IS NOT NULL")
    own = F.struct("bands", "fp", "parities", F.size("shingles").alias("n"))
    nodes = materialize(first.groupBy("node").agg(F.first(own).alias("own")).select("node", "own.*"), "nodes")
    close = _close(nodes)
    sent = materialize(nodes.select("node", "n", F.explode("bands").alias("bucket")), "bands")
    shared = sent.groupBy("bucket").count().where("count > 1").select("bucket")
    live = materialize(sent.join(shared, "bucket", "left_semi").withColumn("label", F.col("node")), "buckets")
    able = live.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node")))
    able = materialize(able.distinct(), "candidates")
    # Joined by broadcast only if the nodes with candidates are few; their number is known now.
    few = able.limit(_FEW + 1).count() <= _FEW
    sets = first.join(F.broadcast(able) if few else able, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "sets")
    edges, most = materialize(_similar(close, sets), "similar"), 1
    found = None if edges.isEmpty() else components(edges)
    if found is not None:
        live = materialize(_parted(live, found), "buckets")
    while not live.isEmpty():
        # The order is that of all buckets, so buckets of the same nodes have the same leaders.
        count = live.groupBy("bucket", "label").agg(F.count("*").alias("c"))
        main = count.groupBy("bucket").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("c"))
        order = F.xxhash64("node", F.lit(most))
        at = live.join(main, "bucket")
        least = at.where("label <> main").groupBy("bucket").agg(F.min(F.struct(order.alias("h"), "node"))["node"].alias("least"))
        drawn = F.pmod(order, F.ceil((F.col("all") - F.col("c")) / most)) == 0 if most > 1 else F.lit(False)
        at = at.join(least, "bucket").withColumn("leads", (F.col("label") != F.col("main")) & ((F.col("node") == F.col("least")) | drawn))
        at = materialize(at.select(*live.columns, "leads"), "leaders")
        lead = at.where("leads").withColumnsRenamed({"node": "b", "n": "m", "label": "other", "parities": "odd"}).drop("leads")
        # Sets of too different sizes can't be similar, nor sets that differ in too much.
        able = (F.col("label") != F.col("other")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m"))
        if most > 1:
            apart = sum(F.bit_count(F.col("parities")[i].bitwiseXOR(F.col("odd")[i])) for i in range(_WORDS))
            able &= 9 * apart <= F.col("n") + F.col("m")
        pairs = at.join(lead, (at["bucket"] == lead["bucket"]) & able)
        pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        new = materialize(_similar(pairs, sets), "similar")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            found = components(edges)
        live = _parted(at.where("NOT leads").drop("leads"), found)
        live = materialize(live.join(nodes.select("node", "parities"), "node") if most == 1 else live, "buckets")
        most *= 16
    return found if found is not None else sent.select("node", F.col("node").alias("root")).limit(0)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``text_hash``, ``root`` (of its component) and ``component_id``.

    Texts link whose sets of shingles have a Jaccard similarity of 0.8 or more;
    the component's id is the smallest doc_id that can be reached over links,
    null ids aside. Texts without words link with one another.
    """
    slim = docs.select(column(docs, doc_id).alias("doc_id"), F.xxhash64(column(docs, text)).alias("text_hash"), column(docs, text).alias("text"))
    sketched = materialize(sketches(slim, shingle=shingle, keep=["doc_id", "text_hash"]), "sketches")
    linked = roots(sketched)
    rows = sketched.select("doc_id", "text_hash", "node")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    least = linked.join(nodes, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    # A root may have very many nodes: only linked ones are joined.
    many = linked.join(least, "root").select("node", "root", "component_id")
    single = nodes.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    of = materialize(many.unionByName(single), "components")
    return rows.join(of, "node").select("doc_id", "text_hash", "root", "component_id")
