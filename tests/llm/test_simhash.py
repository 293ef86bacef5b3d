import random
import time

import numpy as np
import pyarrow.parquet as pq
import xxhash

from tidemark.llm import resemblance, simhash

SCHEMA = "doc_id long, text string"


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [w[i : i + k] for i in range(len(w) - k + 1)] or [w]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, threshold=3):
    """doc_id to (fingerprint, smallest linked doc_id), comparing all pairs."""
    prints = [(d, brute_print(t)) for d, t in rows]
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    fps = np.array([p for _, p in prints], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold).tolist():
            top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, p, least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_against_all_pairs(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(900)}" for _ in range(700)]
    for i in range(60):  # a large group of near copies
        w = list(base)
        w[rnd.randrange(700)] = f"x{i}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "ONE"), (20_003, "one"), (None, "null id"), (None, "null id"), (20_009, "é " * 200_000)]
    got = found(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_components(rows)


def test_every_link_is_found(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(150):
        x = rnd.getrandbits(64)
        for _ in range(4):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randrange(1, 4)):
                x ^= 1 << b
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    for at_once in (1, 1024):
        roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, at_once)).collect()}
        a = np.array(sorted(signed), np.int64)
        near = np.bitwise_count(a.view(np.uint64)[:, None] ^ a.view(np.uint64)[None, :]) <= 3
        label = np.arange(a.size)
        while True:
            new = np.array([label[near[i]].min() for i in range(a.size)])
            if (new == label).all():
                break
            label = new
        ours = [roots.get(x, x) for x in a.tolist()]
        assert all((ours[i] == ours[j]) == (label[i] == label[j]) for i in range(a.size) for j in range(0, a.size, 7))


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = simhash.components(edges).collect()
    assert len({r.root for r in roots if r.node <= 200}) == 1 and len(roots) == 203


def test_empty_and_clashing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d", "x", 1), (2, "a b c d", "y", 2), (3, "other words here now", "z", 3), (3, "other words here now", "z", 3), (None, "q", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    kept = simhash.keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"]


def test_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text that is unique"), (5, "and a third one with no copy"), (5, "and a third one with no copy"), (6, None), (6, "last")]
    df = spark.createDataFrame(rows, SCHEMA)
    for find in (simhash.with_roots, resemblance.near_duplicates):
        kept = sorted(map(tuple, simhash.keep_one_each(df, find=find).collect()), key=str)
        assert kept == sorted([rows[0], rows[2], rows[3], *rows[5:]], key=str)


def test_many_fingerprints_that_share_a_half(spark):
    """Pairs at a crowded anchor are compared under finer keys: not all with all, and no link is lost."""
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 1 << 32, 40_000, np.uint64) << np.uint64(32) | np.uint64(0x1234567)
    fps[:400] = fps[1000:1400] ^ (np.uint64(1) << rng.integers(32, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 31, 400).astype(np.uint64))
    fps[400:600] = fps[1000:1200] ^ np.uint64(7 << 40)
    fps = np.unique(fps)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    began = time.time()
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    took = time.time() - began
    pairs = 0
    for i in range(0, fps.size, 500):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 3)
        for x, y in zip(fps[a + i].view(np.int64).tolist(), fps[b].view(np.int64).tolist(), strict=True):
            if x != y:
                pairs += 1
                assert roots[x] == roots[y]
    assert pairs >= 800 and took < 60
