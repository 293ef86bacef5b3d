import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import resemblance

SCHEMA = "doc_id long, text string"


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id to the smallest linked doc_id, by the similarity of all pairs that share a shingle."""
    each, top, of = [sets(t) for _, t in rows], list(range(len(rows))), {}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    pairs = 0
    for i, s in enumerate(each):
        seen = {j for g in s for j in of.get(g, ())} if s else {j for j in range(i) if not each[j]}
        for j in seen:
            if 5 * len(s & each[j]) >= 4 * len(s | each[j]):
                pairs += s != each[j]
                top[find(i)] = find(j)
        for g in s:
            of.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}, pairs


def edited():
    """Texts with copies edited to similarities about 0.8, a large group, and texts that share a passage."""
    rnd = random.Random(4)
    rows, word = [], lambda: f"w{rnd.randrange(5000)}"
    for _ in range(40):
        w = [word() for _ in range(rnd.randrange(20, 300))]
        rows.append(w)
        for share in (0.01, 0.02, 0.025, 0.03):
            rows.append([word() if rnd.random() < share else x for x in w])
    base = [word() for _ in range(400)]
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randrange(1, 12)):
            w[rnd.randrange(400)] = f"x{i}"
        rows.append(w)
    rows += [base[:100] + [word() for _ in range(60)] for _ in range(60)]
    out = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return out + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "one two three")]


def test_against_all_pairs(spark):
    rows = edited()
    want, pairs = brute(rows)
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and pairs > 500


def test_the_stage_links_edited_copies(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want, pairs = brute([(r["doc_id"], r["text"]) for r in rows])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect())
    assert kept == sorted(d for d, c in want.items() if d == c) and pairs


def test_simhash_finds_close_copies_and_the_sets_decide(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(5000)}" for _ in range(600)]
    rows = [(i, " ".join([*base[: 100 * i], f"x{i}", *base[100 * i :]])) for i in range(5)] + [(9, " ".join(f"z{i}" for i in range(300)))]
    sketched = resemblance.sketches(spark.createDataFrame(rows, SCHEMA)).withColumn("bands", F.array().cast("array<long>"))
    prints = {r.doc_id: r.fp for r in sketched.collect()}
    bits = lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count()
    want, top = {d: d for d in prints}, None
    while top != want:
        top = dict(want)
        want = {d: min(want[x] for x in prints if bits(d, x) <= 3) for d in prints}
    groups = {r.node: r.root for r in resemblance.roots(sketched).collect()}
    of = {r.doc_id: groups.get(r.node, r.node) for r in sketched.collect()}
    assert [[of[a] == of[b] for a in of] for b in of] == [[want[a] == want[b] for a in of] for b in of] and len(set(want.values())) < 6
    # A fingerprint alone links nothing: here all are alike, and the sets tell 9 apart.
    groups = {r.node: r.root for r in resemblance.roots(sketched.withColumn("fp", F.lit(1).cast("long"))).collect()}
    assert {d: n in groups for d, n in ((r.doc_id, r.node) for r in sketched.collect())} == {d: d < 5 for d in prints}


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(3)
    for n in (0, 5, 100, 3000):
        x, y = (np.unique(np.concatenate([own, rnd.integers(0, 1 << 63, k, np.uint64)])) for own in [rnd.integers(0, 1 << 63, n, np.uint64)] for k in (7, 20))
        apart = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(resemblance.parities(x), resemblance.parities(y), strict=True))
        assert 0 < apart <= np.setxor1d(x, y).size


def test_empty(spark):
    assert resemblance.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
