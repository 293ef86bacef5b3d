import hashlib
import math
import random
from collections import Counter

import pyarrow.parquet as pq
import xxhash

from tidemark.llm import fingerprints as f

SCHEMA = "doc_id long, text string"


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def neighbours(rows):
    own = sorted(((-(1 << 63) if d is None else d, t or "", d) for d, t in rows), key=lambda r: r[:2])
    out = []
    for i, (_, t, d) in enumerate(own):
        nxt, k = own[(i + 1) % len(own)][1], len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, nxt))
    return out


def test_edited_texts_and_equal_fingerprints(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    rows += [(None, "no id"), (None, None), (5, rows[5][1]), (5, "other"), (9000, ""), (9001, None), (9002, "é日本🙂x" * 30_000), (9003, "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("range", f.F.lit(1)).repartition(5)
    for size in (1 << 10, 1 << 30):
        got = f.edited_and_next(df, range_bytes=size).collect()
        want = neighbours(rows)
        assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, (w[:3] for w in want)))
        print_of = {}
        text_of = {w[:3]: w[3:] for w in want}
        for r in got:
            t, e, _ = text_of[r.doc_id, r.n_chars, r.edited_sha256]
            assert print_of.setdefault(t, r.fingerprint) == r.fingerprint
            assert print_of.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def weighted(rnd, n, share, own):
    """Two texts whose pairs of words overlap in part, with repeats."""
    block = lambda tag: [f"{own}{tag}{rnd.randrange(40)}" for _ in range(n)]
    common, a, b = block("c"), block("a"), block("b")
    k = int(n * share)
    return " ".join(common[:k] * 2 + a[k:]), " ".join(common[:k] + b[k:] + common[: k // 2])


def bag(text):
    w = [None, *text.lower().split(), None]
    return list(zip(w, w[1:], strict=False))


def test_likeness_is_generalised_jaccard(spark):
    rnd = random.Random(4)
    pairs = [weighted(rnd, rnd.choice([60, 200]), rnd.random(), i) for i in range(40)]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    for bins, rounds, most in ((1, 200, 0.12), (64, 1, 0.22), (64, 6, 0.1)):
        got = {r.doc_id: r.entries for r in f.fingerprint(spark.createDataFrame(rows, SCHEMA), bins=bins, rounds=rounds, partitions=4).collect()}
        both = spark.createDataFrame([(i, got[2 * i], got[2 * i + 1]) for i in range(len(pairs))], "i long, a array<int>, b array<int>")
        near = {r.i: r.n for r in both.select("i", f.likeness(f.F.col("a"), f.F.col("b")).alias("n")).collect()}
        off = [near[i] - jaccard(bag(a), bag(b)) for i, (a, b) in enumerate(pairs)]
        assert max(map(abs, off)) < most + 0.05 and abs(sum(off) / len(off)) < 0.03 and math.sqrt(sum(x * x for x in off) / len(off)) < most / 2 + 0.01


def test_nothing_and_one(spark):
    df = spark.createDataFrame([(3, "only one here")], SCHEMA)
    (r,) = f.edited_and_next(df).collect()
    assert r.near_next == 1.0 and r.n_chars == 13
    assert f.edited_and_next(df.limit(0)).count() == 0 and f.fingerprint(df.limit(0)).count() == 0


def spark_hash(*values):
    """The engine's 64-bit hash of longs, ints and strings in a row; nulls are passed over."""
    h = 42
    for kind, v in values:
        if v is not None:
            raw = v.encode() if kind == "s" else (v % (1 << 64)).to_bytes(8, "little") if kind == "l" else (v % (1 << 32)).to_bytes(4, "little")
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_sample(counts, seed):
    """The sample that the definition gives: the term's hash and t."""
    best = None
    for (a, b), n in counts.items():
        term = signed(spark_hash(("s", a), ("s", b)))
        h = [spark_hash(("l", term), ("i", seed), ("i", k)) for k in (1, 2, 3)]
        u = [((x & 0xFFFFFFFF) + 0.5) / (1 << 32) for x in h] + [((x >> 32) + 0.5) / (1 << 32) for x in h]
        r, ln_c = -math.log(u[0]) - math.log(u[3]), math.log(-math.log(u[1]) - math.log(u[4]))
        t = math.floor(math.log(n) / r + u[2])
        a_t = ln_c - r * (t - u[2] + 1)
        if best is None or a_t < best[0]:
            best = (a_t, term, t)
    return best[1:]


def test_plain_samples_are_those_of_the_definition(spark):
    texts = ["a b a b a b a b c d c d", "a b " * 40 + "c d e f g", "one two three", ""]
    rounds = 50
    got = f.fingerprint(spark.createDataFrame(list(enumerate(texts)), SCHEMA), bins=1, piece=None, rounds=rounds).collect()
    heavy = set()
    for r in got:
        # An empty text is one empty word between the edges, and nulls are passed over by the hash.
        samples = [plain_sample(Counter(bag(texts[r.doc_id]) if texts[r.doc_id] else [(None, "")] * 2), k) for k in range(rounds)]
        heavy |= {t for _, t in samples}
        assert list(r.entries) == [k << 20 | spark_hash(("l", term), ("l", t), ("i", k)) & ((1 << 20) - 1) for k, (term, t) in enumerate(samples)]
    assert len(heavy) > 3  # weights above 1 move t


def test_likeness_of_edited_and_next_texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if len(r["text"]) > 600]
    got = {r.doc_id: r for r in f.edited_and_next(spark.createDataFrame(rows, SCHEMA)).collect()}
    off = []
    for d, _, _, t, e, nxt in neighbours(rows):
        off += [got[d].near_edited - jaccard(bag(t), bag(e)), got[d].near_next - jaccard(bag(t), bag(nxt))]
    assert abs(sum(off) / len(off)) < 0.01 and math.sqrt(sum(x * x for x in off) / len(off)) < 0.06 and max(map(abs, off)) < 0.3


def test_a_hot_id_is_parted(spark):
    rows = [(None, f"{i * 7919 % 500:03d} text {i}") for i in range(300)] + [(7, f"{i * 31 % 97:02d} same id {i}") for i in range(200)] + [(i, f"other {i}") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    bounds = f._splits(df.select(f.F.coalesce("doc_id", f.F.lit(-(1 << 63)).cast("long")).alias("k"), f.F.col("text").alias("t")), 12)
    assert sum(x.startswith("0" * 16) for x in bounds) > 4 and len(set(bounds)) == len(bounds) and bounds == sorted(bounds)
    got = f.edited_and_next(df, range_bytes=700).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, (w[:3] for w in neighbours(rows))))
