import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontamination as d


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=13):
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(i if i is None else str(i))
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    ids |= wins[g]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12), st.binary(max_size=300).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_search_finds_all(patterns, text):
    patterns = list(dict.fromkeys(patterns))
    lengths = np.array([len(p) for p in patterns])
    at, which = d.WuManber(b"".join(patterns), np.cumsum(lengths) - lengths, lengths, block=3).find(text)
    want = sorted((m.start(), i) for i, p in enumerate(patterns) for m in re.finditer(b"(?=" + p + b")", text))
    assert sorted(zip(at.tolist(), which.tolist(), strict=True)) == want


def cases():
    rnd = random.Random(3)
    vocab = ["alpha", "be", "Çà", "d", "e9", "zeta", "eta", "日本", "x"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 13, 14, 40])))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (None, "alpha be"), (3, "be be be be")]
    docs = []
    for i in range(40):
        text = " ".join(rnd.choices([*vocab, "q" * 30], k=rnd.randrange(1, 120)))
        if i % 3 == 0:
            text += "--" + rnd.choice(items[:12])[1].upper().replace(" ", ", ")
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, "\x00!?"), (7, docs[7][1]), (None, docs[9][1]), (103, "long words " * 50_000 + items[5][1])], items


def test_against_brute_force(spark):
    docs, items = cases()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert found(d.annotate_contamination(a, b)) == want
    assert found(d.annotate_contamination(a, b, block_bytes=200)) == want


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "one two three", "n", 5), (2, "four", "m", 6)], "doc_id long, text string, items string, N_WORDS int")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert [tuple(r) for r in d.drop_contaminated(docs, items).collect()] == [(2, "four", "m", 6)]
    assert [r.contaminated for r in d.annotate_contamination(docs, items).orderBy("doc_id").collect()] == [True, False]
    assert d.drop_contaminated(docs, items.limit(0)).count() == 2
    assert d.annotate_contamination(docs.limit(0), items).count() == 0
