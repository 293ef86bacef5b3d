import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


@pytest.fixture(scope="module")
def ours():
    return packing.WordTokenizer(word_tokenizer())


ODD = [
    "", "a\x1cb", "a\x85b c", "ΑΣ ΑΣ", "<|endoftext|> x<|endoftext|>y", "<|startoftext|>", "é ́x é", "don't I'LL 's", "x'\ts s'", "İstanbul ẞ ß K Å", "a​b", "\x00 \x01", "ﬁ ½ ²",
    "12345 10,5 0 a0", "日本 語", "👍🏽 ok", "\x0bq\x0c", "Word, word. (word) word!? ×÷ª º", " x y",
]


def test_ids_equal_the_tokenizers(ours, whole):
    texts = ODD + [a + b for a in ODD for b in ODD] + [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    for t, ids in zip(texts, ours([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:80])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(ours, whole, t):
    assert np.frombuffer(ours([t.encode()])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_cache_starts_afresh(whole, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 8)
    small = packing.WordTokenizer(word_tokenizer())
    t = " ".join(f"w{chr(97 + i % 26)} v{i}" for i in range(60)) + " one two one"
    for _ in range(3):
        assert np.frombuffer(small([t.encode()])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plan_holds_all(lengths):
    counts = np.bincount(lengths, minlength=33)[:33]
    groups = packing.plan(counts)
    got = np.zeros(33, np.int64)
    for g in groups:
        assert g.count > 0 and 0 < sum(g.lengths) <= 32
        for n in g.lengths:
            got[n] += g.count
    assert (got == counts).all()
    assert sum(g.count for g in groups) <= sum(g.count for g in packing.best_fit(counts)) + 2
    places, seen = packing.Places(groups), defaultdict(list)
    for n in range(1, 33):
        seq, at = places.find(np.full(int(counts[n]), n), np.arange(int(counts[n])))
        for s, o in zip(seq.tolist(), at.tolist(), strict=True):
            seen[s].append((o, n))
    for x in seen.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist()


def check_pack(rows, out, whole, capacity=2048):
    want = []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity)) for p in [ids[a : a + capacity]]]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32)) for r in out)
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r["length"]))
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(seqs), -(-total // capacity)


def test_pack_documents(spark, whole):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    rows += [(900, None), (901, ""), (901, ""), (None, "null id"), (902, "long words here " * 40_000), (3, rows[3][1])]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), word_tokenizer(), salt_rows=50).collect()
    n, least = check_pack(rows, out, whole)
    assert n <= least + 1


def test_pack_nothing_and_clashes(spark, whole):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, None)], "doc_id long, text string, piece int, Length string")
    assert packing.pack(df.limit(0), word_tokenizer()).count() == 0
    check_pack([(1, "a b"), (2, None)], packing.pack(df, word_tokenizer(), capacity=2).collect(), whole, 2)


def test_a_worker_drops_its_words_when_another_task_begins():
    from tidemark.llm import common, packing

    path = word_tokenizer()
    ask = lambda: packing.tokenizer_of_process(path)
    first = common.begin(ask)
    assert common.begin(ask) is first
    common.begin(lambda: None)
    assert not common._HELD and common.begin(ask) is not first
