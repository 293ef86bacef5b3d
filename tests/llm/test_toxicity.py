import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import toxicity as t


def corpus(n=400):
    rnd = random.Random(5)
    syll = "an the ou ti er on sh nd re st ea ha in".split()
    word = lambda: "".join(rnd.choices(syll, k=rnd.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(30, 300))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["gromblax", "vilquex", "zorfpunk"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_windows_cover_the_text():
    text = " ".join(map(str, range(37))).encode()
    assert {x for w in t.windows(text, 8, 4) for x in w.split()} == set(text.split())
    assert t.windows(None, 8, 4) == t.windows(b" ", 8, 4) == [b"  "]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    got = {r.doc_id: r for r in t.annotate_toxicity(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in out]) > 0.93
    kept = {r.doc_id for r in t.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


@pytest.mark.parametrize("labelled", [[], [(1, 0)], [(1, 1), (None, 0), (2, None)]])
def test_few_labels_nulls_and_clashes(spark, labelled):
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, None), (None, "", 1.0), (3, "x " * 100_000, 0.0), (3, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    out = t.annotate_toxicity(docs, t.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert t.annotate_toxicity(docs.limit(0), t.fit(docs, labels)).count() == 0
    assert t.drop_toxic(docs, labels).columns == docs.columns


def test_scores_have_the_natural_rate_above_the_caps(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(500)]
    docs = spark.createDataFrame([(i, "the same words in all") for i, _ in rows], "doc_id long, text string")
    model = t.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), settings=t.Settings(toxic_rows=30, ordinary_rows=30))
    share = np.mean([y for i, y in rows if zlib.crc32(str(i).encode()) % 5])
    assert abs(model.score([b"the same words in all"])[0] - share) < 0.03


def plain_distinctive(toxic, ordinary, s):
    """The definition, a run of characters at a time."""
    words = lambda x: x.lower().decode().split()
    runs_of = lambda w: [f" {w} "[i : i + t.GRAM] for i in range(len(w) + 3 - t.GRAM)]
    docs = [Counter(g for x in texts for g in {g for w in words(x) for g in runs_of(w)}) for texts in (ordinary, toxic)]
    n0, n1, typical = len(ordinary), len(toxic), set()
    for g, a in docs[1].items():
        b = docs[0][g]
        e = (a + b) * n1 / (n0 + n1)
        evidence = 2 * (a * np.log(a / e) + (b * np.log(b / (a + b - e)) if b else 0))
        odds = np.log((a + 0.5) / (b + 0.5)) - np.log((n1 + 1) / (n0 + 1))
        before = {p for x in toxic for p, w in zip(["", *words(x)], words(x), strict=False) if g in runs_of(w)}
        if a >= s.least_docs and odds > s.least_odds and evidence > 2 * np.log(max(2, len(docs[1]))) + 4 and len(before) >= max(s.least_docs, a / 5):
            typical.add(g)
    pieces = Counter()
    for x in toxic:
        for w in words(x):
            mark = [False] * (len(w) + 2)
            for i, g in enumerate(runs_of(w)):
                if g in typical:
                    mark[i : i + t.GRAM] = [True] * t.GRAM
            starts = [i for i, g in enumerate(runs_of(w)) if g in typical]
            at = 0
            while at < len(starts):
                end = starts[at] + t.GRAM
                first = starts[at]
                while at + 1 < len(starts) and starts[at + 1] < end:
                    at += 1
                    end = starts[at] + t.GRAM
                pieces[f" {w} "[first:end]] += 1
                at += 1
    return Counter({p.encode(): n for p, n in pieces.items() if n >= s.least_words})


def test_distinctive_words_by_the_definition():
    rows = [(x.encode(), y) for _, x, y in corpus(240)]
    toxic, ordinary = [x for x, y in rows if y], [x for x, y in rows if not y]
    got = Counter(t.distinctive(toxic, ordinary, t.Settings()))
    assert got == plain_distinctive(toxic, ordinary, t.Settings()) and got


def test_scores_by_the_definition():
    rows = [(x.encode(), y) for _, x, y in corpus(160)]
    model = t.train(rows)
    assert t.train(rows[::-1]).score([rows[0][0]]) == pytest.approx(model.score([rows[0][0]]))

    def size(content, window):
        return len(t._compressor(content).compress(window))

    for text in (rows[0][0], rows[1][0], b"", None):
        saved = sorted((size(model.ordinary, w) - size(model.ordinary + model.toxic, w) for w in t.windows(text, 8, 4)), reverse=True)
        best = [min(x, 6) for x in saved[:4]]
        over = [sum(x >= k for x in saved) for k in t.THRESHOLDS]
        want = [best[0], np.mean(best[:2]), np.mean(best), *np.log1p(over), *(x / len(saved) for x in over[:3])]
        assert model.features([text])[0] == pytest.approx(want)
        z = ((np.array(want) - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)))
