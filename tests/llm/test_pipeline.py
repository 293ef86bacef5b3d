"""The pipeline's stages, one after another, each against a plain version on its own input."""

import pytest
from test_decontamination import brute as brute_contamination
from test_packing import check_pack

import corpus_pipeline
from tidemark.llm import ledger, toxicity
from tidemark.llm.queries import word_tokenizer

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, SF).write.parquet(path)
        got = spark.read.parquet(path)
        out[name] = (docs, got)
        docs = got
    return out


def test_columns_are_kept(stages):
    for name, (given, got) in stages.items():
        if name != "packing":
            assert got.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert got.count() <= given.count()


def test_toxicity(spark, stages):
    given, got = stages["toxicity"]
    model = toxicity.fit(given, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r for r in rows(given) if model.score([(r[1] or "").encode()])[0] < 0.5]
    assert rows(got) == kept and 0 < len(kept) < given.count()


def brute_groups(rows, k=5):
    """doc_id to the smallest doc_id that links reach, where sets of five-word shingles have a similarity of 0.8 or more: all pairs that share one."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)]))
    top, by = list(range(len(rows))), {}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for g in x:
            by.setdefault(g, []).append(i)
    for i, x in enumerate(sets):
        for j in {j for g in x for j in by[g] if j > i}:
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_duplicates(stages):
    given, got = stages["near_duplicates"]
    keep = {d for d, c in brute_groups([(r.doc_id, r.text) for r in given.collect()]).items() if d == c}
    assert rows(got) == [r for r in rows(given) if r[0] in keep] and len(keep) < given.count()


def test_decontamination(spark, stages):
    given, got = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in given.collect()], items) if r[5]}
    assert rows(got) == [r for r in rows(given) if r[0] not in bad] and bad


def test_secrets(stages):
    given, got = stages["secrets"]
    scan, want = ledger.scanner(), []
    for d, t, lang, source, n in rows(given):
        spans, parts, at = scan(t), [], 0
        for _, a, b in spans:
            if a >= at:
                parts += [t[at:a], "[secret]"]
            at = max(at, b)
        new = "".join([*parts, t[at:]]) if spans else t
        want.append((d, new, lang, source, len(new) if spans else n))
    assert rows(got) == sorted(want, key=str)
    assert not any(scan(r[1]) for r in rows(got))


def test_packing(stages):
    from tokenizers import Tokenizer

    given, got = stages["packing"]
    n, least = check_pack([(r.doc_id, r.text) for r in given.collect()], got.collect(), Tokenizer.from_file(word_tokenizer()))
    assert n <= least + 1


def test_run_is_the_stages(spark, stages):
    kinds = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, SF).select(kinds)) == rows(stages["packing"][1].select(kinds))


def test_empty_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


ODD = [
    (1, None, "en", "s", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "a word or two, no more of it", None, "s", 28), (3, "a word or two, no more of it", None, "s", 28), (None, "without an id", "de", "s", 13),
    (4, "long words of many kinds " * 40_000, "en", "s", 1), (5, "token = abcdefgh1 here", "en", "s", 22),
]


@pytest.mark.parametrize("emptied", [(), ("labels",), ("benchmark",), ("labels", "benchmark")])
def test_odd_rows_and_empty_tables(spark, tmp_path, emptied):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'k' AS n_hit", "'k' AS score", "'k' AS `__text`", "'k' AS `a.b`")
    for t in ("labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.limit(0) if t in emptied else df).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in corpus_pipeline.STAGES:
        given = docs.count()
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_duplicates":
            # The empty text's rows are one group, as are the repeated ones; what has no id stays.
            assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "5", "None"]
        elif name == "packing":
            assert {r.doc_id for r in got.collect()} == {1, 3, 4, 5, None}
        else:
            assert got.columns == docs.columns and got.count() == given
        docs = got
