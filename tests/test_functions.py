import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import glob
from tidemark.functions import scalars as S

PATTERNS = ["*", "*.txt", "a?c", "[!e]*", "[a-c]x", "[]]", "[!]]", "[", "[]", "a[", "[z-a]", "[!z-a]", "**/x", "a.b+c", "{a,b}", "[-a]", "[a-]", "[\\]", "", "[!", "a\\b", "[a-c-e]", "[^a]", "[&&]", "?[0-9]*"]
NAMES = ["", "a", "abc", "a/c", "x.txt", "en/src1/1.txt", "bx", "]", "[", "!", "-", "a[", "a.b+c", "{a,b}", "a\n", "\n", "é/ü", "\\", "a\\b", "e", "z", "^", "&", "d", "🙂c", "s12"]


def test_globs_match_as_the_library_does(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    out = df.select("n", *[F.col("n").rlike(glob.to_regex(p)).alias(str(i)) for i, p in enumerate(PATTERNS)]).collect()
    wrong = [(p, r.n) for r in out for i, p in enumerate(PATTERNS) if r[str(i)] != fnmatch.fnmatchcase(r.n, p)]
    assert not wrong


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab[]!-*?^\\.z", max_size=7), min_size=8, max_size=8), st.lists(st.text("ab[]!-^\\.z", max_size=5), min_size=8, max_size=8))
def test_any_glob(spark, patterns, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = df.select("n", *[F.col("n").rlike(glob.to_regex(p)).alias(str(i)) for i, p in enumerate(patterns)]).collect()
    assert all(r[str(i)] == fnmatch.fnmatchcase(r.n, p) for r in out for i, p in enumerate(patterns))


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'bigint'}" for n, v in zip(names, values, strict=True))).select(column.alias("x")).first().x


@pytest.mark.parametrize("path, want", [("/", ""), ("//a//b/", "a/b"), ("a", "a"), (None, "")])
def test_clean_path(spark, path, want):
    assert one(spark, S.clean_path(F.col("c0")), path) == want


def test_paths(spark):
    assert one(spark, S.ancestors(F.col("c0")), "a/b/c") == [".", "a", "a/b", "a/b/c"]
    assert one(spark, S.relative_path(F.col("c0"), "/top/"), "/top/a/b") == "a/b"
    assert one(spark, S.relative_path(F.col("c0"), "/top"), "/top") == "."
    assert one(spark, S.parent_path(F.col("c0")), "a/b/c") == "a/b" and one(spark, S.parent_path(F.col("c0")), "a") == ""
    assert one(spark, S.as_posix(F.col("c0")), "a\\b") == "a/b"


@pytest.mark.parametrize("count, want", [(0, "0.00"), (1048576, "1.00"), (131072, "0.12"), (393216, "0.38"), (5_242_880_000, "5000.00")])
def test_megabytes(spark, count, want):
    assert one(spark, S.megabytes(F.col("c0")), count) == want == f"{count / 1048576:.2f}"


@pytest.mark.parametrize("error, attempt, wait, retry", [
    ("503 Service Unavailable", 1, 2, True), ("Connection reset", 2, 4, True), ('{"retryAfter": "90"} RETRY_NEEDED', 1, 60, True), ("timeout retryAfter: 7", 2, 7, True),
    ("no such file", 1, 2, False), (None, 3, 8, False),
])
def test_retries(spark, error, attempt, wait, retry):
    assert one(spark, S.retry_wait(F.col("c0"), F.col("c1")), error, attempt) == wait
    assert one(spark, S.is_retryable(F.col("c0")), error) == retry


def test_headers_and_backoff(spark):
    assert [one(spark, S.content_length(F.col("c0")), v) for v in ("12", None, "x")] == [12, 0, None]
    assert one(spark, S.backoff_schedule(F.col("c0")), 3) == [2, 4, 8]


def test_stamps(spark):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    r = spark.range(1).select(S.file_stamp(at).alias("a"), S.report_stamp(at).alias("b"), S.archived_path(F.lit("a/b"), F.lit(2), S.file_stamp(at)).alias("c")).first()
    assert tuple(r) == ("20240102T030405", "2024-01-02 03:04:05", ".versions/a/b.v2_20240102T030405")
