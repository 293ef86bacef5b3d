import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checkpoints, filters, inventory, logs, results, sync, versions


def files(spark, **contents):
    return spark.createDataFrame([(k, len(v), v) for k, v in contents.items()], "path string, size bigint, content binary")


def tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_chunks_of_fourteen_bytes(spark):
    rows = sync.chunk_table(files(spark, s=b"abcdefghijklmn"), 5).orderBy("chunk_idx").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 4), (5, 9), (10, 13)]
    assert [r.md5 for r in rows] == [hashlib.md5(x).hexdigest() for x in (b"abcde", b"fghij", b"klmn")]
    assert sync.chunk_table(files(spark, e=b""), 5).count() == 0


def test_last_of_equal_chunks(spark):
    assert [(r.start, r.end) for r in sync.chunk_map(sync.chunk_table(files(spark, s=b"ababab"), 2)).collect()] == [(4, 5)]


def test_same_size_edit(spark):
    new, old = files(spark, s=b"abcdefghijXXXX"), files(spark, s=b"abcdefghijklmn")
    assert sync.sync_plan(new, old).first().action == "unchanged"
    assert tuples(sync.delta_ranges(sync.chunk_table(new, 5), sync.chunk_table(old, 5))) == [("s", 10, 13, 1)]


def test_all_new(spark):
    new = files(spark, s=b"abcde12345")
    none = new.limit(0)
    assert tuples(sync.delta_ranges(sync.chunk_table(new, 5), sync.chunk_table(none, 5))) == [("s", 0, 9, 2)]
    assert tuples(sync.transfer_ranges(sync.sync_plan(new, none))) == [("s", 0, 9, 10)]


def test_neighbouring_ranges_only_are_merged(spark):
    new, old = files(spark, s=b"AAbbCCDDee"), files(spark, s=b"aabbccddee")
    assert tuples(sync.delta_ranges(sync.chunk_table(new, 2), sync.chunk_table(old, 2))) == [("s", 0, 1, 1), ("s", 4, 7, 2)]


def test_plan_cases(spark):
    remote = files(spark, empty=b"", new=b"a", same=b"bb", longer=b"ccc", shorter=b"d", emptied=b"ee")
    local = files(spark, same=b"xx", longer=b"c", shorter=b"dd", emptied=b"", gone=b"f", empty=b"zz")
    got = {r.path: (r.action, r.bytes) for r in sync.sync_plan(remote, local).collect()}
    assert got == {"empty": ("unchanged", 0), "new": ("new", 1), "same": ("unchanged", 0), "longer": ("size_changed", 3), "shorter": ("size_changed", 1), "emptied": ("new", 2)}


def test_plan_reads_no_content(spark, tmp_path):
    files(spark, a=b"x").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    plan = sync.sync_plan(t, t)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan and "ReadSchema" in plan


def test_summary_of_nothing_and_report(spark):
    none = spark.createDataFrame([], "path string, size bigint, downloaded bigint, checksum string, status string, changes bigint, error string")
    assert tuple(results.session_summary(none).first()) == (0, 0, 0, 0, 0)
    some = spark.createDataFrame([("a", 5, 5, "c", "completed", 1, ""), ("b", 7, 0, "", "failed", 0, "e")], none.schema)
    r = json.loads(results.report(some, F.lit("2024-01-02 03:04:05").cast("timestamp")).first().value)
    assert r["summary"] == {"total_files": 2, "successful": 1, "failed": 1, "total_bytes_transferred": 5, "total_changed_chunks": 1, "timestamp": "2024-01-02 03:04:05"}
    assert [list(d) for d in r["details"]] == [["path", "size", "downloaded", "checksum", "status", "changes", "error"]] * 2


def contents(spark, *sums):
    return spark.createDataFrame([("f", i, s) for i, s in enumerate(sums)], "path string, seq int, checksum string")


def test_compat_history_lags(spark):
    c = contents(spark, "c1", "c2", "c3")
    h = versions.version_history(c)
    assert tuples(h.select("version", "checksum")) == [(0, "c1"), (1, "c1"), (2, "c2")]
    assert tuples(versions.latest_checksum(h)) == [("f", 2, "c2")]
    assert tuples(versions.stale_latest(c, h)) == [("f", 2, "c2", "c3")]
    assert tuples(versions.version_history(c, "contract").select("version", "checksum", "archived")) == [(0, "c1", True), (1, "c2", True), (2, "c3", False)]
    assert tuples(versions.rollback_target(c)) == [("f", 1, "c2")]
    assert tuples(versions.version_history(contents(spark, "c1")).select("version", "checksum")) == [(0, "c1")]
    with pytest.raises(ValueError):
        versions.version_history(c, "other")


def test_numbers_go_on(spark):
    h = versions.version_history(contents(spark, "c1", "c2"))
    new = spark.createDataFrame([("f", 5, "c2"), ("f", 6, "c3"), ("g", 1, "d1")], "path string, seq int, checksum string")
    got = tuples(versions.record_versions(h, new).where("archived").select("path", "version", "checksum"))
    assert got == [("f", 1, "c1"), ("f", 2, "c2"), ("f", 3, "c3"), ("g", 1, "d1")]
    f = spark.createDataFrame([("f", "x"), ("n", "y")], "path string, checksum string")
    assert tuples(versions.baseline_missing(f, h)) == [("n", 0, "y")]


def test_version_map_there_and_back(spark):
    h = versions.with_archived_path(versions.version_history(contents(spark, "c1", "c2")), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    text = versions.to_map(h)
    assert json.loads(text.first().value) == {"f": [{"version": 0, "checksum": "c1", "archived_path": "", "timestamp": "20240102T030405"}, {"version": 1, "checksum": "c1", "archived_path": ".versions/f.v1_20240102T030405", "timestamp": "20240102T030405"}]}
    assert sorted(versions.from_map(text).collect()) == sorted(h.collect())
    broken = spark.createDataFrame([("{no json",), ("{}",), (None,)], "value string")
    assert versions.from_map(broken).count() == 0


@pytest.mark.parametrize("text, want", [('{"position": 1234}', 1234), ("{}", 0), ("{", 0), ("[1]", 0), (None, 0), ('{"position": "x"}', 0)])
def test_positions(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(checkpoints.parse_position(F.col("t")).alias("p")).first().p == want


def test_checkpoints(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "path string, position bigint")
    assert tuples(checkpoints.save_positions(c, c.where("path = 'a'").withColumn("position", F.lit(9).cast("bigint")))) == [("a", 9), ("b", 2)]
    done = spark.createDataFrame([("a", "completed"), ("b", "failed")], "path string, status string")
    assert tuples(checkpoints.cleanup(c, done)) == [("b", 2)]


def test_filters(spark):
    f = spark.createDataFrame([("a.txt",), ("d/b.txt",), ("d/c.pdf",)], "path string")
    assert tuples(filters.filter_files(f, ["*.txt"], ["d/*"])) == [("a.txt",)]
    assert tuples(filters.filter_files(f)) == [("a.txt",), ("d/b.txt",), ("d/c.pdf",)]
    # The root is '.', which the documented pattern doesn't let pass: nothing is reached.
    assert filters.filter_pruned(f, ["*.txt"]).count() == 0
    assert tuples(filters.filter_pruned(f, ["*"], ["d"])) == [("a.txt",)]


def tree(spark):
    own = inventory.inventory(spark.createDataFrame([("Docs/Personal.txt", 3), ("Docs/Deep/x", 0), ("top", 1)], "path string, size bigint"), "owned")
    return own.unionByName(inventory.inventory(spark.createDataFrame([("SharedRoot/Sub/File.txt", 4), ("top", 9)], "path string, size bigint"), "shared"))


def test_trees(spark):
    t = tree(spark)
    assert tuples(inventory.list_children(t, "/Docs/")) == [("Deep", "folder"), ("Personal.txt", "file")]
    assert tuples(inventory.list_shared_roots(t)) == [("SharedRoot", "folder"), ("top", "file")]
    asked = spark.createDataFrame([("Docs/Personal.txt",), ("SharedRoot/Sub/File.txt",), ("top",), ("",), ("no",)], "request string")
    got = {r.request: (r.root, r.type, r.size, r.status) for r in inventory.resolve_paths(asked, t).collect()}
    assert got == {"Docs/Personal.txt": ("owned", "file", 3, "found"), "SharedRoot/Sub/File.txt": ("shared", "file", 4, "found"), "top": ("owned", "file", 1, "found"), "": ("owned", "folder", None, "found"), "no": (None, None, None, "not found")}
    with pytest.raises(Exception, match="Path not found: no"):
        inventory.resolve_paths(asked, t, strict=True).collect()
    assert tuples(inventory.walk(t, "Docs").select("path", "level")) == [("Docs/Deep", 1), ("Docs/Deep/x", 2), ("Docs/Personal.txt", 1)]
    assert inventory.once_each(t.union(t)).count() == t.count()


def test_readable(spark):
    rows = [("file", 10, True), ("folder", None, None), ("file", None, True), (None, 1, True), ("file", 0, True), ("file", 1, False)]
    df = spark.createDataFrame(rows, "type string, size bigint, openable boolean")
    assert df.where(inventory.S.is_readable_file(F.col("type"), F.col("size"), F.col("openable"))).count() == 2


def test_log_lines_of_other_forms(spark):
    lines = ["2024-01-01 00:00:00,000 - INFO - {\"event\": \"file_unchanged\", \"file\": \"a - {b}\"}", "no log line", "2024-01-01 00:00:00,000 - INFO - {broken", "2024-01-01 00:00:00,000 - INFO - {\"other\": 1}"]
    (r,) = logs.log_parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (r.level, r.event, r.file) == ("INFO", "file_unchanged", "a - {b}")


def test_session_reports(spark):
    body = {"event": "download_completed", "summary": {"summary": {"total_files": 2, "successful": 1, "failed": 1, "total_bytes_transferred": 5, "total_changed_chunks": 1, "timestamp": "t"}, "details": []}}
    lines = spark.createDataFrame([("2024-01-01 00:00:00,000 - INFO - " + json.dumps(body),)], "value string")
    assert tuple(logs.session_reports(logs.log_parse(lines)).first()) == ("2024-01-01 00:00:00,000", 2, 1, 1, 5, 1, "t")


def test_reassembly_is_by_position(spark):
    parts = spark.createDataFrame([("f", 10, b"c"), ("f", 0, b"a"), ("f", 9, b"b")], "path string, start bigint, piece binary")
    assert bytes(sync.reassemble(parts).first().content) == b"abc"
