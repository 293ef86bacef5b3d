import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli, hooks, logsetup
from tidemark.model import STATUS, RunConfig
from tidemark.sinks import writers
from tidemark.sources import connector, documents, http, local, profiles
from tidemark.streaming import progress
from tidemark.streaming.listener import SessionListener


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b" / "deep").mkdir(parents=True)
    (tmp_path / "a b" / "deep" / "x+%.txt").write_bytes(b"hello")
    (tmp_path / "a b" / ".hidden").write_bytes(b"h")
    (tmp_path / "empty").write_bytes(b"")
    return tmp_path


def test_listing_sees_all(spark, folder):
    got = {(r.path, r.parent, r.name, r.type, r.size, r.depth) for r in local.listing(spark, str(folder)).collect()}
    assert got == {("a b", "", "a b", "folder", None, 1), ("a b/deep", "a b", "deep", "folder", None, 2), ("a b/deep/x+%.txt", "a b/deep", "x+%.txt", "file", 5, 3), ("a b/.hidden", "a b", ".hidden", "file", 1, 2), ("empty", "", "empty", "file", 0, 1)}


def test_local_contents(spark, folder):
    (r,) = local.local_state(spark, str(folder)).collect()
    assert (r.path, r["size"], bytes(r.content)) == ("a b/deep/x+%.txt", 5, b"hello")


class Answer:
    def __init__(self, status, content):
        self.status_code, self.content = status, content

    def raise_for_status(self):
        if self.status_code >= 400:
            raise OSError(f"status {self.status_code}")


class Server:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def get(self, url, headers, timeout):
        self.asked.append((url, headers["Range"], timeout))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_ranges():
    waits = []
    s = Server(OSError("gone"), Answer(404, b""), Answer(206, b"abc"))
    assert http.fetch_range(s, "u", 0, 2, 3, waits.append) == b"abc"
    assert waits == [2, 4] and s.asked[0] == ("u", "bytes=0-2", 30)
    assert http.fetch_range(Server(Answer(200, b"abcdef")), "u", 1, 3) == b"bcd"
    with pytest.raises(OSError, match="status 204"):
        http.fetch_range(Server(*[Answer(204, b"")] * 2), "u", 0, 1, 2, waits.append)


def test_opening():
    waits, said, left = [], [], [OSError("503 retryAfter: 90"), OSError("Connection reset")]

    def opened():
        if left:
            raise left.pop(0)
        return "stream"

    assert http.open_with_retry(opened, 3, waits.append, said.append, "f") == "stream"
    assert waits == [60, 4] and [s["attempt"] for s in said] == [1, 2]
    with pytest.raises(KeyError):
        http.open_with_retry(lambda: {}["no"], 3, waits.append)


def test_ranges_as_rows(spark):
    rows = [("f", "u", 0, 2), ("f", "bad", 3, 4)]

    def connect():
        class Local:
            def get(self, url, headers, timeout):
                if url == "bad":
                    raise OSError("no such host")
                a = type("A", (), {"status_code": 206, "content": b"abc", "raise_for_status": lambda self: None})
                return a()

        return Local()

    out = {r.start: r for r in http.fetch_ranges(spark.createDataFrame(rows, "path string, url string, start long, end long"), connect, 1).collect()}
    assert bytes(out[0].piece) == b"abc" and out[3].piece is None and out[3].error == "no such host"


def test_profiles(tmp_path):
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"docs": {"include": ["*.pdf"]}}))
    assert profiles.load_profile(str(f), "docs") == profiles.Profile(("*.pdf",), ())
    assert profiles.load_profile("nowhere", None) == profiles.Profile()
    with pytest.raises(KeyError):
        profiles.load_profile(str(f), "other")
    with pytest.raises(FileNotFoundError):
        profiles.load_profile(str(tmp_path / "no"), "docs")
    f.write_text("{")
    with pytest.raises(ValueError):
        profiles.load_profile(str(f), "docs")


def test_documents(spark, tmp_path):
    (tmp_path / "data.bin.download").write_text('{"position": 1234}')
    (tmp_path / "b.download").write_text("{")
    got = {(r.path, r.position) for r in documents.read_checkpoints(spark, f"{tmp_path}/*.download").collect()}
    assert got == {(f"{tmp_path}/data.bin", 1234), (f"{tmp_path}/b", 0)}
    (tmp_path / "v.json").write_text(json.dumps({"s": [{"version": 1, "checksum": "ck1", "archived_path": "p", "timestamp": "t"}]}))
    assert [tuple(r) for r in documents.read_versions(spark, f"{tmp_path}/v.json").collect()] == [("s", 1, "ck1", "p", "t")]


def test_writers(spark, tmp_path):
    files = spark.createDataFrame([("d/a", b"hello"), ("e", b""), ("../out", b"x")], "path string, content binary")
    out = {r.path: r for r in writers.write_files(files, str(tmp_path / "top")).collect()}
    assert out["d/a"].checksum == hashlib.sha256(b"hello").hexdigest() and (tmp_path / "top/d/a").read_bytes() == b"hello"
    assert out["e"].status == out["../out"].status == "failed" and not (tmp_path / "out").exists()
    res = spark.createDataFrame([("d/a", 5, 5, "c", "completed", 1, ""), ("b", 7, 0, "", "failed", 0, "e")], STATUS)
    for _ in range(2):
        writers.append_index(res, "/local", str(tmp_path / "index"))
        writers.write_report(res, F.current_timestamp(), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "index")).collect()]
    assert lines == ["a\t/local/d/a"] * 2
    assert spark.read.text(str(tmp_path / "report")).count() == 1
    cp = spark.createDataFrame([("d/a", 5), ("b", 1)], "path string, position bigint")
    writers.write_checkpoints(cp, cp.limit(0), res, str(tmp_path / "cp"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "cp")).collect()] == [("b", 1)]
    v = spark.createDataFrame([("s", 0, "c", "", "t")], "path string, version int, checksum string, archived_path string, timestamp string")
    writers.write_versions(v, str(tmp_path / "v"))
    writers.write_versions(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    writers.export_version_map(v, str(tmp_path / "m"))
    assert documents.read_versions(spark, str(tmp_path / "m")).count() == 1


class Recorder(hooks.Hook):
    def __init__(self):
        self.told = []

    def on_authenticated(self, client, **more):
        self.told.append("auth")

    def on_list_contents(self, path, contents, **more):
        self.told.append((path, [c["name"] for c in contents]))

    def after_download(self, remote_item, local_path, success, **more):
        self.told.append(f"after_{success}")

    def on_event(self, name, **payload):
        self.told.append(name)


class Failing(hooks.Hook):
    def on_event(self, name, **payload):
        raise RuntimeError


def test_hooks(tmp_path):
    r = hooks.Registry([Failing()])
    rec = Recorder()
    r.register(rec)
    r.register(hooks.IndexHook(str(tmp_path / "i")))
    r.dispatch("on_event", "x", a=1)
    r.dispatch("unknown")
    for ok in (True, False):
        r.dispatch("after_download", "item", "/l/item", ok)
    assert rec.told == ["x", "after_True", "after_False"] and r.errors == 1
    assert (tmp_path / "i").read_text() == "item\t/l/item\n"
    (tmp_path / "good.py").write_text("from tidemark.hooks import Hook\nclass A(Hook): pass\nclass B(Hook): pass\n")
    (tmp_path / "bad.py").write_text("raise ValueError")
    r.load([str(tmp_path), str(tmp_path), str(tmp_path / "nowhere")])
    assert type(r.hooks[-1]).__name__ == "A" and len(r.hooks) == 4 and r.errors == 2


class Client:
    requires_2fa = True

    def __init__(self, email, password, china):
        self.args = (email, password, china)

    def validate_2fa_code(self, code):
        return code == "1"


def test_sign_in(monkeypatch):
    monkeypatch.delenv(connector.EMAIL_VARIABLE, raising=False)
    with pytest.raises(ValueError):
        connector.account()
    monkeypatch.setenv(connector.EMAIL_VARIABLE, "e@x")
    monkeypatch.setenv(connector.CHINA_VARIABLE, "true")
    rec = Recorder()
    assert connector.sign_in(Client, ask=lambda q: "1", hooks=hooks.Registry([rec])).args == ("e@x", None, True)
    assert rec.told == ["auth"]
    with pytest.raises(RuntimeError):
        connector.sign_in(Client, ask=lambda q: "2")


def test_logging(tmp_path, capsys):
    for _ in range(2):
        logger = logsetup.setup_logging(str(tmp_path / "l" / "log"))
    logsetup.log_event(logger, 20, event="empty_directory", path="p")
    line = (tmp_path / "l" / "log").read_text()
    assert line.endswith(' - INFO - {"event": "empty_directory", "path": "p"}\n') and len(logger.handlers) == 2


def test_command_line(spark, tmp_path):
    remote, here = tmp_path / "r", tmp_path / "h"
    for at in (remote / "d", here / "d"):
        at.mkdir(parents=True)
        (at / "same.txt").write_text("s")
    (remote / "d" / "new.txt").write_text("n" * 1048576)
    out = io.StringIO()
    rec = Recorder()
    assert cli.run(spark, [f"folder:{remote}", "--list", "/d"], out, hooks.Registry([rec])) == 0
    assert rec.told == [("/d", ["new.txt", "same.txt"])]
    assert out.getvalue() == "file\tnew.txt\nfile\tsame.txt\n"
    out = io.StringIO()
    assert cli.run(spark, [f"folder:{remote}", f"folder:{here}"], out) == 0
    assert out.getvalue() == "new: 1 files, 1.00 MB\nunchanged: 1 files, 0.00 MB\n"
    assert cli.run(spark, [f"folder:{remote}"]) == 1
    with pytest.raises(ValueError):
        RunConfig(chunk_size=0)


def test_incremental_stream(spark, tmp_path):
    from tidemark.operators.sync import sync_plan

    src, schema = tmp_path / "src", "path string, size bigint"
    for i, rows in enumerate(([("a", 1), ("b", 2)], [("a", 1), ("b", 3), ("c", 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        progress.sync_batches(stream, sync_plan, str(tmp_path / "out")).awaitTermination()
    plans = {(r.batch, r.path, r.action) for r in spark.read.parquet(str(tmp_path / "out/plan")).collect()}
    assert plans == {(0, "a", "new"), (0, "b", "new"), (1, "a", "unchanged"), (1, "b", "size_changed"), (1, "c", "new")}


def test_latest_positions_over_batches_and_listener(spark, tmp_path):
    rec = Recorder()
    listener = SessionListener(hooks.Registry([rec]))
    spark.streams.addListener(listener)
    src, schema = tmp_path / "src", "key long, seq long, position long"
    for rows in ([(1, 1, 10), (2, 1, 20)], [(1, 2, 5), (2, 0, 99)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        progress.write_latest(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out")).awaitTermination()
    assert {tuple(r) for r in progress.read_latest(spark, str(tmp_path / "out")).collect()} == {(1, 5), (2, 20)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert "download_progress" in rec.told and "download_session_completed" in rec.told


def test_version_maps_of_many_versions_are_many_files(spark, tmp_path):
    rows = [(p, i, f"c{i}", "", "t") for p, n in [("hot", 3000), *((f"p{k}", 3) for k in range(400))] for i in range(n)]
    v = spark.createDataFrame(rows, "path string, version int, checksum string, archived_path string, timestamp string")
    writers.export_version_map(v, str(tmp_path / "m"), 700)
    maps = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect()]
    sizes = [sum(map(len, m.values())) for m in maps]
    assert len(maps) > 1 and sum(sizes) == 4200 and max(sizes) < 2500 and sum("hot" in m for m in maps) > 1
    assert sorted(map(tuple, documents.read_versions(spark, str(tmp_path / "m")).collect())) == sorted(rows)
    writers.export_version_map(v.limit(0), str(tmp_path / "none"))
    assert documents.read_versions(spark, str(tmp_path / "none")).count() == 0
