import datetime as dt
import io
import json
import logging
import os

import pytest

from tidemark import cli, hooks
from tidemark.model import RunConfig
from tidemark.operators import inventory, session
from tidemark.plans.catalogue import _no_wait as no_wait
from tidemark.sinks import transfer
from tidemark.sources import connector, local
from tidemark.sources.http import FilesTransport, files_transport

AT = dt.datetime(2024, 5, 6, 7, 8, 9)
SCHEMA = "path string, name string, type string, size long, url string"


class Recorder(hooks.Hook):
    def __init__(self):
        self.told = []

    def before_download(self, remote_item, local_path, **more):
        self.told.append(("before", remote_item))

    def after_download(self, remote_item, local_path, success, **more):
        self.told.append(("after", remote_item, success))

    def on_event(self, name, **payload):
        self.told.append((name, payload.get("downloaded"), payload.get("summary", {}).get("summary", {}).get("total_files")))


@pytest.fixture
def sides(tmp_path):
    theirs, mine = tmp_path / "theirs", tmp_path / "mine"
    for top, files in ((theirs, {"new.bin": b"0123456789", "d/same": b"abc", "d/old": b"longer now"}), (mine, {"d/same": b"xyz", "d/old": b"short"})):
        for name, content in files.items():
            (top / name).parent.mkdir(parents=True, exist_ok=True)
            (top / name).write_bytes(content)
    return theirs, mine


def rows(spark, theirs, *more):
    have = [(n, n.rsplit("/", 1)[-1], "file", os.path.getsize(theirs / n), str(theirs / n)) for n in ("new.bin", "d/same", "d/old")]
    return spark.createDataFrame([*have, ("d", "d", "folder", None, None), *more], SCHEMA)


def test_a_session_and_the_next(spark, sides):
    theirs, mine = sides
    rec = Recorder()
    more = [("gone", "gone", "file", 5, "missing:"), ("odd", None, "file", 5, "x"), ("new.bin", "new.bin", "file", 10, str(theirs / "new.bin"))]
    s = session.sync_session(rows(spark, theirs, *more), str(mine), files_transport, hooks=hooks.Registry([rec]), logger=logging.getLogger("quiet"), at=AT, sleep=no_wait)
    assert {(r.path, r.status, r.downloaded, r.changes) for r in s.results.collect()} == {("new.bin", "completed", 10, 1), ("d/old", "completed", 10, 1), ("gone", "failed", 0, 0)}
    assert (mine / "new.bin").read_bytes() == b"0123456789" and (mine / "d/old").read_bytes() == b"longer now" and (mine / "d/same").read_bytes() == b"xyz"
    assert (mine / ".versions/d/old.v1_20240506T070809").read_bytes() == b"short"
    assert not [f for _, _, names in os.walk(mine) for f in names if f.endswith(".temp")]
    assert {(r.path, r.version) for r in s.versions.collect()} == {("d/old", 1), ("new.bin", 0)}
    report = json.loads((mine / session.REPORT_FILE).read_text())
    assert report["summary"] == {"total_files": 3, "successful": 2, "failed": 1, "total_bytes_transferred": 20, "total_changed_chunks": 2, "timestamp": "2024-05-06 07:08:09"}
    assert [d["path"] for d in report["details"]] == ["d/old", "gone", "new.bin"]
    assert {t for t in rec.told if t[0] == "before"} == {("before", p) for p in ("new.bin", "d/old", "gone")}
    assert {t for t in rec.told if t[0] == "after"} == {("after", "new.bin", True), ("after", "d/old", True), ("after", "gone", False)}
    assert ("download_session_completed", None, 3) in rec.told and ("download_progress", 10, None) in rec.told
    said = {(json.loads(r.body)["event"], r.level) for r in s.events.collect()}
    assert said == {("download_success", "INFO"), ("download_failed", "ERROR"), ("file_unchanged", "INFO"), ("invalid_item", "WARNING")}
    (theirs / "d/old").write_bytes(b"third one is longer")
    s = session.sync_session(rows(spark, theirs), str(mine), files_transport, at=AT.replace(day=7))
    assert [(r.path, r.status) for r in s.results.collect()] == [("d/old", "completed")]
    kept = json.loads((mine / session.VERSIONS_FILE).read_text())
    assert [v["version"] for v in kept["d/old"]] == [1, 2] and (mine / kept["d/old"][1]["archived_path"]).read_bytes() == b"longer now"
    assert [v["version"] for v in kept["new.bin"]] == [0]


def test_ranges_are_written_in_place(spark, sides):
    theirs, mine = sides
    (theirs / "new.bin").write_bytes(b"0123456789")
    (mine / "new.bin").write_bytes(b"01xx45678yZZZ")
    ranges = spark.createDataFrame([("new.bin", 2, 3), ("new.bin", 9, 9)], "path string, start long, end long")
    s = session.sync_session(rows(spark, theirs), str(mine), files_transport, ranges=ranges, at=AT)
    assert (mine / "new.bin").read_bytes() == b"0123456789" and (mine / "d/old").read_bytes() == b"short"
    assert [(r.downloaded, r.changes) for r in s.results.collect()] == [(3, 2)]


def test_patterns_nothing_and_paths_that_lead_out(spark, sides):
    theirs, mine = sides
    none = session.sync_session(rows(spark, theirs).limit(0), str(mine), files_transport)
    assert none.results.count() == 0 and none.summary["total_files"] == 0
    out = [("../out.bin", "out.bin", "file", 10, str(theirs / "new.bin"))]
    s = session.sync_session(rows(spark, theirs, *out), str(mine), files_transport, config=RunConfig(exclude=("d",)))
    assert {(r.path, r.status) for r in s.results.collect()} == {("new.bin", "completed"), ("../out.bin", "failed")}
    assert not (mine.parent / "out.bin").exists()


def test_a_file_that_cannot_be_archived_is_moved_without_a_version(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"old")
    (tmp_path / "src").write_bytes(b"newer")
    row = {"path": "a", "url": str(tmp_path / "src"), "size": 5, "ranges": [{"start": 0, "end": 4}], "version": 1}

    def fails(*_):
        raise OSError("no room")

    monkeypatch.setattr(transfer.os, "link", fails)
    monkeypatch.setattr(transfer.shutil, "copy2", fails)
    out = transfer._transfer(str(tmp_path), row, FilesTransport(), 1, "s", no_wait)
    assert out[4] == "completed" and out[7] == "" and (tmp_path / "a").read_bytes() == b"newer"


def test_a_failed_write_leaves_the_old_file(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"old")
    row = {"path": "a", "url": "none:", "size": 5, "ranges": [{"start": 0, "end": 4}], "version": None}
    monkeypatch.setattr(transfer.os, "remove", lambda f: (_ for _ in ()).throw(OSError("busy")))
    out = transfer._transfer(str(tmp_path), row, FilesTransport(), 1, "s", no_wait)
    assert out[4] == "failed" and (tmp_path / "a").read_bytes() == b"old"
    assert [json.loads(e["body"])["event"] for e in out[9]] == ["download_failed", "temp_file_cleanup_error", "download_failed"]
    monkeypatch.undo()
    empty = {"path": "e", "url": "none:", "size": 0, "ranges": [], "version": None}
    assert [json.loads(e["body"])["event"] for e in transfer._transfer(str(tmp_path), empty, FilesTransport(), 1, "s", no_wait)[9]] == ["invalid_temp_file", "download_failed"]


def test_walk_is_not_bounded_by_depth_or_rows(spark):
    deep = "/".join(f"f{i}" for i in range(150)) + "/x"
    items = inventory.inventory(spark.createDataFrame([(deep, 1), ("a/b", 2)], "path string, size long"), "owned")
    got = {r.path: r.level for r in inventory.walk(items).collect()}
    assert got[deep] == 151 and got["a/b"] == 2 and len(got) == 153
    lost = items.where("path <> 'f0/f1'")
    assert {r.path for r in inventory.walk(lost).collect()} == {"f0", "a", "a/b"}
    assert {(r.path, r.level) for r in inventory.walk(items, "a").collect()} == {("a/b", 1)}


def test_listing_is_dealt_to_many_tasks(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"one/two/f{i}").mkdir(parents=True)
        (tmp_path / f"one/two/f{i}/x").write_bytes(b"1")
    reader = local._ListingReader(str(tmp_path), "owned", subtrees=20)
    assert len([p for p in reader.partitions() if p.deep]) == 30
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 62 and sorted(r[1:] for r in got) == sorted(tuple(r)[1:] for r in local.listing(spark, str(tmp_path)).collect())


class Client:
    requires_2fa, requires_2sa, is_trusted_session = True, False, False
    trusted_devices: list = []

    def __init__(self):
        self.trusted = 0

    def validate_2fa_code(self, code):
        return code == "1"

    def trust_session(self):
        self.trusted += 1
        return True


def test_sign_in_trusts_the_session_and_needs_a_device():
    c = connector.sign_in(lambda *a, **k: Client(), "me", ask=lambda _: "1")
    assert c.trusted == 1
    bare = Client()
    bare.requires_2fa, bare.requires_2sa = False, True
    with pytest.raises(RuntimeError, match="no trusted device"):
        connector.sign_in(lambda *a, **k: bare, "me", ask=lambda _: "0")


def test_the_command_line_transfers_and_logs(spark, sides, tmp_path):
    theirs, mine = sides
    (theirs / "bare").mkdir()
    log, out = tmp_path / "logs/run.log", io.StringIO()
    assert cli.run(spark, [f"folder:{theirs}", f"folder:{mine}", "--transfer", "--log-file", str(log), "--email", "me@example.com"], out=out) == 0
    assert "2 of 2 files transferred" in out.getvalue() and (mine / "new.bin").read_bytes() == b"0123456789"
    for args in (["--list", "d"], ["--list", "bare"], ["--list", "new.bin"], ["--list", "none"], ["--list-shared"]):
        assert cli.run(spark, [f"folder:{theirs}", *args, "--log-file", str(log)], out=out) == 0
    said = [json.loads(x.split(" - ", 2)[2])["event"] for x in log.read_text().splitlines()]
    assert said[0] == "download_started" and set(said) >= {"download_success", "download_completed", "listing_contents", "empty_directory", "item_info", "listing_error", "no_shared_items"}
