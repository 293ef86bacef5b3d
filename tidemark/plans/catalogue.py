"""Every query, with the SQL that it is checked against."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalars
from tidemark.functions.glob import to_regex
from tidemark.operators import checkpoints, filters, inventory, logs, results, session, sync, versions
from tidemark.plans import drive
from tidemark.plans.drive import sql
from tidemark.sinks import writers
from tidemark.sources import documents, http, local
from tidemark.sources.http import files_transport
from tidemark.sources.profiles import parse_profiles
from tidemark.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]

#: The requests, patterns and profiles that the queries use.
REQUESTS = ["/", "en/src1", "//en//src1/", "en/src1/1.txt", "/page_0.html", "missing/file.txt", "en/src1/1.txt/below", "page_1.html/"]
GLOBS = {"exclude_wins": (["*.txt"], ["*/src1/*"]), "no_include": ([], ["*1?.txt"]), "ranges": (["[!e]*/src[0-3]/*"], []), "folder": (["*"], ["en/src1"])}
PROFILES = {"texts": {"include": ["*.txt"], "exclude": ["*/src1/*"]}, "german": {"include": ["de/*"]}, "all": {}}


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in REQUESTS], "request string")


def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.resolve_paths(_requests(spark), drive.all_items(spark, sf_dir))


def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = drive.all_items(spark, sf_dir)
    lists = [inventory.list_children(items, p).withColumn("parent", F.lit(p)) for p in ("en", "en/src1", "missing")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def list_shared_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.list_shared_roots(drive.all_items(spark, sf_dir))


def readable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.readable_files(drive.all_items(spark, sf_dir)).select("root", "path", "size")


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.walk(drive.all_items(spark, sf_dir))


def _globbed(keep: Callable, which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    include, exclude = GLOBS[which]
    return keep(drive.remote(spark, sf_dir).select("path"), include, exclude)


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse_profiles(json.dumps(PROFILES), "texts")
    return filters.filter_files(drive.remote(spark, sf_dir).select("path"), p.include, p.exclude)


def profile_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that come as rows: each file with each profile that lets it pass."""
    texts = lambda ps: F.array(*[F.lit(to_regex(p)) for p in ps]).cast("array<string>")
    rows = F.array(*[F.struct(F.lit(name).alias("profile"), texts(x.get("include", [])).alias("include"), texts(x.get("exclude", [])).alias("exclude")) for name, x in PROFILES.items()])
    each = drive.remote(spark, sf_dir).select("path", F.explode(rows).alias("p")).select("path", "p.*")
    return filters.filter_by_data(each, "include", "exclude").select("profile", "path")


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drive.plan(spark, sf_dir)


def sync_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.plan_summary(drive.plan(spark, sf_dir))


def transfer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.transfer_ranges(drive.plan(spark, sf_dir))


def missed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that compat takes for unchanged though their contents differ."""
    theirs = drive.local_state(spark, sf_dir).select("path", F.md5("content").alias("have"))
    mine = drive.remote(spark, sf_dir).select("path", F.md5("content").alias("md5"))
    same = drive.plan(spark, sf_dir).where("action = 'unchanged'").select("path")
    return same.join(mine, "path").join(theirs, "path").where("md5 <> have").select("path")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.chunk_table(drive.remote(spark, sf_dir), 1024)


def chunk_map_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.chunk_map(sync.chunk_table(drive.remote(spark, sf_dir), 16))


def delta_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.delta_ranges(sync.chunk_table(drive.remote(spark, sf_dir), 512), sync.chunk_table(drive.local_state(spark, sf_dir), 512))


def file_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.file_checksum(drive.remote(spark, sf_dir))


def reassemble_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = drive.remote(spark, sf_dir)
    starts = F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(1000))
    cut = files.where("size > 0").select("path", "content", F.explode(starts).alias("start"))
    pieces = cut.select("path", "start", F.substring("content", F.col("start") + 1, F.lit(1000)).alias("piece"))
    return sync.file_checksum(sync.reassemble(pieces))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.session_summary(drive.results(spark, sf_dir))


def session_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.session_details(drive.results(spark, sf_dir))


def transferred_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.transferred_mb(drive.results(spark, sf_dir))


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_history(drive.contents(spark, sf_dir)).select("path", "version", "checksum")


def latest_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_checksum(versions.version_history(drive.contents(spark, sf_dir)))


def baseline_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote files, of which those with even ids have a history."""
    files = sync.file_checksum(drive.remote(spark, sf_dir))
    history = drive.remote(spark, sf_dir).where("doc_id % 2 = 0").select("path")
    return versions.baseline_missing(files, history)


def stale_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = drive.contents(spark, sf_dir)
    return versions.stale_latest(c, versions.version_history(c))


def rollback_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.rollback_target(drive.contents(spark, sf_dir))


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drive.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.col("event_id").alias("position"))


def resume_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions go through their sidecars' text, a tenth of which can't be read."""
    at = checkpoints.resume_positions(_saved(spark, sf_dir))
    text = F.when(F.col("key") % 10 == 0, F.lit('{"position": ')).otherwise(F.to_json(F.struct("position")))
    return at.select("key", checkpoints.parse_position(text).alias("position"))


def checkpoint_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drive.results(spark, sf_dir)
    return checkpoints.cleanup(done.select("path", F.col("downloaded").alias("position")), done)


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_parse(drive.log_lines(spark, sf_dir)).select("logged_at", "level", "event", "file", "path", "error", "attempt")


def _on_events(op: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return op(logs.log_parse(drive.log_lines(spark, sf_dir)))


def plugin_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the files that were transferred, written and read again."""
    folder = progress.shared_folder(spark)
    writers.append_index(drive.results(spark, sf_dir), "/local", folder)
    return spark.read.option("sep", "\t").schema("name string, local_path string").csv(folder)


_AT = "2024-01-02 03:04:05"
#: Items that a drive may list besides files and folders, and headers that name a length.
ODD_ITEMS = [("a/none", None, "file", "u"), ("a/shut.txt", "shut.txt", "file", None), ("a/fine.txt", "fine.txt", "file", "u"), ("a/dir", "dir", "folder", None), ("a/null", "null", None, None)]
HEADERS = [(1, "17"), (2, None), (3, "many"), (4, "9999999999")]


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it is written, without its details' order."""
    text = results.report(drive.results(spark, sf_dir), F.lit(_AT).cast("timestamp"))
    folder = progress.shared_folder(spark)
    writers.write_report(drive.results(spark, sf_dir), F.lit(_AT).cast("timestamp"), folder)
    back = spark.read.text(folder).select(F.from_json("value", F.schema_of_json(F.lit(text.first()["value"]))).alias("r"))
    return back.select("r.summary.*", F.size("r.details").cast("bigint").alias("n_details"), F.aggregate("r.details", F.lit(0).cast("bigint"), lambda a, d: a + d["size"]).alias("details_size"))


def version_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with their archives' paths, written as a map by path and read again."""
    history = versions.version_history(drive.contents(spark, sf_dir))
    rows = versions.with_archived_path(history, F.lit(_AT).cast("timestamp"))
    folder = progress.shared_folder(spark)
    writers.export_version_map(rows, folder)
    return documents.read_versions(spark, folder).select("path", "version", "checksum", "archived_path", "timestamp")


def record_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with odd event ids are archived after a history that has the even ones."""
    c = drive.contents(spark, sf_dir)
    odd = F.col("seq.event_id") % 2 == 1
    history = versions.version_history(c.where(~odd), "contract")
    return versions.record_versions(history, c.where(odd)).select("path", "version", "checksum")


def saved_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that are saved over earlier ones, without those of completed files, written and read again."""
    done = drive.results(spark, sf_dir)
    early = done.select("path", F.lit(0).cast("bigint").alias("position"))
    new = done.where(drive.doc_id_of() % 2 == 0).select("path", (F.col("size") - 1).alias("position"))
    folder = progress.shared_folder(spark)
    writers.write_checkpoints(early, new, done, folder)
    return spark.read.parquet(folder)


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint files beside documents whose names have spaces, plus and percent signs."""
    d = drive.table(spark, sf_dir, "documents").where("doc_id % 50 = 0")
    name = F.concat(F.lit("a b+c%20 "), F.col("doc_id").cast("string"), F.lit(".txt.download"))
    folder = progress.shared_folder(spark)
    writers.write_files(d.select(name.alias("path"), F.encode(F.to_json(F.struct(F.col("doc_id").alias("position"))), "UTF-8").alias("content")), folder).write.format("noop").mode("overwrite").save()
    return documents.read_checkpoints(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "position")


def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and an empty one, written as a file and read again."""
    folder = progress.shared_folder(spark)
    files = drive.remote(spark, sf_dir).select("path", "content").unionByName(spark.sql("SELECT 'empty.txt' AS path, X'' AS content"))
    writers.write_files(files, folder).write.parquet(f"{folder}.outcome")
    outcome = spark.read.parquet(f"{folder}.outcome")
    back = local.local_state(spark, folder).select("path", F.sha2("content", 256).alias("read"))
    return outcome.join(back, "path", "left").select("path", "size", "checksum", "status", "read")


def _synced(spark: SparkSession, sf_dir: str) -> tuple[session.Session, str]:
    """A whole session: both sides as files, every 13th document's address fails."""
    theirs, mine = progress.shared_folder(spark), progress.shared_folder(spark)
    for side, folder in ((drive.remote(spark, sf_dir), theirs), (drive.local_state(spark, sf_dir), mine)):
        writers.write_files(side.select("path", "content"), folder).write.format("noop").mode("overwrite").save()
    d = drive.doc_id_of()
    url = F.when(d % 13 == 0, "missing:").otherwise(F.concat(F.lit(theirs + "/"), "path"))
    items = local.listing(spark, theirs).withColumn("url", F.when(F.col("type") == "file", url))
    odd = spark.createDataFrame([(p, n, t, u) for p, n, t, u in ODD_ITEMS if n is None or u is None and t == "file"], "path string, name string, type string, url string")
    items = items.unionByName(odd, allowMissingColumns=True)
    return session.sync_session(items, mine, files_transport, sleep=_no_wait), mine


def _no_wait(seconds: float) -> None: ...


def sync_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file of a session, and what the folder then holds."""
    s, folder = _synced(spark, sf_dir)
    after = local.local_state(spark, folder).where("path LIKE '%.txt'").select("path", F.sha2("content", 256).alias("after"))
    return s.results.join(after, "path", "left").select("path", "size", "downloaded", "checksum", "status", "changes", "after")


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a session logs each event."""
    s, _ = _synced(spark, sf_dir)
    return s.events.groupBy(F.get_json_object("body", "$.event").alias("event"), "level").agg(F.count(F.lit(1)).alias("events"))


def sync_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session records: old contents that are archived, and version 0 of new files."""
    s, _ = _synced(spark, sf_dir)
    return s.versions.select("path", "version", "checksum", (F.col("version") > 0).alias("archived"))


def listing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = drive.all_items(spark, sf_dir)
    empty = spark.sql("SELECT 'owned' AS root, 'bare' AS path, '' AS parent, 'bare' AS name, 'folder' AS type, CAST(NULL AS BIGINT) AS size, 1 AS depth")
    asked = spark.createDataFrame([(r,) for r in ("en/src1", "bare", "page_0.html", "nowhere/at/all")], "request string")
    said = inventory.listing_events(items.unionByName(empty), asked)
    more = inventory.shared_listing_event(items).unionByName(inventory.shared_listing_event(items.where("root = 'owned'")))
    every = said.unionByName(more.select(F.lit("shared").alias("request"), "level", "body"))
    contents = F.from_json("body", model.LOG_EVENT)["contents"]
    return every.select("request", "level", F.get_json_object("body", "$.event").alias("event"), F.get_json_object("body", "$.error").alias("error"), F.coalesce(F.size(contents), F.lit(0)).cast("bigint").alias("entries"))


def invalid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame(ODD_ITEMS, "path string, name string, type string, url string")
    return session.invalid_items(items).select("path", "event.level", F.get_json_object("event.body", "$.event").alias("event"))


def once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are listed twice."""
    items = drive.all_items(spark, sf_dir)
    return inventory.once_each(items.unionByName(items)).select("root", "path", "type")


def empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and empty remote files, of which one is there and one isn't."""
    remote = drive.remote(spark, sf_dir).select("path", "size").unionByName(spark.sql("SELECT * FROM VALUES ('e1', 0L), ('e2', 0L), ('e3', 5L) AS t(path, size)"))
    mine = drive.local_state(spark, sf_dir).select("path", "size").unionByName(spark.sql("SELECT * FROM VALUES ('e1', 4L), ('e3', 0L) AS t(path, size)"))
    return sync.sync_plan(remote, mine).where("path LIKE 'e_' OR action <> 'unchanged'").select("path", "action", "bytes")


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as another system writes them, below a root, back to those of the inventory."""
    there = F.concat(F.lit("/data\\drive\\"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")))
    return drive.remote(spark, sf_dir).select("path", scalars.relative_path(scalars.as_posix(there), "/data/drive/").alias("relative"))


def content_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.createDataFrame(HEADERS, "id long, header string")
    return h.select("id", scalars.content_length(F.col("header")).alias("length"))


def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 6).select(F.col("id").alias("attempts"), F.explode(scalars.backoff_schedule(F.col("id"))).alias("seconds"))


def ranges_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that are asked for from files, some of which aren't there."""
    folder = progress.shared_folder(spark)
    writers.write_files(drive.remote(spark, sf_dir).select("path", "content"), folder).write.format("noop").mode("overwrite").save()
    d = drive.doc_id_of()
    asked = drive.plan(spark, sf_dir).where("action <> 'unchanged'").select("path", F.when(d % 13 == 0, "missing:").otherwise(F.concat(F.lit(folder + "/"), "path")).alias("url"), F.floor(F.col("size") / 2).alias("start"), (F.col("size") - 1).alias("end"))
    got = http.fetch_ranges(asked, files_transport, retries=1)
    return got.select("path", "start", F.sha2("piece", 256).alias("sha"), (F.col("error") != "").alias("failed"))


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a second session: what the first failed to transfer."""
    done = drive.results(spark, sf_dir)
    now = sync.after_transfer(drive.local_state(spark, sf_dir), done)
    return sync.sync_plan(drive.remote(spark, sf_dir), now).where("action <> 'unchanged'").select("path", "size", "action", "bytes")


def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.final_positions(spark, sf_dir, "events.parquet")


_QUERIES: dict[str, tuple[Query, str | None]] = {
    "list_children": (list_children, sql("remote shared items", """SELECT parent, name, type FROM items WHERE root = 'owned' AND parent IN ('en', 'en/src1', 'missing')""")),
    "list_shared_roots": (list_shared_roots, sql("shared", """SELECT path AS name, 'file' AS type FROM shared""")),
    "resolve_path": (resolve_path, sql("remote shared items", f"""
        SELECT request, p AS path, CASE WHEN p = '' THEN 'owned' ELSE coalesce(o.root, s.root) END AS root, CASE WHEN p = '' THEN 'folder' ELSE coalesce(o.type, s.type) END AS type,
            coalesce(o.size, s.size) AS size, CASE WHEN p = '' OR o.path IS NOT NULL OR s.path IS NOT NULL THEN 'found' ELSE 'not found' END AS status
        FROM (SELECT request, trim(regexp_replace(request, '/+', '/', 'g'), '/') AS p FROM (SELECT unnest({REQUESTS!r}) AS request)) q
        LEFT JOIN (SELECT * FROM items WHERE root = 'owned') o ON o.path = p LEFT JOIN (SELECT * FROM items WHERE root = 'shared') s ON s.path = p""")),
    "readable_files": (readable_files, sql("remote shared items", """SELECT root, path, size FROM files""")),
    "tree_scan": (tree_scan, sql("remote shared items", """, tree AS (SELECT path, type, 1 AS level FROM items WHERE root = 'owned' AND parent = ''
        UNION ALL SELECT c.path, c.type, t.level + 1 FROM tree t JOIN items c ON c.root = 'owned' AND c.parent = t.path AND t.type = 'folder') SELECT path, type, level FROM tree""")),
    "glob_filter_exclude_wins": (partial(_globbed, filters.filter_files, "exclude_wins"), sql("remote", r"""SELECT path FROM remote WHERE path LIKE '%.txt' AND path NOT LIKE '%/src1/%'""")),
    "glob_filter_no_include": (partial(_globbed, filters.filter_files, "no_include"), sql("remote", r"""SELECT path FROM remote WHERE NOT regexp_full_match(path, '(?s).*1.\.txt')""")),
    "glob_filter_files": (partial(_globbed, filters.filter_files, "ranges"), sql("remote", r"""SELECT path FROM remote WHERE regexp_full_match(path, '(?s)[^e].*/src[0-3]/.*')""")),
    "glob_filter_pruned": (partial(_globbed, filters.filter_pruned, "folder"), sql("remote", """SELECT path FROM remote WHERE path NOT LIKE 'en/src1/%'""")),
    "glob_filter_pruned_root": (partial(_globbed, filters.filter_pruned, "exclude_wins"), sql("remote", """SELECT path FROM remote WHERE false""")),
    "profile_lookup": (profile_lookup, sql("remote", """SELECT path FROM remote WHERE path LIKE '%.txt' AND path NOT LIKE '%/src1/%'""")),
    "profile_as_data": (profile_as_data, sql("remote", """SELECT 'texts' AS profile, path FROM remote WHERE path LIKE '%.txt' AND path NOT LIKE '%/src1/%'
        UNION ALL SELECT 'german', path FROM remote WHERE path LIKE 'de/%' UNION ALL SELECT 'all', path FROM remote""")),
    "sync_plan": (sync_plan, sql("remote local plan", """SELECT path, size, local_size, action, CASE WHEN action = 'unchanged' THEN 0 ELSE size END AS bytes, CAST(action <> 'unchanged' AS BIGINT) AS changes FROM plan""")),
    "sync_plan_summary": (sync_plan_summary, sql("remote local plan", """SELECT action, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM plan GROUP BY action""")),
    "transfer_ranges": (transfer_ranges, sql("remote local plan", """SELECT path, CAST(0 AS BIGINT) AS "start", size - 1 AS "end", size AS length FROM plan WHERE action <> 'unchanged'""")),
    "missed_edits": (missed_edits, sql("remote local plan", """SELECT path FROM plan JOIN remote r USING (path) JOIN local l USING (path) WHERE action = 'unchanged' AND r.content <> l.content""")),
    "chunk_table": (chunk_table, sql("remote", """SELECT path, i AS chunk_idx, i * 1024 AS "start", least(i * 1024 + 1024, size) - 1 AS "end", md5(content[i * 1024 + 1 : i * 1024 + 1024]) AS md5
        FROM (SELECT *, unnest(range(CAST(ceil(size / 1024) AS BIGINT))) AS i FROM remote)""")),
    "chunk_map_last_wins": (chunk_map_last_wins, sql("remote", """SELECT path, md5, max(s) AS "start", max(e) AS "end" FROM (SELECT path, i * 16 AS s, least(i * 16 + 16, size) - 1 AS e, md5(content[i * 16 + 1 : i * 16 + 16]) AS md5
        FROM (SELECT *, unnest(range(CAST(ceil(size / 16) AS BIGINT))) AS i FROM remote)) GROUP BY path, md5""")),
    "delta_ranges": (delta_ranges, sql("remote local", """SELECT path, min(i) * 512 AS "start", least(max(i) * 512 + 512, any_value(size)) - 1 AS "end", count(*) AS chunks FROM (
        SELECT *, i - row_number() OVER (PARTITION BY path ORDER BY i) AS run FROM (
        SELECT r.path, r.size, i FROM (SELECT *, unnest(range(CAST(ceil(size / 512) AS BIGINT))) AS i FROM remote) r LEFT JOIN local l USING (path)
        WHERE r.content[i * 512 + 1 : i * 512 + 512] IS DISTINCT FROM l.content[i * 512 + 1 : i * 512 + 512])) GROUP BY path, run""")),
    "file_checksum": (file_checksum, sql("remote", """SELECT path, sha256(content) AS checksum FROM remote""")),
    "reassemble_checksum": (reassemble_checksum, sql("remote", """SELECT path, sha256(content) AS checksum FROM remote""")),
    "session_summary": (session_summary, sql("remote local plan results", """SELECT count(*) AS total_files, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'failed') AS failed,
        CAST(coalesce(sum(downloaded), 0) AS BIGINT) AS total_bytes_transferred, CAST(coalesce(sum(changes), 0) AS BIGINT) AS total_changed_chunks FROM results""")),
    "session_details": (session_details, sql("remote local plan results", """SELECT * FROM results""")),
    "transferred_mb": (transferred_mb, sql("remote local plan results", """SELECT count(*) AS total_files, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'failed') AS failed,
        printf('%.2f', round_even(coalesce(sum(downloaded), 0) / 1048576.0, 2)) AS megabytes FROM results""")),
    "version_history": (version_history, sql("contents history", """SELECT path, version, checksum FROM history""")),
    "latest_checksum": (latest_checksum, sql("contents history", """SELECT path, version, checksum FROM history WHERE n = total""")),
    "baseline_missing": (baseline_missing, sql("remote", """SELECT path, 0 AS version, sha256(content) AS checksum FROM remote WHERE doc_id % 2 <> 0""")),
    "stale_latest": (stale_latest, sql("contents history", """SELECT h.path, version, h.checksum AS recorded, c.checksum AS current FROM history h JOIN contents c ON c.path = h.path AND c.n = c.total AND h.n = h.total WHERE h.checksum <> c.checksum""")),
    "rollback_target": (rollback_target, sql("contents", """SELECT path, CAST(n - 1 AS INTEGER) AS version, checksum FROM contents WHERE n = total - 1""")),
    "resume_position": (resume_position, """SELECT user_id AS key, CASE WHEN user_id % 10 = 0 THEN 0 ELSE arg_max(event_id, (ts, event_id)) END AS position FROM events GROUP BY user_id"""),
    "checkpoint_cleanup": (checkpoint_cleanup, sql("remote local plan results", """SELECT path, downloaded AS position FROM results WHERE status <> 'completed'""")),
    "log_parse": (log_parse, sql("remote local plan events_logged", """SELECT logged_at, level, event, file, path, error, attempt FROM logged""")),
    "failure_count_dedup": (partial(_on_events, logs.failure_count), sql("remote local plan", """SELECT count(*) AS failures FROM plan WHERE action <> 'unchanged' AND doc_id % 13 = 0""")),
    "real_transfers": (partial(_on_events, logs.real_transfers), sql("remote local plan", """SELECT count(*) AS transfers FROM plan WHERE action <> 'unchanged' AND doc_id % 13 <> 0""")),
    "retryable_errors": (partial(_on_events, logs.retryable_errors), sql("remote local plan events_logged", """SELECT event, file, error, error <> 'Permission denied' AS retryable FROM logged WHERE error IS NOT NULL""")),
    "retry_wait": (partial(_on_events, logs.retry_waits), sql("remote local plan events_logged", """SELECT file, attempt, CAST(CASE WHEN doc_id % 3 = 0 THEN 60 ELSE 2 END AS BIGINT) AS wait_seconds FROM logged WHERE event = 'connection_retry'""")),
    "event_counts": (partial(_on_events, logs.event_counts), sql("remote local plan events_logged", """SELECT event, level, count(*) AS events FROM logged GROUP BY event, level""")),
    "report_text": (report_text, sql("remote local plan results", f"""SELECT count(*) AS total_files, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'failed') AS failed,
        CAST(sum(downloaded) AS BIGINT) AS total_bytes_transferred, CAST(sum(changes) AS BIGINT) AS total_changed_chunks, '{_AT}' AS timestamp, count(*) AS n_details, CAST(sum(size) AS BIGINT) AS details_size FROM results""")),
    "version_map": (version_map, sql("contents history", """SELECT path, version, checksum, CASE WHEN n > 1 THEN '.versions/' || path || '.v' || version || '_20240102T030405' ELSE '' END AS archived_path, '20240102T030405' AS timestamp FROM history""")),
    "record_versions": (record_versions, """, c AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, event_id, md5(concat(event_type, ':', event_id)) AS checksum FROM events),
        e AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ts, event_id) - 1 AS INTEGER) AS version, checksum FROM c WHERE event_id % 2 = 0)
        SELECT * FROM e UNION ALL SELECT path, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS INTEGER), checksum
        FROM c LEFT JOIN (SELECT path, max(version) AS last FROM e GROUP BY path) USING (path) WHERE event_id % 2 = 1""".replace(", c AS", "WITH c AS", 1)),
    "saved_checkpoints": (saved_checkpoints, sql("remote local plan results", """SELECT path, CASE WHEN r.doc_id % 2 = 0 THEN r.size - 1 ELSE 0 END AS position FROM results JOIN remote r USING (path) WHERE status <> 'completed'""")),
    "sidecars": (sidecars, """SELECT concat('a b+c%20 ', doc_id, '.txt') AS name, doc_id AS position FROM documents WHERE doc_id % 50 = 0"""),
    "written_files": (written_files, sql("remote", """SELECT path, size, sha256(content) AS checksum, 'completed' AS status, sha256(content) AS read FROM remote UNION ALL SELECT 'empty.txt', 0, '', 'failed', NULL""")),
    "sync_session": (sync_session, sql("remote local plan results", """SELECT r.path, r.size, downloaded, checksum, status, changes, CASE WHEN status = 'completed' THEN checksum ELSE sha256(l.content) END AS after
        FROM results r LEFT JOIN local l USING (path)""")),
    "sync_events": (sync_events, sql("remote local plan results", """SELECT 'file_unchanged' AS event, 'INFO' AS level, count(*) AS events FROM plan WHERE action = 'unchanged'
        UNION ALL SELECT 'download_success', 'INFO', count(*) FROM plan WHERE action = 'unchanged' OR doc_id % 13 <> 0
        UNION ALL SELECT 'download_failed', 'ERROR', 2 * count(*) FROM results WHERE status = 'failed' UNION ALL SELECT 'invalid_item', 'WARNING', 2""")),
    "sync_versions": (sync_versions, sql("remote local plan results", """SELECT l.path, CAST(1 AS INTEGER) AS version, sha256(l.content) AS checksum, true AS archived FROM results JOIN local l USING (path)
        UNION ALL SELECT path, 0, checksum, false FROM results WHERE status = 'completed' AND path NOT IN (SELECT path FROM local)""")),
    "listing_events": (listing_events, sql("remote shared items", """SELECT 'en/src1' AS request, 'INFO' AS level, 'listing_contents' AS event, NULL AS error, count(*) AS entries FROM items WHERE root = 'owned' AND parent = 'en/src1'
        UNION ALL SELECT 'bare', 'INFO', 'empty_directory', NULL, 0 UNION ALL SELECT 'page_0.html', 'INFO', 'item_info', NULL, 0
        UNION ALL SELECT 'nowhere/at/all', 'ERROR', 'listing_error', 'Path not found: nowhere/at/all', 0
        UNION ALL SELECT 'shared', 'INFO', 'listing_shared_roots', NULL, count(*) FROM shared UNION ALL SELECT 'shared', 'INFO', 'no_shared_items', NULL, 0""")),
    "invalid_items": (invalid_items, """SELECT unnest(['a/none', 'a/shut.txt', 'a/null']) AS path, 'WARNING' AS level, 'invalid_item' AS event"""),
    "once_each": (once_each, sql("remote shared items", """SELECT DISTINCT root, path, type FROM items""")),
    "empty_files": (empty_files, sql("remote local plan", """SELECT path, action, size AS bytes FROM plan WHERE action <> 'unchanged'
        UNION ALL SELECT * FROM (VALUES ('e1', 'unchanged', 0), ('e2', 'unchanged', 0), ('e3', 'new', 5))""")),
    "relative_paths": (relative_paths, sql("remote", """SELECT path, path AS relative FROM remote""")),
    "content_lengths": (content_lengths, """SELECT * FROM (VALUES (1, 17), (2, 0), (3, NULL), (4, 9999999999)) AS t(id, length)"""),
    "backoff": (backoff, """SELECT a AS attempts, CAST(pow(2, i) AS BIGINT) AS seconds FROM range(1, 6) r(a), range(1, 6) s(i) WHERE i <= a"""),
    "ranges_fetched": (ranges_fetched, sql("remote local plan", """SELECT path, size // 2 AS "start", CASE WHEN p.doc_id % 13 = 0 THEN NULL ELSE sha256(content[p.size // 2 + 1 :]) END AS sha, p.doc_id % 13 = 0 AS failed
        FROM (SELECT * FROM plan WHERE action <> 'unchanged') p JOIN (SELECT path, content FROM remote) r USING (path)""")),
    "plugin_index": (plugin_index, sql("remote local plan results", """SELECT string_split(path, '/')[-1] AS name, '/local/' || path AS local_path FROM results WHERE status = 'completed'""")),
    "incremental_sync": (incremental_sync, sql("remote local plan results", """SELECT path, p.size, action, p.size AS bytes FROM plan p JOIN results USING (path) WHERE status = 'failed'""")),
    "progress_stream": (progress_stream, """SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS position FROM events GROUP BY user_id"""),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in _QUERIES.items() if s}
