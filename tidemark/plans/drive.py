"""A virtual drive over the driver's tables, in Spark and in SQL.

Documents are the remote files, pages the shared ones; the local state, results,
version histories, logs and progress follow by fixed rules, so that every
operator has rows to work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.inventory import inventory
from tidemark.operators.results import results_of
from tidemark.operators.sync import sync_plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    return F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``path``, ``size`` in bytes, ``content``. Reads no text unless sizes or contents are used."""
    content = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), F.octet_length("text").cast("bigint").alias("size"), content.alias("content"))


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(p.alias("path"), F.octet_length("html").cast("bigint").alias("size"))


def local_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files are missing (7), some have another first byte (11), some one byte more (5)."""
    every = lambda n: F.col("doc_id") % n == 0
    c = F.col("content")
    edited = F.when(every(11), F.concat(F.lit(b"Z"), F.substring(c, F.lit(2), F.octet_length(c)))).otherwise(c)
    longer = F.when(every(5), F.concat(edited, F.lit(b"x"))).otherwise(edited)
    size = F.col("size") + F.when(every(5), 1).otherwise(0)
    return remote(spark, sf_dir).where(~every(7)).select("doc_id", "path", size.alias("size"), longer.alias("content"))


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of both trees."""
    return inventory(remote(spark, sf_dir), "owned").unionByName(inventory(shared(spark, sf_dir), "shared"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_plan(remote(spark, sf_dir), local_state(spark, sf_dir))


def doc_id_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"/(\d+)\.txt$", 1).cast("bigint")


def error_of(doc_id: Column) -> Column:
    return F.when(doc_id % 2 == 0, "Remote end closed connection").otherwise("Permission denied")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files to transfer, every 13th failed; checksums are those of the remote contents."""
    sums = remote(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha"))
    planned = plan(spark, sf_dir).where("action <> 'unchanged'").join(sums, "path")
    d = doc_id_of()
    return results_of(planned, d % 13 == 0, error_of(d), F.col("sha"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents in order: each event is a content of its user's file."""
    sum_ = F.md5(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).cast("binary"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id").alias("seq"), sum_.alias("checksum"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text line for each event that a session over the plan logs."""
    d = doc_id_of()
    p = plan(spark, sf_dir).select("path", "action", d.alias("doc_id"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file")
    failed = (F.col("action") != "unchanged") & (F.col("doc_id") % 13 == 0)
    event = lambda level, *fields: F.struct(F.lit(level).alias("level"), F.to_json(F.struct(*fields)).alias("body"))
    said = lambda e: F.lit(e).alias("event")
    err = lambda c: c.alias("error")
    retry_error = F.when(F.col("doc_id") % 3 == 0, "503 Service Unavailable retryAfter: 90").when(F.col("doc_id") % 3 == 1, "Connection reset").otherwise("timeout")
    retry = F.when(F.col("doc_id") % 17 == 0, F.array(event("WARNING", said("connection_retry"), name, F.lit(1).alias("attempt"), F.lit(2).alias("wait_seconds"), err(retry_error)))).otherwise(F.array())
    success = event("INFO", said("download_success"), name, F.col("path"))
    unchanged = F.array(event("INFO", said("file_unchanged"), name, F.col("path")), success)
    failure = F.array(event("ERROR", said("download_failed"), name, err(error_of(F.col("doc_id"))), F.lit("Traceback").alias("traceback")), event("ERROR", said("download_failed"), name, F.col("path")))
    outcome = F.when(F.col("action") == "unchanged", unchanged).when(failed, failure).otherwise(F.array(success))
    lines = p.select("doc_id", F.explode(F.concat(outcome, retry)).alias("e"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")), "yyyy-MM-dd HH:mm:ss")
    return lines.select(F.concat(stamp, F.lit(",000 - "), F.col("e.level"), F.lit(" - "), F.col("e.body")).alias("value"))


#: The same views for SQL. Each query starts from those that it needs.
SQL = {
    "remote": """remote AS (SELECT doc_id, concat(lang, '/', source, '/', doc_id, '.txt') AS path,
        CAST(octet_length(encode(text)) AS BIGINT) AS size, encode(text) AS content FROM documents)""",
    "shared": """shared AS (SELECT concat('page_', page_id, '.html') AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)""",
    "local": """local AS (SELECT doc_id, path, CAST(octet_length(content) AS BIGINT) AS size, content FROM (
        SELECT doc_id, path, CASE WHEN doc_id % 5 = 0 THEN c || 'x'::BLOB ELSE c END AS content FROM (
        SELECT doc_id, path, CASE WHEN doc_id % 11 = 0 THEN 'Z'::BLOB || content[2:] ELSE content END AS c FROM remote WHERE doc_id % 7 <> 0)))""",
    "items": """files AS (SELECT 'owned' AS root, path, size, 'file' AS type FROM remote UNION ALL SELECT 'shared', path, size, 'file' FROM shared),
        dirs AS (SELECT DISTINCT 'owned' AS root, unnest([lang, concat(lang, '/', source)]) AS path, CAST(NULL AS BIGINT) AS size, 'folder' AS type FROM documents),
        items AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent,
            string_split(path, '/')[-1] AS name, len(string_split(path, '/')) AS depth FROM (SELECT * FROM files UNION ALL SELECT * FROM dirs))""",
    "plan": """plan AS (SELECT r.doc_id, r.path, r.size, l.size AS local_size,
        CASE WHEN r.size = 0 THEN 'unchanged' WHEN coalesce(l.size, 0) = 0 THEN 'new' WHEN l.size = r.size THEN 'unchanged' ELSE 'size_changed' END AS action
        FROM remote r LEFT JOIN local l USING (path))""",
    "results": """results AS (SELECT p.path, p.size, CASE WHEN f THEN 0 ELSE p.size END AS downloaded, CASE WHEN f THEN '' ELSE sha256(content) END AS checksum,
        CASE WHEN f THEN 'failed' ELSE 'completed' END AS status, CAST(CASE WHEN f THEN 0 ELSE 1 END AS BIGINT) AS changes,
        CASE WHEN NOT f THEN '' WHEN p.doc_id % 2 = 0 THEN 'Remote end closed connection' ELSE 'Permission denied' END AS error
        FROM (SELECT *, doc_id % 13 = 0 AS f FROM plan WHERE action <> 'unchanged') p JOIN remote USING (path))""",
    "contents": """contents AS (SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        count(*) OVER (PARTITION BY user_id) AS total, md5(concat(event_type, ':', event_id)) AS checksum FROM events)""",
    "history": """history AS (SELECT path, CAST(n - 1 AS INTEGER) AS version, n, total,
        CASE WHEN n = 1 THEN checksum ELSE lag(checksum) OVER (PARTITION BY path ORDER BY n) END AS checksum FROM contents)""",
    "events_logged": """logged AS (
        SELECT strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S,000') AS logged_at, e.level AS level, e.event AS event, e.file AS file,
               e.path AS path, e.error AS error, e.attempt AS attempt, doc_id
        FROM (SELECT doc_id, unnest(CASE
            WHEN action = 'unchanged' THEN [{'level': 'INFO', 'event': 'file_unchanged', 'file': f, 'path': path, 'error': NULL, 'attempt': NULL}, {'level': 'INFO', 'event': 'download_success', 'file': f, 'path': path, 'error': NULL, 'attempt': NULL}]
            WHEN doc_id % 13 = 0 THEN [{'level': 'ERROR', 'event': 'download_failed', 'file': f, 'path': NULL, 'error': CASE WHEN doc_id % 2 = 0 THEN 'Remote end closed connection' ELSE 'Permission denied' END, 'attempt': NULL}, {'level': 'ERROR', 'event': 'download_failed', 'file': f, 'path': path, 'error': NULL, 'attempt': NULL}]
            ELSE [{'level': 'INFO', 'event': 'download_success', 'file': f, 'path': path, 'error': NULL, 'attempt': NULL}] END
            || CASE WHEN doc_id % 17 = 0 THEN [{'level': 'WARNING', 'event': 'connection_retry', 'file': f, 'path': NULL,
                'error': CASE doc_id % 3 WHEN 0 THEN '503 Service Unavailable retryAfter: 90' WHEN 1 THEN 'Connection reset' ELSE 'timeout' END, 'attempt': 1}] ELSE [] END) AS e
          FROM (SELECT *, concat(doc_id, '.txt') AS f FROM plan)))""",
}


def sql(views: str, query: str) -> str:
    """A query over the named views."""
    return "WITH RECURSIVE " + ",\n".join(SQL[v] for v in views.split()) + "\n" + query
