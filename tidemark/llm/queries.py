"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import digest_conversations
from tidemark.llm.common import shared_dir, table
from tidemark.llm.decontamination import annotate_contamination
from tidemark.llm.fingerprints import edited_and_next
from tidemark.llm.ledger import BASE_KINDS, RULES, Ledger, joined, scan_versions
from tidemark.llm.packing import pack
from tidemark.llm.pii import pseudonymize
from tidemark.llm.quality import annotate_quality
from tidemark.llm.quality import fit as fit_quality
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.toxicity import annotate_toxicity, fit
from tidemark.llm.warc import captures_of_pages, resolve_revisits


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = annotate_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
         FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS p FROM i)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
          FROM (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT rid, p, grams.n AS n, item_id FROM grams JOIN wins USING (n, g)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM occ) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return annotate_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are the versions of a new ledger in the shared folder."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    found, _ = scan_versions(table(spark, sf_dir, "documents"), ledger, key=["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _spans_sql(order: int, kind: str, pattern: str, keep: str, group: int = 0, before: int = 0) -> str:
    """A select of the spans of a kind: matches lie where the texts between them end.

    ``before`` is a group of what stands before the span itself.
    """
    p = pattern.replace("'", "''")
    lead = f"length(coalesce(regexp_extract_all(text, '{p}', {before})[k], ''))" if before else "0"
    return f"""SELECT rid, {order} AS o, '{kind}' AS kind, {lead} + pos AS a, pos + length(m[k]) AS b FROM (
      SELECT rid, text, m, k, list_sum([length(x) for x in gaps[:k]]) + coalesce(list_sum([length(x) for x in m[:k - 1]]), 0) AS pos, v[k] AS value FROM (
        SELECT rid, text, m, v, gaps, unnest(generate_series(1, len(m))) AS k FROM (
          SELECT rid, text, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS gaps FROM d)))
    WHERE {keep}"""


_OP3_SPANS = " UNION ALL ".join([
    _spans_sql(0, "assign", RULES[0].pattern, "length(value) >= 6", 2),
    _spans_sql(1, "access", "AKIA[A-Z0-9]+", "length(value) >= 20"),
    _spans_sql(2, "hex", "[0-9a-f]+", "length(value) >= 24"),
    _spans_sql(3, "pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "true"),
    _spans_sql(4, "github", "gh[pousr]_[A-Za-z0-9]+", "length(value) >= 40"),
    _spans_sql(5, "jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true", 0, 1),
])
_LISTED = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o)"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_OP3_SPANS}),
g AS (SELECT rid, {_LISTED} AS spans, {_LISTED} FILTER (o < 3) AS base, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex
      FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("record_id", "canonical", "resolution", "source_id", "payload", headers.alias("headers"))


OP5_SQL = r"""
WITH p AS (SELECT *, 1700000000 + (page_id % 5000) * 60 AS s, md5(coalesce(html, '')) AS tag, sha256(coalesce(html, '')) AS sha FROM pages),
r AS (
  SELECT page_id * 4 AS record_id, url, s AS ts, 'response' AS kind, tag AS etag, 'text/html' AS ctype, 'd0' AS d, NULL AS vary, sha AS digest FROM p
  UNION ALL SELECT page_id * 4 + 1, url, s + 3600, 'revisit', 'W/' || tag, NULL, 'd1', NULL, NULL FROM p
  UNION ALL SELECT page_id * 4 + 2, url || '#later', s + 9 * 86400, 'revisit', CASE WHEN page_id % 7 = 0 THEN 'other' ELSE tag END, 'text/plain', 'd2', 'accept', NULL FROM p
  UNION ALL SELECT page_id * 4 + 3, url, s - 2 * 86400, 'revisit', NULL, NULL, 'd3', NULL, NULL FROM p),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u0 FROM r),
v AS (SELECT *, lower(regexp_extract(u0, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(u0, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u),
w AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www\.', '') AS host,
        regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/(?:index|default)\.html?$', '/'), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|$)'))), '&') AS q FROM v),
c AS (SELECT *, CASE scheme WHEN 'https' THEN regexp_replace(host, ':443$', '') WHEN 'http' THEN regexp_replace(host, ':80$', '') ELSE host END
        || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM w),
f AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'digest': digest} END IGNORE NULLS)
        OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM c),
g AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN src IS NULL OR canonical IS NULL THEN 'orphan'
        WHEN etag IS NULL OR regexp_replace(etag, '^W/', '') = src.etag THEN 'resolved' ELSE 'stale' END AS resolution FROM f),
h AS (SELECT *, CASE WHEN resolution = 'resolved' THEN 'text/html' ELSE ctype END AS ct, CASE WHEN resolution = 'resolved' THEN coalesce(etag, src.etag) ELSE etag END AS et FROM g)
SELECT record_id, canonical, resolution, CASE WHEN kind = 'response' THEN record_id ELSE src.id END AS source_id,
       CASE WHEN kind = 'response' THEN digest WHEN resolution = 'resolved' THEN src.digest END AS payload,
       concat_ws(';', 'content-type=' || ct, 'date=' || d, 'etag=' || et, 'vary=' || vary) AS headers
FROM h
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_tokenizer() -> str:
    """Where this machine has the tokenizer file that packing uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return annotate_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digest_conversations(turns.unionByName(more))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
              + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 17 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is fixed so that the result is; who uses the operator keeps one secret."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), b"tidemark query")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_toxicity": op2_toxicity,
        "op3_secrets": op3_secrets,
        "op4_fingerprints": op4_fingerprints,
        "op5_revisits": op5_revisits,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_chat": op9_chat,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op3_secrets": OP3_SQL,
        "op5_revisits": OP5_SQL,
        "op9_chat": OP9_SQL,
    }
