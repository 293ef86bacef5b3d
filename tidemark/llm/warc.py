"""WARC: not-modified revisits resolved to the full response they stand for.

A revisit record says that a server answered "not modified": its content is
that of the latest earlier full response for the same URL. This is an as-of
join by canonical URL. It is done without bringing a URL's records together: a
URL's captures are cut into time slices, each slice is carried forward on its
own, and what a slice ends with reaches the slices after it through one row a
slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize

#: Headers that a not-modified answer may update in the stored response, and parameters that say only where a visitor came from.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = ("utm_[a-z]+", "gclid", "fbclid", "ref")

HEADERS = T.MapType(T.StringType(), T.StringType())


def canonical_url(url: Column) -> Column:
    """A form that is equal for addresses of one resource; null for null.

    Scheme, ``www.``, a port that is the scheme's own, the fragment, tracking
    parameters, an index page and a slash at the end are left out, the host is
    in lower case and the parameters are sorted. The path keeps its case.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www\.", "")
    port = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/(?:index|default)\.html?$", "/"), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{'|'.join(TRACKING)})(?:=|$)"))
    query = F.array_join(F.array_sort(query), "&")
    return F.concat(port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the one that sorts last counts. Null is no headers."""
    e = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast(HEADERS))))
    pairs = F.transform(e, lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda x: x["key"] == n), -1)["value"]))


def validators_agree(revisit: Column, full: Column) -> Column:
    """Whether a revisit's validators are those of a full response (header maps in lower case).

    The first of entity tag (weak and strong forms alike) and modification date
    that the revisit has must be the response's; a revisit without either
    agrees.
    """
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    date = lambda h: F.element_at(h, "last-modified")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return F.when(tag(revisit).isNotNull(), same(tag(revisit), tag(full))).when(date(revisit).isNotNull(), same(date(revisit), date(full))).otherwise(True)


def merged_headers(revisit: Column, full: Column) -> Column:
    """The full response's headers, with those updated that a not-modified answer may update."""
    new = F.map_filter(revisit, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(full, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame, *, slice_seconds: int = 86_400) -> DataFrame:
    """Every record of ``records`` with the full response that answers it.

    ``records`` has ``record_id`` (long), ``url``, ``at`` (timestamp), ``kind``
    ("response" or "revisit"), ``headers`` (map) and ``digest`` (of the
    payload). Added: ``canonical``, ``source_id`` (a response's own id; for a
    revisit that of the latest earlier response), ``resolution`` ("full",
    "resolved", "stale" where the validators disagree, "orphan" where there is
    none), ``payload`` (the digest of what was seen; null if stale or orphan)
    and ``merged`` (headers). Other columns are dropped.

    Earlier is by time, then record id, so of records at one time the lower ids
    come first. A record without URL or time is never joined: a revisit is an
    orphan. Other kinds than these are orphans, too. Null headers are none;
    repeated records each stay; no records give none.

    A slice is ``slice_seconds`` of a URL's captures; a URL with very many has
    many slices, which are sorted in different tasks.
    """
    r = records.select("record_id", "url", "at", "kind", lower_keys(F.col("headers")).alias("headers"), "digest")
    r = r.withColumn("canonical", canonical_url(F.col("url"))).withColumn("slice", F.floor(F.unix_timestamp("at") / slice_seconds))
    full = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull() & F.col("at").isNotNull(), F.struct("at", "record_id", "headers", "digest"))
    # Read by four branches: written once, without what the records' source is computed from.
    r = materialize(r.withColumn("full", full), "records")
    joinable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    # The latest response of each slice, and for each slice that of the ones before it.
    ends = r.where(joinable).groupBy("canonical", "slice").agg(F.max(F.when(F.col("full").isNotNull(), F.struct("at", "record_id"))).alias("end"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("came", F.max("end").over(before)).where("came IS NOT NULL").select("canonical", "slice", "came")
    within = Window.partitionBy("canonical", "slice").orderBy("at", "record_id", F.when(F.col("kind") == "response", 0).otherwise(1), "digest").rowsBetween(Window.unboundedPreceding, -1)
    own = r.where(joinable).withColumn("own", F.last("full", ignorenulls=True).over(within))
    # A response that is carried into another slice is looked up by its key; most need none.
    wanted = own.where("kind = 'revisit' AND own IS NULL").join(carried, ["canonical", "slice"]).select("canonical", "slice", "came").distinct()
    held = r.where("full IS NOT NULL").select("canonical", F.struct("at", "record_id").alias("came"), "full").groupBy("canonical", "came").agg(F.max_by("full", F.coalesce("full.digest", F.lit(""))).alias("came_full"))
    looked = wanted.join(held, ["canonical", "came"]).select("canonical", "slice", "came_full")
    joined = own.join(looked, ["canonical", "slice"], "left").withColumn("source", F.coalesce("own", "came_full")).drop("own", "came_full")
    rest = r.where(~joinable).withColumn("source", F.lit(None).cast(r.schema["full"].dataType))
    out = joined.unionByName(rest)
    is_full, is_revisit, has = F.col("kind") == "response", F.coalesce(F.col("kind") == "revisit", F.lit(False)), F.col("source").isNotNull()
    agree = validators_agree(F.col("headers"), F.col("source.headers"))
    resolution = F.when(is_full, "full").when(is_revisit & has & agree, "resolved").when(is_revisit & has, "stale").otherwise("orphan")
    out = out.withColumn("resolution", resolution)
    return out.select(
        "record_id", "url", "at", "kind", "canonical", "resolution",
        F.when(is_full, F.col("record_id")).when(is_revisit, F.col("source.record_id")).alias("source_id"),
        F.when(is_full, F.col("digest")).when(F.col("resolution") == "resolved", F.col("source.digest")).alias("payload"),
        F.when(F.col("resolution") == "resolved", merged_headers(F.col("headers"), F.col("source.headers"))).otherwise(F.col("headers")).alias("merged"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records made of the raw pages, as the pages' table has one capture of each only.

    Each page is a full response, with the digest of its HTML as its entity
    tag, and is visited again three times: an hour later, unchanged; nine days
    later under another spelling of its address, with other permitted and other
    headers; and before the first capture. Every seventh page's second visit
    has another entity tag, so it is stale.

    A null HTML is empty; a page without id or address has records without them,
    which nothing joins; repeated pages have repeated records; no pages give
    none; other columns are left out.
    """
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id"), F.lit(5000)) * 60)
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    seven = F.col("page_id") % 7 == 0
    headers = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    visit = lambda n, at, kind, u, h: F.struct(F.lit(n).alias("n"), at.alias("at"), F.lit(kind).alias("kind"), u.alias("u"), h.alias("headers"))
    url, other = F.col("url"), F.when(seven, F.lit("other")).otherwise(tag)
    visits = F.array(
        visit(0, start, "response", url, headers("ETag", tag, "Content-Type", "text/html", "Date", "d0")),
        visit(1, start + F.expr("INTERVAL 1 HOUR"), "revisit", url, headers("etag", F.concat(F.lit("W/"), tag), "Date", "d1")),
        visit(2, start + F.expr("INTERVAL 9 DAYS"), "revisit", F.concat(url, F.lit("#later")), headers("ETag", other, "Date", "d2", "Content-Type", "text/plain", "Vary", "accept")),
        visit(3, start - F.expr("INTERVAL 2 DAYS"), "revisit", url, headers("Date", "d3")),
    )
    each = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.explode(visits).alias("v"))
    full = F.col("v.kind") == "response"
    return each.select((F.col("page_id") * 4 + F.col("v.n")).alias("record_id"), F.col("v.u").alias("url"), F.col("v.at").alias("at"), F.col("v.kind").alias("kind"), F.col("v.headers").alias("headers"), F.when(full, F.col("digest")).alias("digest"))
