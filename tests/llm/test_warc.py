import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.llm import warc

SCHEMA = "record_id long, url string, at timestamp, kind string, headers map<string,string>, digest string"
T0 = datetime(2024, 1, 1)


def lower(h):
    return {k.lower(): v for k, v in sorted((h or {}).items())}


def brute(rows, canonical):
    out = []
    full = [(c, t, i, lower(h), d) for (i, u, t, k, h, d), c in zip(rows, canonical, strict=True) if k == "response" and c is not None and t is not None]
    for (i, _, t, k, h, d), c in zip(rows, canonical, strict=True):
        h = lower(h)
        if k == "response":
            out.append((i, "full", i, d, h))
            continue
        earlier = [x for x in full if x[0] == c and t is not None and ((x[1], x[2]) < (t, i) or (x[1], x[2]) == (t, i))] if k == "revisit" else []
        if not earlier:
            out.append((i, "orphan", None, None, h))
            continue
        _, _, src, fh, fd = max(earlier, key=lambda x: (x[1], x[2], x[4] or ""))
        tag = lambda x: x["etag"].removeprefix("W/") if "etag" in x else None
        ok = tag(h) == tag(fh) if "etag" in h else h["last-modified"] == fh.get("last-modified") if "last-modified" in h else True
        merged = fh | {a: b for a, b in h.items() if a in warc.PERMITTED} if ok else h
        out.append((i, "resolved" if ok else "stale", src, fd if ok else None, merged))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.record_id, r.resolution, r.source_id, r.payload, r.merged) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    urls = ["http://A.com/x", "https://www.a.com:443/x/#f", "a.com/y?b=2&a=1&utm_source=q", "http://a.com:80/y/index.html?a=1&b=2", None]
    rows = []
    for i in range(400):
        hot = rnd.random() < 0.5
        h = rnd.choice([None, {}, {"ETag": rnd.choice("ab"), "Content-Type": "t"}, {"etag": "W/" + rnd.choice("ab"), "Date": str(i)}, {"Last-Modified": rnd.choice("mn"), "VARY": "v"}])
        rows.append((i, urls[0] if hot else rnd.choice(urls), None if rnd.random() < 0.03 else T0 + timedelta(hours=rnd.randrange(400)), rnd.choice(["response", "revisit", "revisit", "revisit", "request"]), h, rnd.choice([None, f"d{i}"])))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = {r.url: r.c for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    want = brute(rows, [key[r[1]] for r in rows])
    for seconds in (3600, 86_400, 10**9):
        assert found(warc.resolve_revisits(df.withColumn("slice", F.lit("x")), slice_seconds=seconds)) == want


def test_canonical(spark):
    same = [
        ["http://Www.A.com:80/P/?b=2&a=1#z", "https://a.com/P?a=1&b=2&utm_campaign=x&ref=y", "a.com/P/index.html?a=1&b=2"],
        ["https://u@x.org", "http://x.org/", "X.ORG/index.htm"],
    ]
    for group in same:
        df = spark.createDataFrame([(u,) for u in group], "u string")
        assert df.select(warc.canonical_url(F.col("u"))).distinct().count() == 1
    df = spark.createDataFrame([("http://a.com/p",), ("http://a.com/P",), ("http://a.com:81/p",), (None,)], "u string")
    assert df.select(warc.canonical_url(F.col("u"))).distinct().count() == 4


def test_no_records(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
