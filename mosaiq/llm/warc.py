"""Not-modified revisits of web archives, resolved to the latest earlier full response of the same
canonical URL.

The as-of join is a prefix scan in two levels: records are dealt by URL and time bucket, so that one
URL's records spread over many tasks; within a bucket a window finds the latest response, and each
bucket's last response is carried to the URL's later buckets. Payloads take no part in it.

Earlier means a smaller (ts, record_id). A null ts comes before all others. A null or empty URL is
never resolved. Responses are full with status 200 and a payload digest.

status: resolved (a validator in common, none in conflict), mismatch (a validator differs),
unverified (no validator in common), missing (no earlier full response).
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sketch import _tree

#: Header fields that a 304 response may carry on to the stored one.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
HEADERS = "array<struct<name:string,value:string>>"
#: Query parameters that name no other resource.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, `www.`, fragment, tracking parameters and final slash; host
    in lower case; other parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.lower(F.regexp_extract(path, "^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(path, "^[^/]*(/.*)$", 1), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, rest, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """records: record_id long, type (response or revisit), ts long, url, status int, etag,
    last_modified, digest, headers (array of name and value). A row for each revisit: its record_id,
    url, canonical, ts, the status of its resolution, refers_to (the response's record_id), digest of
    the payload and the merged headers; the last three null unless resolved."""
    spark = records.sparkSession
    buckets = buckets or max(2, min(256, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = records.select(F.col("record_id").cast("long"), "type", F.coalesce(F.col("ts").cast("long"), F.lit(-(2**63))).alias("ts"), "url", canonical_url(F.col("url")).alias("canonical"), F.col("status").cast("int"), "etag", "last_modified", "digest", F.coalesce(F.col("headers").cast(HEADERS), F.array().cast(HEADERS)).alias("headers"))
    rows = rows.where((F.col("type") == "revisit") | ((F.col("type") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull()))
    found = rows.agg(F.percentile_approx("ts", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("b")).first()["b"]
    rows = rows.withColumn("bucket", -_tree(F.col("ts"), sorted(set(found or []), reverse=True)))
    full = (F.col("type") == "response") & (F.col("canonical") != "")
    response = F.when(full, F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    local = W.partitionBy("canonical", "bucket").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    here = rows.withColumn("near", F.last(response, ignorenulls=True).over(local)).where(F.col("type") == "revisit")
    ends = rows.where(full).groupBy("canonical", "bucket").agg(F.max_by(F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"), F.struct("ts", "record_id")).alias("last"))
    # a URL has a row for each bucket at most
    steps = ends.withColumn("until", F.lead("bucket").over(W.partitionBy("canonical").orderBy("bucket"))).select("canonical", "bucket", "until", "last")
    later = rows.where((F.col("type") == "revisit") & (F.col("canonical") != "")).select("canonical", "bucket").distinct().join(steps.withColumnRenamed("bucket", "since"), "canonical").where((F.col("since") < F.col("bucket")) & (F.col("until").isNull() | (F.col("until") >= F.col("bucket")))).select("canonical", "bucket", F.col("last").alias("far"))
    joined = here.join(later, ["canonical", "bucket"], "left").withColumn("r", F.coalesce("near", "far"))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = [(weak(F.col("etag")), weak(F.col("r.etag"))), (F.col("last_modified"), F.col("r.last_modified")), (F.col("digest"), F.col("r.digest"))]
    differ = F.lit(False)
    agree = F.lit(False)
    for a, b in pairs:
        differ = differ | F.coalesce(a != b, F.lit(False))
        agree = agree | F.coalesce(a == b, F.lit(False))
    state = F.when(F.col("r").isNull(), "missing").when(differ, "mismatch").when(agree, "resolved").otherwise("unverified")
    allowed = F.filter("headers", lambda h: F.lower(h["name"]).isin(PERMITTED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    merged = F.concat(F.filter("r.headers", lambda h: ~F.array_contains(F.col("names"), F.coalesce(F.lower(h["name"]), F.lit("")))), F.col("allowed"))
    done = F.col("state") == "resolved"
    return joined.withColumns({"state": state, "allowed": allowed}).withColumn("names", names).select(
        "record_id", "url", "canonical", F.when(F.col("ts") != -(2**63), F.col("ts")).alias("ts"), F.col("state").alias("status"), F.when(done, F.col("r.record_id")).alias("refers_to"), F.when(done, F.col("r.digest")).alias("digest"), F.when(done, merged).alias("headers"))


def crawl(pages: DataFrame, again: int = 5000) -> DataFrame:
    """A crawl log made from pages: a response for each page at the time page_id, and a revisit of its
    URL `again` time steps later that names the validators of that response."""
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", etag.alias("etag"), F.sha2("html", 256).alias("digest"))
    none = F.lit(None).cast("string")
    first = p.select((2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("type"), F.col("page_id").alias("ts"), "url", F.lit(200).alias("status"), "etag", none.alias("last_modified"), "digest", F.array(head("Content-Type", F.lit("text/html")), head("Date", F.col("page_id")), head("ETag", F.col("etag"))).alias("headers"))
    second = p.select((2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("type"), (F.col("page_id") + again).alias("ts"), "url", F.lit(304).alias("status"), F.concat(F.lit("W/"), F.col("etag")).alias("etag"), none.alias("last_modified"), none.alias("digest"), F.array(head("Content-Length", F.lit("0")), head("Date", F.col("page_id") + again), head("ETag", F.col("etag")), head("Cache-Control", F.lit("max-age=60"))).alias("headers"))
    return first.unionByName(second)


REVISIT_SQL = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(html) || '"' AS etag, sha256(html) AS digest,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(bare, '\?.*$', '') AS path, regexp_extract(bare, '\?(.*)$', 1) AS query FROM p),
u AS (
  SELECT page_id, url, etag, digest,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(path, '^([^/]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(path, '^[^/]*(/.*)$', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&') AS kept FROM q),
k AS (SELECT page_id, url, etag, digest, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM u),
j AS (
  SELECT v.page_id, v.url, v.canonical, v.etag, r.page_id AS rp, r.etag AS re, r.digest AS rd,
    row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS n
  FROM k v LEFT JOIN k r ON r.canonical = v.canonical AND r.canonical <> '' AND r.digest IS NOT NULL AND r.page_id < v.page_id + 5000)
SELECT 2 * page_id + 1 AS record_id, url, canonical, page_id + 5000 AS ts,
  CASE WHEN rp IS NULL THEN 'missing' WHEN etag <> re THEN 'mismatch' WHEN etag = re THEN 'resolved' ELSE 'unverified' END AS status,
  CASE WHEN etag = re THEN 2 * rp END AS refers_to, CASE WHEN etag = re THEN rd END AS digest,
  CASE WHEN etag = re THEN 'Content-Type=text/html;Date=' || (page_id + 5000) || ';ETag=' || etag || ';Cache-Control=max-age=60' END AS headers
FROM j WHERE n = 1
"""


def header_text(headers: str) -> Column:
    """Header fields as name=value, joined by semicolons."""
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit("="), F.coalesce(h["value"], F.lit("")))), ";")


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or with gzip members: WARC header fields, HTTP status and header
    fields, and the payload. What comes after a damaged record's start is left out."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))

    def fields() -> list[tuple[str, str]]:
        out = []
        while (line := stream.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out.append((name.strip(), value.strip()))
        return out

    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        warc = {k.lower(): v for k, v in fields()}
        body = stream.read(int(warc.get("content-length", 0) or 0))
        head, _, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
        lines = head.decode("latin-1").split("\r\n")
        status = lines[0].split(" ")[1:2] if head else []
        yield {"warc": warc, "status": int(status[0]) if status and status[0].isdigit() else None, "headers": [tuple(x.strip() for x in h.partition(":")[::2]) for h in lines[1:]], "payload": payload}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as resolve_revisits() takes them, with payload; one file a task at a time."""
    schema = f"record_id long, type string, ts long, url string, status int, etag string, last_modified string, digest string, headers {HEADERS}, payload binary, warc_id string"

    def run(frames):
        import datetime

        import pandas as pd
        import xxhash

        for f in frames:
            for data in f["content"]:
                rows = []
                for r in parse_warc(bytes(data)):
                    w, h = r["warc"], {k.lower(): v for k, v in r["headers"]}
                    when = w.get("warc-date")
                    ts = int(datetime.datetime.fromisoformat(when.replace("Z", "+00:00")).timestamp()) if when else None
                    rows.append((xxhash.xxh64_intdigest(w.get("warc-record-id", "")) >> 1, w.get("warc-type"), ts, w.get("warc-target-uri"), r["status"], h.get("etag"), h.get("last-modified"), w.get("warc-payload-digest"), [{"name": a, "value": b} for a, b in r["headers"]], r["payload"], w.get("warc-record-id")))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("record_id", "type", "ts", "url", "status", "etag", "last_modified", "digest", "headers", "payload", "warc_id")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
