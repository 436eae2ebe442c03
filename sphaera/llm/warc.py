"""Resolution of not-modified revisits in web archives.

A revisit with status 304 carries no body. It is resolved to the latest earlier full response of its
canonical URL, if its validators allow: the stored headers are then updated by the revisit's, except those
that a 304 may not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.llm.common import ascii_lower

#: Headers of a stored response that a 304 must leave alone, and those of a single connection.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "etag", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change what is served.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"
BUCKET_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Without scheme, "www.", default port, fragment, tracking parameters and trailing slash; host in lower
    case, parameters sorted. Null gives null; what has no "://" is taken as host and path."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    before = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?([\s\S]*)$", 1)
    host = F.regexp_replace(F.regexp_replace(ascii_lower(F.regexp_extract(before, r"^([^/]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(before, r"^[^/]*([\s\S]*)$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit of records(record_id, url, ts, kind, headers, payload_digest), ts in seconds.

    headers is map<string, string> with names in lower case; kind is "response" or "revisit", others are
    ignored. Returns record_id, canonical, ts, response_id, outcome, payload_digest and merged_headers.
    Between full responses of one second the largest record_id counts; a response of the revisit's own second
    is not earlier. outcome: "resolved", "unverified" (the revisit has no validator that the response has as
    well; still resolved), "mismatch" or "missing" (nothing earlier, or a null url or ts); the last two have
    no headers and no digest. Repeated records are records of their own; very long urls are compared whole. Entity tags compare weakly and go before Last-Modified, which goes before the
    payload digest. Columns beyond the six are not looked at.

    A URL's history is dealt out by time: each bucket finds its own latest responses and, from one summary
    row a bucket, the last one before it. No task needs the whole history of a URL.
    """
    base = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload_digest")
    base = base.where(F.col("kind").isin("response", "revisit")).withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    entries = F.array_sort(F.map_entries("headers"))
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", F.col("record_id").alias("id"), F.col("payload_digest").alias("digest"), entries.alias("entries")))
    base = base.withColumn("full", full)
    key = ["canonical", "bucket"]
    here = Window.partitionBy(*key).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = base.withColumn("near", F.max("full").over(here))
    summary = base.where("full is not null and canonical is not null").groupBy(*key).agg(F.max("full").alias("last"))
    # Every bucket that has a revisit needs the last response of an earlier one.
    asked = base.where("kind = 'revisit' and canonical is not null and ts is not null").select(*key).distinct()
    buckets = asked.join(summary, key, "full")
    earlier = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("carry", F.max("last").over(earlier)).select(*key, "carry")
    found = within.where("kind = 'revisit'").join(carried, key, "left")
    found = found.withColumn("hit", F.when(F.col("canonical").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carry")))
    old = F.map_from_entries("hit.entries")
    found = found.withColumn("old", F.when(F.col("hit").isNotNull(), old))
    checks = [
        (_weak(F.col("headers")["etag"]), _weak(F.col("old")["etag"])),
        (F.col("headers")["last-modified"], F.col("old")["last-modified"]),
        (F.col("payload_digest"), F.col("hit.digest")),
    ]
    same = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in checks])
    outcome = F.when(F.col("hit").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    ok = F.col("outcome").isin("resolved", "unverified")
    new = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return found.select(
        "record_id", "canonical", "ts", F.col("hit.id").alias("response_id"), "outcome",
        F.when(ok, F.col("hit.digest")).alias("payload_digest"), F.when(ok, merged).alias("merged_headers"),
    )


def header_lines(headers: Column) -> Column:
    """A header map as sorted "name: value" lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
