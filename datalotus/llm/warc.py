"""WARC: resolution of not-modified revisit records.

A revisit says "as at an earlier capture". Each one is joined, as of its date, to
the latest earlier full response of its canonical URL. If the revisit's validators
don't contradict that response, it takes over the response's payload and those of
its headers that a 304 answer may not replace; permitted headers come from the
revisit.

Input columns: record_id, kind ('response' or 'revisit'; others are ignored),
uri, date (orderable), etag, last_modified, headers (map of lower-case name to
value), digest (of the payload), and any others.

Result per revisit: record_id, canonical, date, refers_to (record_id of the
response), status, digest (payload of the response), headers (merged). status:
'resolved', 'no_response' (none is earlier), 'etag_mismatch',
'modified_mismatch', 'no_validator' (neither side names a common validator).
Weak tags compare equal to strong ones (RFC 9110, 8.8.3.2). A response at the
same date is earlier only if its record_id is smaller.

Scale: only ids, validators and headers are moved, never payloads. The as-of join
runs in (URL, time slice) windows; a slice's last response is carried to later
slices by a second window over one row per slice. A URL with a third of all
records is thus spread over its slices.

Defined cases: a null uri never matches; a null date sorts first; null headers
count as none; repeated records each get their row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields a 304 answer updates in the stored response (RFC 9111, 3.2 and 4.3.4).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
SLICE_SECONDS = 3600


def canonical(uri: Column) -> Column:
    """Host in lower case, no scheme, user, default port, fragment, session-free
    query in sorted order, no trailing slash."""
    bare = F.regexp_replace(F.trim(uri), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?@]*@)?([^/?]*)", 1), ":(80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i)(sid|sessionid|phpsessid|jsessionid|utm_[a-z]+|ref)="))), "&")
    return F.when(uri.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    slim = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical(F.col("uri")).alias("canonical"), "date", "etag", "last_modified", "headers", "digest")
    slim = slim.withColumn("slice", F.coalesce(F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / slice_seconds), F.lit(-(1 << 60))))
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers", "digest", "date"))
    # rows without a URL are spread by their id, since they can't match
    spread = F.when(F.col("canonical").isNull(), F.xxhash64("record_id")).otherwise(F.lit(0).cast("long"))
    marked = slim.withColumns({"full": full, "spread": spread})
    group = ["canonical", "spread", "slice"]
    upto = Window.partitionBy(*group).orderBy(F.col("date").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("found", F.last("full", ignorenulls=True).over(upto)).where("kind = 'revisit'")
    last = marked.where("kind = 'response' and canonical is not null").groupBy(*group).agg(F.max_by("full", F.struct(F.col("date").isNotNull(), "date", "record_id")).alias("full"))
    asked = near.where("found is null and canonical is not null").select(*group).distinct().withColumn("full", F.lit(None).cast(last.schema["full"].dataType))
    # one row per slice: the last response before it
    ahead = Window.partitionBy("canonical", "spread").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = last.unionByName(asked).groupBy(*group).agg(F.first("full", ignorenulls=True).alias("full"))
    carried = slices.withColumn("carried", F.last("full", ignorenulls=True).over(ahead)).select(*group, "carried")
    joined = near.join(carried, group, "left")
    got = F.when(F.col("canonical").isNotNull(), F.coalesce("found", "carried"))
    r = joined.withColumn("got", got)
    tags = F.col("etag").isNotNull() & F.col("got.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("got.last_modified").isNotNull()
    status = (
        F.when(F.col("got").isNull(), "no_response")
        .when(tags & (_strong(F.col("etag")) != _strong(F.col("got.etag"))), "etag_mismatch")
        .when(~tags & dates & (F.col("last_modified") != F.col("got.last_modified")), "modified_mismatch")
        .when(~tags & ~dates, "no_validator")
        .otherwise("resolved")
    )
    empty = F.create_map().cast("map<string,string>")
    own, old = F.coalesce("headers", empty), F.coalesce("got.headers", empty)
    new = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    ok = F.col("status") == "resolved"
    return r.withColumn("status", status).select(
        "record_id", "canonical", "date", F.when(F.col("status") != "no_response", F.col("got.record_id")).alias("refers_to"), "status",
        F.when(ok, F.col("got.digest")).alias("digest"), F.when(ok, merged).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload_col: str = "payload") -> DataFrame:
    """`resolved` with the payload of the response; joined by the response's id."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col(payload_col).alias("payload"))
    return resolved.join(bodies.dropDuplicates(["refers_to"]), "refers_to", "left").withColumn("payload", F.when(F.col("status") == "resolved", F.col("payload")))
