"""Operator 7: not-modified revisit resolution of web archive records.

A revisit record of a 304 answer has no body.  It is joined as of its time to
the latest earlier full response (status 200) of the same canonical URL.  The
pair's validators must agree: entity tags by weak comparison where both have
one, else Last-Modified dates.  A resolved revisit gets the response's body,
and its headers updated by the permitted ones of the 304 (RFC 9111, 3.2 and
4.3.4: neither connection headers nor those that describe the stored body).

The as-of join never gathers a URL in one task: records are range-partitioned
by (URL, time), each partition carries its own last response forward, and what
earlier partitions end with comes from a table of one row for each URL and
partition.

Records: record_id, kind ('response', 'revisit'), uri, ts (seconds), status,
headers (array of name, value; any order, names in any case), payload.
"Earlier" is strictly earlier; of responses at one time the largest id counts
as the latest.  Outcomes: resolved, validator_mismatch, no_validator,
no_earlier_response, and unplaced for a null uri or ts.  Null headers are
none.  Repeated revisit rows each give a row; of responses that repeat an id
the one that the as-of join chose gives validators, headers and body (of those
that agree in URL, time and validators, too, the smallest headers and body).  Empty tables give empty results; other columns are ignored."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Header fields that a 304 answer does not update.
NOT_UPDATED = (
    "connection proxy-connection keep-alive te trailer transfer-encoding upgrade proxy-authenticate "
    "proxy-authentication-info proxy-authorization content-length content-encoding content-type content-range content-md5"
).split()
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(uri: Column) -> Column:
    """Lower-case scheme and host, no user, default port or fragment, '/' for
    an empty path, query parameters in order."""
    bare = F.regexp_replace(F.trim(uri), "#.*$", "")
    form = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)$"
    scheme = F.lower(F.regexp_extract(bare, form, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, form, 2)), "^.*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    rest = F.regexp_extract(bare, form, 3)
    path = F.regexp_extract(rest, "^[^?]*", 0)
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(rest, "^[^?]*[?](.*)$", 1), "&")), "&")
    return F.when(~bare.rlike(form), bare).otherwise(
        F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path),
                 F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    )


def field(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(old: Column, new: Column) -> Column:
    """Stored headers updated by a 304's permitted ones."""
    listed = F.split(F.lower(F.coalesce(field(new, "connection"), F.lit(""))), "\\s*,\\s*")
    allowed = F.filter(
        new, lambda h: ~F.lower(h["name"]).isin(NOT_UPDATED) & ~F.array_contains(listed, F.lower(h["name"]))
    )
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(old, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url, ref_id, outcome, headers, payload."""
    none = F.array().cast(HEADERS)
    headers = F.filter(F.coalesce(F.col("headers"), none), lambda h: h["name"].isNotNull())
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id", canonical_url(F.col("uri")).alias("url"), F.col("ts").cast("long").alias("ts"), full.alias("full"),
        field(headers, "etag").alias("etag"), field(headers, "last-modified").alias("modified"),
        F.when(~full, headers).alias("headers"),
    )
    fine = F.col("url").isNotNull() & F.col("ts").isNotNull()
    dealt = stored(
        rows.where(fine).repartitionByRange("url", "ts", "full", "record_id").withColumn("part", F.spark_partition_id())
    )
    response = F.when(F.col("full"), F.struct("ts", "record_id", "etag", "modified"))
    before = Window.partitionBy("part", "url").orderBy("ts", "full", "record_id", "etag", "modified").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(response, ignorenulls=True).over(before)).where(~F.col("full"))
    ends = dealt.groupBy("url", "part").agg(F.max(response).alias("end"))
    prior = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(prior)).where("far is not null")
    found = near.join(carried.select("url", "part", "far"), ["url", "part"], "left").withColumn("ref", F.coalesce("near", "far"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    etags = F.col("etag").isNotNull() & F.col("ref.etag").isNotNull()
    dates = F.col("modified").isNotNull() & F.col("ref.modified").isNotNull()
    agree = F.when(etags, tag(F.col("etag")) == tag(F.col("ref.etag"))).when(dates, F.col("modified") == F.col("ref.modified"))
    outcome = F.when(F.col("ref").isNull(), "no_earlier_response").when(agree.isNull(), "no_validator").when(
        agree, "resolved"
    ).otherwise("validator_mismatch")
    judged = found.select(
        "record_id", "url", "headers", F.col("ref.record_id").alias("ref_id"), outcome.alias("outcome"), "ref"
    ).unionByName(
        rows.where(~fine & ~F.col("full")).select(
            "record_id", "url", "headers", F.lit(None).cast(rows.schema["record_id"].dataType).alias("ref_id"),
            F.lit("unplaced").alias("outcome"), F.lit(None).cast(found.schema["ref"].dataType).alias("ref"),
        )
    )
    # Of responses that repeat an id the one whose validators were compared
    # gives headers and body; of those that repeat these, too, the smallest.
    response = F.struct(F.col("ts").cast("long").alias("ts"), "record_id", field(headers, "etag").alias("etag"),
                        field(headers, "last-modified").alias("modified"))
    bodies = records.where(full).select(
        canonical_url(F.col("uri")).alias("at"), response.cast(found.schema["ref"].dataType).alias("r"), headers.alias("stored"), "payload"
    ).groupBy("at", "r").agg(F.min(F.struct("stored", "payload")).alias("own")).select("at", "r", "own.stored", "own.payload")
    # The join's keys are the grouping's, of one type (also in what may be
    # null), so bodies are shuffled once; "=" holds for structs whose equal
    # fields are null.
    joined = judged.where("outcome = 'resolved' and ref_id is not null").join(
        bodies, (F.col("url") == F.col("at")) & (F.col("ref") == F.col("r"))
    )
    done = joined.select(
        "record_id", "url", "ref_id", "outcome", merged_headers(F.col("stored"), F.col("headers")).alias("headers"), "payload"
    )
    rest = judged.where("outcome <> 'resolved'").select(
        "record_id", "url", "ref_id", "outcome", "headers", F.lit(None).cast(records.schema["payload"].dataType).alias("payload")
    )
    return done.unionByName(rest)


def header_block(headers: Column) -> Column:
    """Headers as the lines of a message."""
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n")


def page_records(pages: DataFrame) -> DataFrame:
    """An archive derived from pages: a capture of each page, a later capture
    of every third, and two 304 revisits under other spellings of its URL, by
    rules on the page's id."""
    p = F.coalesce(F.col("page_id"), F.lit(0))
    body = F.coalesce(F.col("html"), F.lit(""))
    start = F.lit(1_600_000_000) + F.pmod(p * 7919, F.lit(1_000_003))
    day = 86_400
    h = lambda *pairs: F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs))
    tag = F.concat(F.lit('"'), F.substring(F.md5(body), 1, 12), F.lit('"'))
    newer = F.concat(F.lit('"'), F.substring(F.md5(F.concat(body, F.lit("v2"))), 1, 12), F.lit('"'))
    stamp = lambda t: F.concat(F.lit("day "), F.floor(t / day).cast("string"))
    first = h(("Content-Type", F.lit("text/html")), ("Content-Length", F.length(body)), ("ETag", F.when(p % 7 != 0, tag)),
              ("Last-Modified", F.when(p % 14 != 0, stamp(start))), ("Cache-Control", F.lit("max-age=60")), ("Server", F.lit("a")))
    again = h(("content-type", F.lit("text/html")), ("etag", F.concat(F.lit("W/"), newer)), ("X-Copy", F.lit("2")))
    second = p % 3 == 0
    current = F.when(second, newer).otherwise(tag)
    seen = h(("ETag", F.when(p % 5 == 0, F.lit('"other"')).when(p % 7 != 0, current)), ("Last-Modified", stamp(start)),
             ("Cache-Control", F.lit("max-age=600")), ("Content-Length", F.lit(0)), ("Connection", F.lit("close, X-Hop")),
             ("X-Hop", F.lit("1")), ("Date", F.concat(F.lit("t"), start.cast("string"))))
    late = F.upper(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0))
    rest = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    records = F.array(
        F.struct((p * 4).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), start.alias("ts"),
                 F.lit(200).alias("status"), F.filter(first, lambda x: x["value"].isNotNull()).alias("headers"), body.alias("payload")),
        F.struct((p * 4 + 1).alias("record_id"), F.when(second, "response").otherwise("other").alias("kind"), F.col("url").alias("uri"),
                 (start + 10 * day).alias("ts"), F.lit(200).alias("status"), again.alias("headers"), F.concat(body, F.lit("v2")).alias("payload")),
        F.struct((p * 4 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(late, rest, F.lit("#part")).alias("uri"),
                 (start + 20 * day).alias("ts"), F.lit(304).alias("status"), F.filter(seen, lambda x: x["value"].isNotNull()).alias("headers"),
                 F.lit(None).cast("string").alias("payload")),
        F.struct((p * 4 + 3).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url").alias("uri"),
                 (start + F.when(p % 11 == 0, -day).otherwise(5 * day)).alias("ts"), F.lit(304).alias("status"),
                 h(("ETag", F.concat(F.lit("W/"), tag))).alias("headers"), F.lit(None).cast("string").alias("payload")),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*").where("kind <> 'other'")
