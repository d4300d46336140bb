"""Not-modified revisits of a web archive, resolved to the full responses that they stand for.

A revisit record (HTTP 304) is joined as of its time with the latest earlier full response of the same canonical URL. Its
validators are checked against that response and the headers that a 304 may update are merged into the response's headers.

The as-of join keeps one URL from landing in one task: records are range-partitioned by (URL, time), so a hot URL spans as many
partitions as it has rows for. Within a partition the last full response is a window over the partition's rows of a URL. Only
the first URL of a partition can continue from the one before, so what is carried over is at most one row for each partition;
that bounds what is broadcast. The rows that move hold headers, never payloads: a response is named by its record id and digest.

Defined edge cases: a record without a URL has no base (`no_base`); a full response at the very time of a revisit is not
earlier; of full responses at one time the largest record id counts; a revisit without any validator in common with its base is
`unchecked` and takes its URL's word; entity tags are compared weakly (W/ is ignored) and go before dates; if both state a digest, it must
be the same whatever the other validators say; null header maps are empty; repeated rows
get equal rows; an empty table gives an empty result; columns other than those named pass by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialize, partitions

#: Headers that a 304 response may update (RFC 9110, 15.4.5, and RFC 9111, 3.2), in lower case.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't name content.
IGNORED_PARAMETERS = r"^(utm_[a-z]+|gclid|fbclid|sid|sessionid|jsessionid|phpsessid)(=|$)"


#: Hexadecimal codes of the characters that RFC 3986 calls unreserved.
UNRESERVED = "^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)$"


def plain_escapes(text) -> F.Column:
    """Percent-encodings in one form (RFC 3986, 6.2.2): unreserved characters are written out, the others' codes in upper case."""
    code = lambda p: F.upper(F.substring(p, 1, 2))
    shown = lambda p: F.when(code(p).rlike(UNRESERVED), F.char(F.conv(code(p), 16, 10).cast("int"))).otherwise(F.concat(F.lit("%"), code(p)))
    one = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(shown(p), F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p))
    parts = F.split(text, "%")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")


def without_dots(path) -> F.Column:
    """A path without its `.` and `..` segments (RFC 3986, 5.2.4)."""
    none = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    step = lambda done, s: F.when(s == ".", done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s)))
    made = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(F.contains(path, F.lit("/.")), made).otherwise(path)


def canonical_url(url) -> F.Column:
    """Host, path and query of a URL in one form: no scheme, `www`, default port, fragment, dot segments, tracking parameter or closing
    slash; percent-encodings by RFC 3986; host in lower case, parameters sorted. Null, empty and blank URLs give null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = plain_escapes(F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(without_dots(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(IGNORED_PARAMETERS)))
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(out != "", out)


def _bare_tag(tag) -> F.Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def last_full_response(records: DataFrame) -> DataFrame:
    """`records` (with url_key not null, ts, record_id, is_full, and any columns in the struct `full`, null unless is_full)
    with `base`: the `full` of the latest earlier full response of the same url_key."""
    spark = records.sparkSession
    order = ["ts", "is_full", "record_id"]
    ranged = records.repartitionByRange(partitions(spark), "url_key", *order).withColumn("pid", F.spark_partition_id())
    ranged = materialize(ranged, "revisit-ranges")
    # The last full response of each URL in each partition; needed for URLs that begin a partition only.
    firsts = ranged.groupBy("pid").agg(F.min("url_key").alias("url_key"))
    ends = ranged.where("is_full").groupBy("pid", "url_key").agg(F.max_by("full", F.struct("ts", "record_id")).alias("full"))
    open_ = firsts.select("url_key").distinct()
    ends = ends.join(F.broadcast(open_), "url_key", "left_semi").unionByName(firsts.withColumn("full", F.lit(None)), allowMissingColumns=True)
    ends = ends.groupBy("pid", "url_key").agg(F.max("full").alias("full"))
    before = Window.partitionBy("url_key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("full", ignorenulls=True).over(before)).where("carried IS NOT NULL").select("pid", "url_key", "carried")
    carried = materialize(carried, "revisit-carried")
    inside = Window.partitionBy("pid", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("inside", F.last("full", ignorenulls=True).over(inside)).join(F.broadcast(carried), ["pid", "url_key"], "left")
    return found.withColumn("base", F.coalesce("inside", "carried")).drop("pid", "inside", "carried")


def resolve(records: DataFrame) -> DataFrame:
    """Resolve `records`: record_id long, uri, ts long, is_full boolean, etag, last_modified, digest, headers map<string,string>
    (names in lower case).

    Returns record_id, url_key, ts, outcome (`full`, `resolved`, `mismatch`, `unchecked`, `no_base`), base_id (the full response
    that a resolved or unchecked revisit stands for, its own id if full), digest (that response's) and headers (merged).
    """
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    rows = records.select(
        "record_id", canonical_url(F.col("uri")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.coalesce("is_full", F.lit(False)).alias("is_full"),
        "etag", "last_modified", "digest", headers.alias("headers"),
    )
    # Header maps can't be compared, so they travel as arrays of entries.
    full = F.when(F.col("is_full"), F.struct("ts", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("entries")))
    rows = rows.withColumn("full", full)
    named = last_full_response(rows.where("url_key IS NOT NULL"))
    nameless = rows.where("url_key IS NULL").withColumn("base", F.lit(None).cast(full_type(rows)))
    found = named.unionByName(nameless)
    tags = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    digests = F.col("digest").isNotNull() & F.col("base.digest").isNotNull()
    same_digest = F.col("digest") == F.col("base.digest")
    same = F.when(digests & ~same_digest, F.lit(False)).when(tags, _bare_tag(F.col("etag")) == _bare_tag(F.col("base.etag")))
    same = same.when(dates, F.col("last_modified") == F.col("base.last_modified")).when(digests, same_digest)
    outcome = F.when(F.col("is_full"), "full").when(F.col("base").isNull(), "no_base").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    stands = F.col("outcome").isin("resolved", "unchecked")
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.map_from_entries("base.entries"), lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return found.select(
        "record_id", "url_key", "ts", "outcome",
        F.when(stands, F.col("base.record_id")).when(F.col("is_full"), F.col("record_id")).alias("base_id"),
        F.when(stands, F.col("base.digest")).when(F.col("is_full"), F.col("digest")).alias("digest"),
        F.when(stands, F.map_concat(kept, update)).otherwise(F.col("headers")).alias("headers"),
    )


def full_type(rows: DataFrame) -> str:
    return rows.schema["full"].dataType.simpleString()


def header_text(headers) -> F.Column:
    """A header map as one line for each header, sorted."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """A capture log made from `pages` (page_id, url, html): a full response of most pages, and a later revisit of every page by
    another spelling of its URL, some with a changed entity tag, some with none, some with the digest or another one."""
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", digest.alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    n = F.col("page_id")
    hour = F.lit(1_700_000_000) + (n % 97) * 3600
    modified = F.when(n % 3 != 0, F.concat(F.lit("day "), (n % 97).cast("string")))
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    quoted = text('"', F.col("digest"), '"')
    full = rows.where(n % 11 != 0).select(
        (n * 2).alias("record_id"), F.col("url").alias("uri"), hour.cast("long").alias("ts"), F.lit(True).alias("is_full"), quoted.alias("etag"), modified.alias("last_modified"), "digest",
        F.create_map(
            F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.col("size").cast("string"), F.lit("content-type"), F.lit("text/html"),
            F.lit("date"), hour.cast("string"), F.lit("etag"), quoted,
        ).alias("headers"),
    )
    later = hour + 60 * (1 + n % 5)
    tag = F.when(n % 7 == 0, F.lit('"changed"')).when(n % 7 > 2, text("W/", quoted))
    spelled = F.when(n % 5 == 0, F.replace("url", F.lit("/en/"), F.lit("/x/../%65n/./"))).otherwise(F.col("url"))
    stated = F.when(n % 13 == 0, F.col("digest")).when(n % 17 == 0, F.lit("another"))
    again = rows.select(
        (n * 2 + 1).alias("record_id"), text(F.regexp_replace(spelled, "^https?://", "HTTPS://WWW."), "#again").alias("uri"), later.cast("long").alias("ts"), F.lit(False).alias("is_full"),
        tag.alias("etag"), modified.alias("last_modified"), stated.alias("digest"),
        F.map_filter(
            F.create_map(F.lit("cache-control"), F.lit("max-age=90"), F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("etag"), tag), lambda k, v: v.isNotNull()
        ).alias("headers"),
    )
    return full.unionByName(again)
