"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed; the page itself is in the latest earlier full
response for the same canonical URL. The revisit holds if its validators agree with that
response's, and then the response's headers are updated with those the revisit may set.

The as-of join moves no payloads. Captures of a URL are windowed one day at a time; what
precedes a day is the last response of the days before, found over one row per URL and day. So
no task gathers all captures of a URL, however often it was crawled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified answer must not change, as they describe its
#: own connection or the content that it does not carry.
KEPT_FIELDS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, index page, slash at the
    end and tracking parameters; the host lowered, other parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), r"(/index\.html?|/)$", "")
    asked = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    asked = F.array_sort(F.filter(asked, lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""))


def _field(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, sent: Column) -> Column:
    """The stored header map with the fields that the revisit may set."""
    allowed = F.map_filter(sent, lambda k, v: ~k.isin(*KEPT_FIELDS))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, refers_to, outcome, headers, payload_digest``.

    ``records`` has ``record_id, kind ('response' or 'revisit'), url, captured timestamp, status
    int, headers map<string,string> (lower-case names), payload_digest``. Full responses have
    status 200. The latest one strictly before the revisit counts, of several at one time that
    with the largest id. If the revisit has an entity tag it must equal the response's, weakly
    compared; else its modification date, if any; a revisit without either is taken on trust.

    ``outcome`` is ``resolved``, ``validators differ`` (``refers_to`` names the response, the
    headers are the revisit's own) or ``no earlier response`` (so for null URLs and times, too).
    ``payload_digest`` is null unless resolved. Null headers count as none. Repeated records give
    repeated rows. Other columns are left out.
    """
    slim = records.select(
        "record_id",
        (F.col("kind") == "revisit").alias("revisit"),
        canonical_url(F.col("url")).alias("page"),
        "captured",
        "status",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "payload_digest",
    ).where(F.col("revisit") | ((F.col("kind") == "response") & (F.col("status") == 200)))
    full = F.struct("captured", "record_id", "headers", "payload_digest")
    placed = slim.where(F.col("page").isNotNull() & F.col("captured").isNotNull())
    placed = placed.select(
        "*", F.to_date("captured").alias("day"), F.when(~F.col("revisit"), full).alias("response")
    )
    # A response at the very time of a revisit is not before it.
    within = (
        Window.partitionBy("page", "day")
        .orderBy("captured", F.col("revisit").desc(), "record_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same_day = placed.withColumn("found", F.last("response", ignorenulls=True).over(within)).where("revisit")
    by_day = placed.groupBy("page", "day").agg(
        F.max_by("response", F.when(~F.col("revisit"), F.struct("captured", "record_id"))).alias("last")
    )
    before = Window.partitionBy("page").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_day.select("page", "day", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = same_day.join(carried, ["page", "day"], "left").select(
        "record_id", "headers", F.coalesce("found", "carried").alias("found")
    )
    lost = slim.where(F.col("revisit") & (F.col("page").isNull() | F.col("captured").isNull()))
    found = found.unionByName(lost.select("record_id", "headers", F.lit(None).cast(found.schema["found"].dataType).alias("found")))
    sent, stored = F.col("headers"), F.col("found.headers")
    agrees = F.when(
        _field(sent, "etag").isNotNull(), F.coalesce(_weak(_field(sent, "etag")) == _weak(_field(stored, "etag")), F.lit(False))
    ).otherwise(
        _field(sent, "last-modified").isNull()
        | F.coalesce(_field(sent, "last-modified") == _field(stored, "last-modified"), F.lit(False))
    )
    resolved = F.col("outcome") == "resolved"
    return found.withColumn(
        "outcome",
        F.when(F.col("found").isNull(), "no earlier response").when(agrees, "resolved").otherwise("validators differ"),
    ).select(
        "record_id",
        F.col("found.record_id").alias("refers_to"),
        "outcome",
        F.when(resolved, merged_headers(stored, sent)).otherwise(sent).alias("headers"),
        F.when(resolved, F.col("found.payload_digest")).alias("payload_digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from a table of pages: every page is a response, some are captured again
    in full, and most are revisited with validators, written differently, that may be out of date."""
    tag, start = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda minutes: F.timestamp_seconds(F.unix_timestamp(start) + (F.col("page_id") + minutes) * 60)
    modified = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))

    def some(condition: str, n: int, kind: str, url: Column, minutes: int, status: int, headers: list[Column]) -> DataFrame:
        return pages.where(condition).select(
            (F.col("page_id") * 4 + n).alias("record_id"),
            F.lit(kind).alias("kind"),
            url.alias("url"),
            at(minutes).alias("captured"),
            F.lit(status).alias("status"),
            F.map_filter(F.create_map(*headers), lambda k, v: v.isNotNull()).alias("headers"),
            F.when(F.lit(status == 200), F.sha2("html", 256)).alias("payload_digest"),
        )

    url = F.col("url")
    full = [F.lit("content-type"), F.lit("text/html"), F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("no-cache")]
    sent_tag = F.when(F.col("page_id") % 7 == 0, F.lit('"old"')).when(F.col("page_id") % 3 != 0, F.concat(F.lit("W/"), tag))
    fields = [
        F.lit("etag"), sent_tag, F.lit("last-modified"), modified, F.lit("content-length"), F.lit("0"),
        F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("page_id") % 1000).cast("string")),
    ]
    again = F.concat(url, F.when(url.contains("#"), "").when(url.contains("?"), "&utm_medium=x").otherwise("?utm_medium=x"))
    return (
        some("true", 0, "response", url, 0, 200, [F.lit("etag"), tag, *full])
        .unionByName(some("page_id % 11 = 0", 1, "response", url, 720, 200, [F.lit("etag"), F.lit('"new"'), *full]))
        .unionByName(some("page_id % 5 <> 0", 2, "revisit", again, 1440, 304, fields))
        .unionByName(some("page_id % 13 = 0", 3, "revisit", url, -1440, 304, fields))
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, html, url, '"' || md5(html) || '"' AS tag, 'day ' || (page_id % 28) AS modified FROM pages),
r AS (
  SELECT page_id * 4 AS id, false AS revisit, url, page_id AS t, tag, modified, 'no-cache' AS cache, sha256(html) AS digest FROM p
  UNION ALL SELECT page_id * 4 + 1, false, url, page_id + 720, '"new"', modified, 'no-cache', sha256(html) FROM p WHERE page_id % 11 = 0
  UNION ALL SELECT page_id * 4 + 2, true,
    url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_medium=x' ELSE '?utm_medium=x' END, page_id + 1440,
    CASE WHEN page_id % 7 = 0 THEN '"old"' WHEN page_id % 3 <> 0 THEN tag END, modified, 'max-age=' || (page_id % 1000), NULL
    FROM p WHERE page_id % 5 <> 0
  UNION ALL SELECT page_id * 4 + 3, true, url, page_id - 1440,
    CASE WHEN page_id % 7 = 0 THEN '"old"' WHEN page_id % 3 <> 0 THEN tag END, modified, 'max-age=' || (page_id % 1000), NULL
    FROM p WHERE page_id % 13 = 0),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(/index\.html?|/)$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS asked FROM b),
k AS (SELECT *, place || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS page FROM c),
j AS (
  SELECT v.*, f.id AS refers_to, f.tag AS f_tag, f.modified AS f_modified, f.digest AS f_digest,
    row_number() OVER (PARTITION BY v.id ORDER BY f.t DESC NULLS LAST, f.id DESC) AS n
  FROM (SELECT * FROM k WHERE revisit) v LEFT JOIN (SELECT * FROM k WHERE NOT revisit) f ON v.page = f.page AND f.t < v.t),
o AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'no earlier response'
    WHEN CASE WHEN tag IS NOT NULL THEN tag = f_tag ELSE modified = f_modified END THEN 'resolved'
    ELSE 'validators differ' END AS outcome FROM j WHERE n = 1)
SELECT id AS record_id, refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || cache || chr(10) || 'content-type: text/html' || chr(10) || 'etag: '
      || CASE WHEN tag IS NULL THEN f_tag WHEN tag = '"old"' THEN tag ELSE 'W/' || tag END || chr(10) || 'last-modified: ' || modified
    ELSE 'cache-control: ' || cache || chr(10) || 'content-length: 0' || chr(10)
      || CASE WHEN tag IS NULL THEN '' WHEN tag = '"old"' THEN 'etag: ' || tag || chr(10) ELSE 'etag: W/' || tag || chr(10) END
      || 'last-modified: ' || modified END AS headers,
  CASE WHEN outcome = 'resolved' THEN f_digest END AS payload_sha256
FROM o
"""
