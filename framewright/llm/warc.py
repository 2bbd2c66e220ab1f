"""Operator 4: resolution of not-modified revisits by an as-of join on canonical URLs.

A revisit (a 304 answer) is resolved to the latest strictly earlier full response of the
same canonical URL if its validators match: a revisit's ETag must equal the response's
(weak comparison), else its Last-Modified must; without a common validator nothing is
concluded. The stored headers are then updated by those that a 304 may change (RFC 9111,
section 3.2).

The as-of join is skew-proof: captures fall into time ranges of equal share (by quantiles of all
capture times), one for each `rows_each` captures, MOST at most. A window over (URL, range)
finds earlier responses in the same range; the last response of each (URL, range) is carried
forward over the ranges, a row for each range at most. So of a URL with a third of all captures a
window holds about a third of `rows_each` rows, and beyond MOST ranges one that Spark sorts on
disk. Bodies take no part; `with_bodies` joins them afterwards.

Status: "resolved", "mismatch" (the latest response has other validators), "unverified" (no
common validator), "unmatched" (no earlier response), "full" for full responses.

Header names have no case: values of names that differ in case only are joined by ", " in the
order of the names as written (cookies by line ends; RFC 9110, section 5.3).

Nulls and rows: a null URL or time matches nothing; null headers are empty; a header without a
value keeps none; very long URLs and headers are handled like any other; among responses of one time the largest record id counts; repeated rows are each returned; an
empty table gives an empty result; further columns are kept (those named like a new one are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

ROWS_EACH, MOST = 500_000, 4096
#: Ranges are found in two steps, each by so many comparisons.
_STEP = 64
#: Query parameters that only track.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)"
#: Headers that a 304 must not change (RFC 9111, section 3.2; RFC 9110, section 7.6.1).
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host (lower case, no www., default port or user), path without trailing slash, sorted query without tracking."""
    rest = F.regexp_replace(F.split(F.trim(url), "#").getItem(0), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^[^@]*@|^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def folded(headers: Column) -> Column:
    """Headers by lower-case name."""
    entry = "struct<key:string,value:string>"
    every = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    laid = F.array_sort(F.transform(every, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("own"), e["value"].alias("value"))))

    def step(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        between = F.when(e["key"] == "set-cookie", "\n").otherwise(", ")
        both = F.when(last["value"].isNull(), e["value"]).when(e["value"].isNull(), last["value"]).otherwise(F.concat(last["value"], between, e["value"]))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(e["key"].alias("key"), both.alias("value")).cast(entry)))
        fresh = F.concat(acc, F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")).cast(entry)))
        return F.when(F.size(acc) == 0, fresh).when(last["key"] == e["key"], joined).otherwise(fresh)

    return F.map_from_entries(F.aggregate(laid, F.array().cast(f"array<{entry}>"), step))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, updated by the fresh ones that may change."""
    new = F.map_filter(folded(fresh), lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(folded(stored), lambda k, v: ~F.map_contains_key(new, k)), new)


def time_range(ts: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most ts (null: 0)."""
    array = lambda x: F.array(*[F.lit(c).cast("long") for c in x]).cast("array<bigint>")
    upto = lambda x: F.size(F.filter(x, lambda c: c <= ts))
    if len(cuts) <= _STEP:
        return F.when(ts.isNull(), 0).otherwise(upto(array(cuts)))
    group = upto(array(cuts[::_STEP]))
    within = upto(F.slice(array(cuts), (group - 1) * _STEP + 1, _STEP))
    return F.when(ts.isNull() | (group == 0), 0).otherwise((group - 1) * _STEP + within)


def resolved(records: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """records (record_id, url, ts: long, kind, etag, last_modified, headers) with canonical, status, resolved_id and merged."""
    ranges = max(1, min(MOST, -(-records.count() // rows_each)))
    shares = [i / ranges for i in range(1, ranges)]
    found_cuts = records.agg(F.percentile_approx("ts", shares, 20_000)).first()[0] if shares else None
    cuts = sorted(set(found_cuts or []))
    canonical = F.when(F.col("ts").isNotNull(), canonical_url(F.col("url")))
    own, span, full, near, last, before = (free_name(records, n) for n in ("_key", "_range", "_full", "_near", "_last", "_carried"))
    # A row that can match nothing gets a key of its own, so that no window gathers such rows.
    key = F.coalesce(canonical, F.concat(F.lit("\x00"), F.xxhash64("record_id", F.monotonically_increasing_id()).cast("string")))
    at = records.withColumns({"canonical": canonical, own: key, span: time_range(F.col("ts"), cuts)})
    response = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", F.array_sort(F.map_entries("headers")).alias("headers")))
    at = at.withColumn(full, response)
    within = Window.partitionBy(own, span).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    # Each range's last response holds from the next range in which the URL occurs.
    spans = at.groupBy(own, span).agg(F.max(full).alias(last))
    carried = spans.withColumn(before, F.max(last).over(Window.partitionBy(own).orderBy(span).rowsBetween(Window.unboundedPreceding, -1))).select(own, span, before)
    out = at.withColumn(near, F.max(full).over(within)).join(carried.where(F.col(before).isNotNull()).hint("merge"), [own, span], "left")
    found = F.coalesce(near, before)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    by_tag = F.col("etag").isNotNull() & found["etag"].isNotNull()
    by_date = F.col("last_modified").isNotNull() & found["last_modified"].isNotNull()
    same = F.when(by_tag, weak(F.col("etag")) == weak(found["etag"])).when(by_date, F.col("last_modified") == found["last_modified"])
    status = F.when(F.col("kind") == "response", "full").when(found.isNull(), "unmatched").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    out = out.withColumn("status", status)
    ok = F.col("status") == "resolved"
    merged = F.when(ok, merged_headers(F.map_from_entries(found["headers"]), F.col("headers"))).when(F.col("kind") == "response", merged_headers(F.col("headers"), F.lit(None).cast("map<string,string>")))
    out = out.withColumns({"resolved_id": F.when(ok, found["record_id"]), "merged": merged})
    return out.drop(own, span, full, near, before)


def with_bodies(answers: DataFrame, bodies: DataFrame, body: str = "body") -> DataFrame:
    """answers with the body of the response that each is resolved to (its own for a full one); bodies: record_id, body."""
    of, own = free_name(answers, "_of"), free_name(answers, "_id")
    kept = [c for c in answers.columns if c.lower() != body.lower()]
    got = answers.select(*kept).withColumn(of, F.coalesce("resolved_id", F.when(F.col("status") == "full", F.col("record_id"))))
    return got.join(bodies.select(F.col("record_id").alias(own), F.col(body)), F.col(of) == F.col(own), "left").drop(of, own)


def captures(pages: DataFrame, gap: int = 401) -> DataFrame:
    """A crawl of `pages`: each is fetched in full at 2 * page_id and asked for again, with its validators, `gap` later."""
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), tag.alias("etag"), (2 * F.col("page_id")).cast("long").alias("at"))
    base = base.select("page_id", "url", "etag", "at", F.explode(F.array(F.lit("response"), F.lit("revisit"))).alias("kind"))
    full = F.col("kind") == "response"
    when = F.when(full, F.col("at")).otherwise(F.col("at") + gap)
    stamp = when.cast("string")
    headers = F.when(full, F.create_map(F.lit("ETag"), F.col("etag"), F.lit("Date"), stamp, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"))).otherwise(F.create_map(F.lit("ETag"), F.col("etag"), F.lit("Date"), stamp, F.lit("Content-Type"), F.lit("text/plain"), F.lit("Expires"), stamp))
    return base.select(F.when(full, 2 * F.col("page_id")).otherwise(2 * F.col("page_id") + 1).alias("record_id"), "page_id", "url", when.alias("ts"), "kind", F.when(full, F.col("etag")).otherwise(F.concat(F.lit("W/"), F.col("etag"))).alias("etag"), F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"))


def report(pages: DataFrame) -> DataFrame:
    """One row for each revisit of the crawl: page_id, canonical URL, status, the page resolved to, merged headers."""
    got = resolved(captures(pages)).where("kind = 'revisit'")
    line = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return got.select("page_id", "canonical", "status", F.shiftright("resolved_id", 1).alias("response_page_id"), F.when(F.col("merged").isNotNull(), line).alias("headers"))


ORACLE = r"""
WITH base AS (
  SELECT page_id, '"' || md5(html) || '"' AS tag, 2 * page_id AS fetched,
    regexp_replace(split_part(trim(url), '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), parts AS (
  SELECT page_id, tag, fetched,
    regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^[^@]*@|^www\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)'))) AS q
  FROM base
), urls AS (
  SELECT page_id, tag, fetched, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
  FROM parts
), found AS (
  SELECT v.page_id, v.canonical, v.tag, v.fetched + 401 AS again, r.page_id AS response, r.tag AS response_tag
  FROM urls v LEFT JOIN urls r ON r.canonical = v.canonical AND r.fetched < v.fetched + 401
  QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY r.fetched DESC NULLS LAST) = 1
)
SELECT page_id, canonical,
  CASE WHEN response IS NULL THEN 'unmatched' WHEN tag = response_tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN tag = response_tag THEN response END AS response_page_id,
  CASE WHEN tag = response_tag THEN 'cache-control: max-age=60; content-type: text/html; date: ' || again || '; etag: ' || tag || '; expires: ' || again END AS headers
FROM found
"""
