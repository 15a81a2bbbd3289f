"""WARC: revisit records are resolved to the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Headers that a 304 response may bring up to date (RFC 9111, 3.2 leaves out what describes the stored body).
PERMITTED = ("cache-control", "date", "etag", "expires", "last-modified", "vary", "warning")


#: So many ids of matched responses are sent to all tasks; with more, responses and ids are joined by a shuffle.
BROADCAST_IDS = 200_000
#: A response that more revisits have in common gets a copy of its body for each so many of them.
REVISITS_PER_COPY = 2048


def canonical_url(url: Column) -> Column:
    """Lower case scheme and host, http for https or none, no www. or m., no fragment, no utm_ or ref arguments, no final slash or .html. Null without a host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    front = "^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, front + "([^/?]*)", 1)), "^(?:www|m)\\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, front + "[^/?]*([^?]*)", 1), "(?:/|\\.html)$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(?:utm_[a-z]+|ref)="))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED, spans: int | None = None) -> DataFrame:
    """For each revisit: record_id, url_key, captured_at, response_id, status, headers, payload.

    ``records`` has record_id long, kind ('response' or 'revisit'), url, captured_at timestamp, headers
    map of lower-case names, payload. A revisit looks up the latest response with its canonical URL that
    was captured earlier, by time, then by record_id. status: ``orphan`` if there is none, ``stale``
    if an etag or last-modified of the revisit differs from that of the response, or
    neither can be compared, else ``resolved``. Only resolved ones get the payload, and the response's headers with the permitted ones
    of the revisit over them. Revisits without a host in their URL, or without a time, are orphans; responses without are not
    found; equal records each count; null headers are none; other kinds and columns are ignored; an empty table gives an empty result.

    The records are put in order by URL, time and record_id, in ``spans`` ranges (the shuffle partitions by default) of about as many rows
    each, so a very common URL, however close in time its records are, is spread over tasks. A URL's records of one range are looked through together, and its last
    response of earlier ranges is carried over. Payloads take no part in that; those of matched responses are fetched by record_id afterwards.
    """
    slim = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "captured_at", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    dated = slim.where(F.col("url_key").isNotNull() & F.col("captured_at").isNotNull())
    order = ["url_key", "captured_at", "record_id"]
    ranged = dated.repartitionByRange(spans, *order) if spans else dated.repartitionByRange(*order)
    dated = checkpointed(ranged.withColumn("span", F.spark_partition_id()))
    answer = F.when(F.col("kind") == "response", F.struct("captured_at", F.col("record_id").alias("response_id"), F.col("headers").alias("full_headers")))
    key = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id"))

    within = Window.partitionBy("url_key", "span").orderBy("captured_at", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = dated.withColumn("own", F.last(answer, ignorenulls=True).over(within)).where("kind = 'revisit'")
    # Only URLs that go on in another range have something to carry.
    ends = dated.groupBy("url_key", "span").agg(F.max_by(answer, key).alias("end"))
    by_url = Window.partitionBy("url_key")
    before = by_url.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("first", F.min("span").over(by_url)).select("url_key", "span", F.last("end", ignorenulls=True).over(before).alias("carried"), "first").where("span > first").drop("first")
    found = found.join(carried, ["url_key", "span"], "left").withColumn("match", F.coalesce("own", "carried"))

    def agrees(name: str) -> Column:
        return F.element_at("headers", F.lit(name)) == F.element_at("match.full_headers", F.lit(name))

    tests = [agrees("etag"), agrees("last-modified")]
    good = F.coalesce(*tests).isNotNull() & F.coalesce(tests[0], F.lit(True)) & F.coalesce(tests[1], F.lit(True))
    status = F.when(F.col("match").isNull(), "orphan").when(good, "resolved").otherwise("stale")
    new = F.map_filter("headers", lambda k, v: k.isin(*permitted) & v.isNotNull())
    merged = F.map_concat(F.map_filter("match.full_headers", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    found = found.withColumn("status", status).select("record_id", "url_key", "captured_at", F.col("match.response_id").alias("response_id"), "status", F.when(F.col("status") == "resolved", merged).alias("headers"))
    undated = slim.where(F.col("kind") == "revisit").where(F.col("url_key").isNull() | F.col("captured_at").isNull())
    found = found.unionByName(undated.select("record_id", "url_key", "captured_at", F.lit(None).cast("long").alias("response_id"), F.lit("orphan").alias("status"), F.lit(None).cast("map<string,string>").alias("headers")))

    found = checkpointed(found)
    wanted = found.where("status = 'resolved'").groupBy(F.col("response_id").alias("record_id")).agg(F.ceil(F.count("*") / REVISITS_PER_COPY).cast("int").alias("_copies"))
    wanted = checkpointed(wanted)
    common = wanted.where("_copies > 1").select(F.col("record_id").alias("_common"), "_copies")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    bodies = records.where(F.col("kind") == "response").select("record_id", "payload").join(small(wanted), "record_id")
    # Copied before they are grouped, so that the join finds bodies where the grouping put them and they move once.
    bodies = bodies.select(F.col("record_id").alias("_id"), "payload", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    bodies = bodies.groupBy("_id", "_copy").agg(F.max("payload").alias("payload"))
    # Only resolved revisits are joined: the others have no body to fetch, and would all meet in the task of the null key.
    resolved = found.where("status = 'resolved'").join(small(common), F.col("response_id") == F.col("_common"), "left")
    resolved = resolved.withColumn("_nth", F.pmod(F.xxhash64("record_id", "captured_at"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_common", "_copies")
    resolved = resolved.join(bodies, (F.col("response_id") == F.col("_id")) & (F.col("_nth") == F.col("_copy")), "left").drop("_id", "_nth", "_copy")
    others = found.where("status <> 'resolved'").withColumn("payload", F.lit(None).cast(records.schema["payload"].dataType))
    return resolved.unionByName(others)


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl's records, made from pages: for each a revisit, a response, a revisit, for some a changed response, and one or two more revisits.

    Pages share URLs, and their captures lie among one another, so that the latest earlier response is
    often neither the page's own nor its URL's last. Revisits ask with the etag of the first or of the changed body, or with none; a few
    have a URL without a scheme, an empty or a null one.
    """
    i, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda seconds: F.timestamp_seconds(F.unix_seconds(start) + i * 7919 % 500000 + seconds)
    first, changed = F.md5(body), F.md5(F.concat(body, F.lit("!")))
    none = F.lit(None).cast("string")

    def record(k: int, kind: str, url: Column, seconds, etag: Column | None, payload: Column) -> Column:
        date = F.concat(F.lit(f"{k} "), i.cast("string"))
        pairs = [F.lit("date"), date, F.lit("server"), F.lit(kind)] + ([F.lit("etag"), etag] if etag is not None else []) + ([F.lit("content-type"), F.lit("text/html")] if kind == "response" else [])
        return F.struct((i * 8 + k).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at(seconds).alias("captured_at"), F.create_map(*pairs).alias("headers"), payload.alias("payload"))

    url = F.col("url")
    bare = F.when(i % 17 == 0, F.regexp_replace(url, "^[a-z]+://", "")).otherwise(url)
    odd = F.when(i % 41 == 0, "").when(i % 43 == 0, None).otherwise(url)
    made = [
        record(0, "revisit", url, -100, first, none),
        record(1, "response", url, 0, first, body),
        record(2, "revisit", bare, 1000 + i % 777, first, none),
        F.when(i % 3 == 0, record(3, "response", url, 2000, changed, F.concat(body, F.lit("!")))),
        record(4, "revisit", odd, 3000, F.when(i % 2 == 0, first).otherwise(changed), none),
        F.when(i % 5 == 0, record(5, "revisit", url, 4000, None, none)),
    ]
    return pages.select(F.explode(F.array(*made)).alias("r")).where("r is not null").select("r.*")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, url_key, response_id (-1 where there is none), status, date, server, payload_md5 of all revisits."""
    found = resolve_revisits(crawl_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "url_key", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "status", F.element_at("headers", F.lit("date")).alias("header_date"), F.element_at("headers", F.lit("server")).alias("header_server"), F.md5("payload").alias("payload_md5"))


_FRONT = "^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?"
OP8_SQL = rf"""
WITH p AS (SELECT page_id AS i, url, coalesce(html, '') AS body, page_id * 7919 % 500000 AS t FROM pages),
records AS (
  SELECT i * 8 AS record_id, 'revisit' AS kind, url, t - 100 AS at, md5(body) AS etag, '0 ' || i AS date, NULL AS payload FROM p
  UNION ALL SELECT i * 8 + 1, 'response', url, t, md5(body), '1 ' || i, body FROM p
  UNION ALL SELECT i * 8 + 2, 'revisit', CASE WHEN i % 17 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END, t + 1000 + i % 777, md5(body), '2 ' || i, NULL FROM p
  UNION ALL SELECT i * 8 + 3, 'response', url, t + 2000, md5(body || '!'), '3 ' || i, body || '!' FROM p WHERE i % 3 = 0
  UNION ALL SELECT i * 8 + 4, 'revisit', CASE WHEN i % 41 = 0 THEN '' WHEN i % 43 = 0 THEN NULL ELSE url END, t + 3000, CASE WHEN i % 2 = 0 THEN md5(body) ELSE md5(body || '!') END, '4 ' || i, NULL FROM p
  UNION ALL SELECT i * 8 + 5, 'revisit', url, t + 4000, NULL, '5 ' || i, NULL FROM p WHERE i % 5 = 0),
keyed AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM records),
parts AS (
  SELECT *,
    regexp_replace(lower(regexp_extract(bare, '{_FRONT}([^/?]*)', 1)), '^(?:www|m)\.|:(?:80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(bare, '{_FRONT}[^/?]*([^?]*)', 1), '(?:/|\.html)$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref)='))), '&') AS kept
  FROM keyed),
urls AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url_key FROM parts),
found AS (
  SELECT q.record_id, q.date, q.url_key, q.etag AS ask, a.record_id AS response_id, a.etag AS full_etag, a.payload,
    row_number() OVER (PARTITION BY q.record_id ORDER BY a.at DESC, a.record_id DESC) AS n
  FROM (SELECT * FROM urls WHERE kind = 'revisit') q LEFT JOIN (SELECT * FROM urls WHERE kind = 'response') a ON a.url_key = q.url_key AND (a.at < q.at OR a.at = q.at AND a.record_id < q.record_id))
SELECT record_id, url_key, coalesce(response_id, -1) AS response_id,
  CASE WHEN response_id IS NULL THEN 'orphan' WHEN ask = full_etag THEN 'resolved' ELSE 'stale' END AS status,
  CASE WHEN ask = full_etag THEN date END AS header_date,
  CASE WHEN ask = full_etag THEN 'response' END AS header_server,
  CASE WHEN ask = full_etag THEN md5(payload) END AS payload_md5
FROM found WHERE n = 1
"""
