"""WARC: resolving not-modified revisits.

A revisit record says that its page had not changed; its content is that of the latest
earlier full response of the same canonical URL, found by an as-of join.  It is resolved
if the validators agree (entity tags compared weakly, else the last-modified date) and
then takes over the response's payload, with the headers a 304 may update replaced by
the revisit's.

The join is two windows: within a block of time of one URL, and over one row for each
earlier block, so a URL with a third of all records is spread over ``BLOCKS`` groups.
Only headers and digests travel, never payloads.

Defined cases: a null URL or time matches nothing and is matched by nothing; a response
of the same time isn't earlier; of several responses of one time the largest record id
is the latest; a revisit without an earlier response, without a validator, or with
another validator than the latest response's is returned with that status and its own
headers; repeated rows are each resolved; an empty table gives an empty result.  Columns
other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups of time that the records of one URL are dealt to.
BLOCKS = 256
#: Headers that a 304 response can't change in the stored one: of the hop, or of the content.
KEPT_HEADERS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
    "content-encoding", "content-length", "content-md5", "content-range", "content-type",
)
#: Query parameters that don't name another page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """Host and path without scheme, www, default port, fragment and tracking parameters; parameters sorted."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tag(headers: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(headers.getItem("etag"), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """The revisits among ``records`` with the response each refers to.

    ``records``: record_id long, kind string ('response' or 'revisit'), url string, ts
    long, headers map<string,string> with lower-case names, payload_digest string.
    Returns record_id, canonical_url, ts, status ('resolved', 'no_response',
    'no_validator' or 'changed'), refers_to, payload_digest and headers.
    """
    rows = records.select("record_id", "kind", F.col("ts").cast("long").alias("ts"), "headers", "payload_digest", canonical(F.col("url")).alias("canonical_url"))
    # what can match nothing is a group of its own
    lone = F.concat(F.lit("\n"), F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.lit(" "), F.xxhash64("headers.etag", "payload_digest", "kind").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.col("canonical_url")).otherwise(lone))
    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, span = ends["low"] or 0, max(1, ((ends["high"] or 0) - (ends["low"] or 0)) // BLOCKS + 1)
    rows = rows.withColumn("block", F.expr(f"coalesce((ts - {low}L) div {span}L, -1)"))
    full = (F.col("kind") == "response") & F.col("ts").isNotNull()
    own = F.when(full, F.struct("ts", F.col("record_id").alias("id"), F.col("payload_digest").alias("digest"), F.col("headers").alias("fields")))
    rows = rows.withColumn("response", own).withColumn("later", (F.col("kind") == "response").cast("int"))

    latest = F.when(full, F.struct("ts", "record_id"))
    blocks = rows.groupBy("key", "block").agg(F.max_by("response", latest).alias("response"))
    carried = F.last("response", ignorenulls=True).over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("key", "block", carried.alias("carried"))
    before = Window.partitionBy("key", "block").orderBy("ts", "later", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("seen", F.last("response", ignorenulls=True).over(before)).filter("kind = 'revisit'")
    found = seen.join(blocks, ["key", "block"], "left").withColumn("found", F.coalesce("seen", "carried"))

    mine, theirs = F.col("headers"), F.col("found.fields")
    tagged, dated = mine.getItem("etag").isNotNull(), mine.getItem("last-modified").isNotNull()
    agrees = F.when(tagged, _tag(mine) == _tag(theirs)).otherwise(mine.getItem("last-modified") == theirs.getItem("last-modified"))
    status = (
        F.when(F.col("found").isNull(), "no_response").when(~F.coalesce(tagged | dated, F.lit(False)), "no_validator")
        .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("changed")
    )
    none = F.expr("cast(map() as map<string,string>)")
    new = F.map_filter(F.coalesce(mine, none), lambda k, v: ~k.isin(*KEPT_HEADERS))
    old = F.map_filter(F.coalesce(theirs, none), lambda k, v: ~F.map_contains_key(new, k))
    out = found.withColumn("status", status)
    good = F.col("status") == "resolved"
    return out.select(
        "record_id", "canonical_url", "ts", "status", F.when(good, F.col("found.id")).alias("refers_to"),
        F.when(good, F.col("found.digest")).alias("payload_digest"), F.when(good, F.map_concat(old, new)).otherwise(mine).alias("headers"),
    )


#: Captures derived from the pages: each page is a full response, and some are visited
#: again, once or more, with the right entity tag, an outdated one, only a date, or nothing.
#: Pages are folded onto ``page_id % 1000`` versions of a site's paths so that URLs repeat.
RECORDS = """
with captures as (
  select page_id, regexp_replace(url, '[0-9]+', cast(page_id % 97 as string)) url, cast(md5(html) as string) digest, length(html) n from pages
)
select 4 * page_id record_id, 'response' kind, url, 10 * page_id ts, digest payload_digest,
  '"' || substr(digest, 1, 8) || '"' etag, 'day ' || cast(page_id div 50 as string) modified, cast(n as string) n, 'a' server from captures
union all
select 4 * page_id + 1, 'revisit', url, 10 * page_id + 5, cast(null as string),
  case when page_id % 5 = 4 then null when page_id % 3 = 0 then '"old"' else 'W/"' || substr(digest, 1, 8) || '"' end,
  case when page_id % 10 = 4 then 'day ' || cast(page_id div 50 as string) end, '0', 'b' from captures where page_id % 2 = 0
union all
select 4 * page_id + 2, 'revisit', upper(substr(url, 1, 8)) || substr(url, 9) || '#top', 10 * page_id + 4000, cast(null as string),
  '"' || substr(digest, 1, 8) || '"', cast(null as string), '0', 'c' from captures where page_id % 7 = 1
union all
select 4 * page_id + 3, 'revisit', url, 10 * page_id, cast(null as string), '"' || substr(digest, 1, 8) || '"', cast(null as string), '0', 'd'
from captures where page_id % 11 = 3
"""


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("__op6_pages")
    flat = spark.sql(RECORDS.replace("from pages", "from __op6_pages"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("etag", "etag"), ("last-modified", "modified"), ("content-length", "n"), ("server", "server"))))
    records = flat.withColumn("headers", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
    found = resolve(records)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.withColumn("headers", shown)


ORACLE = """
with records as (""" + RECORDS.replace(" div ", " // ").replace("as string)", "as varchar)").replace("'[0-9]+', cast(page_id % 97 as varchar))", "'[0-9]+', cast(page_id % 97 as varchar), 'g')") + """), keyed as (
  select *, regexp_replace(trim(url), '#.*$', '') plain from records
), parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^www[0-9]*\\.', ''), ':(80|443)$', '') host,
    regexp_replace(regexp_extract(plain, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') path,
    list_sort(list_filter(string_split(regexp_extract(plain, '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) q
  from keyed
), named as (
  select *, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end canonical_url from parts
), found as (
  select v.record_id, v.canonical_url, v.ts, v.etag, v.modified, v.n, v.server, r.record_id rid, r.payload_digest rdigest,
    r.etag retag, r.modified rmodified, r.n rn, r.server rserver
  from (select * from named where kind = 'revisit') v
  left join lateral (
    select * from named r where r.kind = 'response' and r.canonical_url = v.canonical_url and r.ts < v.ts
    order by r.ts desc, r.record_id desc limit 1
  ) r on true
), judged as (
  select *, case when rid is null then 'no_response' when etag is null and modified is null then 'no_validator'
    when etag is not null and regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') then 'resolved'
    when etag is null and modified = rmodified then 'resolved' else 'changed' end status
  from found
)
select record_id, canonical_url, ts, status, case when status = 'resolved' then rid end refers_to,
  case when status = 'resolved' then rdigest end payload_digest,
  array_to_string(list_sort(list_filter(case when status = 'resolved'
    then ['etag: ' || coalesce(etag, retag), 'last-modified: ' || coalesce(modified, rmodified), 'content-length: ' || rn, 'server: ' || server]
    else ['etag: ' || etag, 'last-modified: ' || modified, 'content-length: ' || n, 'server: ' || server] end, lambda x: x is not null)), chr(10)) headers
from judged
"""
