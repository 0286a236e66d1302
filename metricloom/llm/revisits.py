"""Not-modified revisit records resolved to the response they stand for (operator 7).

A revisit record of a crawl (status 304) has no body. It is joined, by canonical URL, to the latest
earlier full response (200 to 299, but not 206), whose validators are then checked: entity tags by weak
comparison if both records have one, else the dates of last modification if both have one. A resolved
record gets the response's headers, updated by those of the revisit that a 304 may change.

The as-of join sorts all records by URL and time into ranges. Within a range a window carries the last
response forward. A URL that goes on in the next range takes up what the ranges before it ended with: one
row for each URL and range. So a URL with any share of all records is spread over as many ranges as
its records fill. Bodies do not travel; only DataFrame operations are used.

Rows: a response at the time of the revisit is not earlier. Of responses at one time the one with the
greatest record id counts. Records with null URL or null time have no earlier response. Null headers are
none; header names are compared in lower case. Repeated rows stay. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm.common import fold, stored

#: Headers of a 304 that describe the message or the stored body itself, and so never replace those of the response.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "^(utm_[^=]*|gclid|fbclid|sessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without its last slash, parameters
    sorted and without those for tracking; no scheme and no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    short = F.regexp_replace(F.regexp_replace(fold(host), "^www[.]", ""), ":(80|443)$", "")
    return F.concat(short, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by the revisit's permitted ones; names in lower case."""
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    low = lambda m: F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(fold(e["key"]).alias("key"), e["value"].alias("value"))), none)
    new = F.filter(low(revisit), lambda e: ~e["key"].isin(*FIXED_HEADERS))
    old = F.filter(low(response), lambda e: ~F.array_contains(F.transform(new, lambda x: x["key"]), e["key"]))
    return F.array_sort(F.concat(old, new))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each row of ``records`` whose kind is ``revisit``.

    ``records``: record_id, url, ts, kind (``response`` or ``revisit``), status, etag, last_modified, headers
    (map). Result: record_id, canonical, ts, refers_to (record id), outcome (``resolved``, ``mismatch``,
    ``unverified`` for records without common validators, ``no_response``) and headers (pairs by name).
    """
    full = (F.col("kind") == "response") & F.col("status").between(200, 299) & (F.col("status") != 206)
    narrow = records.where(full | (F.col("kind") == "revisit")).select(
        canonical_url(F.col("url")).alias("canonical"), "ts", (F.col("kind") == "response").alias("is_response"), "record_id", "etag", "last_modified", "headers"
    )
    order = ["canonical", "ts", "is_response", "record_id"]  # at one time revisits come before responses
    ranged = stored(narrow.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "crawl")
    usable = F.col("is_response") & F.col("ts").isNotNull()
    response = F.when(usable, F.struct("record_id", "etag", "last_modified", "headers"))
    known = ranged.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull())
    before = Window.partitionBy("range", "canonical").orderBy("ts", "is_response", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = known.withColumn("found", F.last(response, ignorenulls=True).over(before)).where(~F.col("is_response"))
    ends = known.groupBy("canonical", "range").agg(F.max_by(response, F.when(usable, F.struct("ts", "record_id"))).alias("end"))
    # only URLs that go on in another range need what came before: one row for each of their ranges
    spread = ends.groupBy("canonical").agg(F.min("range").alias("low"), F.max("range").alias("high")).where("low < high").select("canonical")
    earlier = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(spread, "canonical", "left_semi").select("canonical", "range", F.last("end", ignorenulls=True).over(earlier).alias("carry")).where("carry is not null")
    joined = within.join(carried, ["canonical", "range"], "left").withColumn("found", F.coalesce("found", "carry")).drop("carry")
    lost = ranged.where(~F.col("is_response") & (F.col("canonical").isNull() | F.col("ts").isNull()))
    every = joined.unionByName(lost.withColumn("found", F.lit(None).cast(joined.schema["found"].dataType)))
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    agrees = F.when(tags, _tag(F.col("etag")) == _tag(F.col("found.etag"))).when(dates, F.col("last_modified") == F.col("found.last_modified"))
    outcome = F.when(F.col("found").isNull(), "no_response").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    own = merged_headers(F.lit(None).cast("map<string,string>"), F.col("headers"))
    return every.select(
        "record_id", "canonical", "ts", F.col("found.record_id").alias("refers_to"), outcome.alias("outcome"),
        F.when(outcome == "resolved", merged_headers(F.col("found.headers"), F.col("headers"))).otherwise(own).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: every page is a full response, at its id in minutes, and is asked for
    again 1 to 30 days later; every 17th has also been asked for a second before. By the page's id some
    revisits have a weak tag (5), no tag (7), another tag (11) or no validator at all (13)."""
    i, day = F.col("page_id"), 86400
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    base = pages.select("page_id", "url", tag.alias("tag"), F.length(F.coalesce(F.col("html"), F.lit(""))).alias("size"), (i * 60).alias("at"))
    date = lambda x: F.concat(F.lit("t"), x.cast("string"))
    shared = [F.lit("cache-control"), F.lit("date")]
    response = base.select(
        (i * 4).alias("record_id"), "url", F.col("at").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.col("tag").alias("etag"), date(F.col("at") - day).alias("last_modified"),
        F.map_from_arrays(F.array(*shared, F.lit("content-length"), F.lit("content-type")), F.array(F.lit("max-age=60"), date(F.col("at")), F.col("size").cast("string"), F.lit("text/html"))).alias("headers"),
    )
    sent = F.when(i % 13 == 0, None).when(i % 11 == 0, '"changed"').when(i % 7 == 0, None).when(i % 5 == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag"))
    dated = F.when(i % 13 != 0, date(F.col("at") - day))
    times = F.array_compact(F.array((F.col("at") + (i % 30 + 1) * day), F.when(i % 17 == 0, F.col("at") - 1)))
    asked = base.select("*", F.posexplode(times).alias("n", "ts"))
    revisit = asked.select(
        (i * 4 + 1 + F.col("n")).alias("record_id"), "url", "ts", F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent.alias("etag"), dated.alias("last_modified"),
        F.map_from_arrays(F.array(*shared, F.lit("Content-Length"), F.lit("vary")), F.array(F.lit("max-age=600"), date(F.col("ts")), F.lit("0"), F.lit("accept"))).alias("headers"),
    )
    return response.unionByName(revisit)


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl log over ``pages``."""
    found = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    told = F.array_join(F.transform("headers", lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "canonical", F.col("ts").alias("revisit_at"), "refers_to", "outcome", told.alias("headers"))


#: Phrased on its own: a correlated maximum instead of ranges, headers from what each kind of record sends.
OP7_SQL = r"""
with p as (
  select page_id, page_id * 60 as seen, '"' || md5(coalesce(html, '')) || '"' as tag, length(coalesce(html, '')) as size,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare
  from pages),
h as (select *, regexp_extract(bare, '^[^/?]*') as host from p),
r as (select *, substr(bare, length(host) + 1) as rest from h),
q as (
  select *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|sessionid)(=.*)?$'))) as params
  from r),
c as (
  select page_id, seen, tag, size,
    regexp_replace(regexp_replace(lower(host), '^www[.]', ''), ':(80|443)$', '') || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as canonical
  from q),
asked as (
  select *, 0 as n, seen + (page_id % 30 + 1) * 86400 as revisit_at from c
  union all select *, 1 as n, seen - 1 as revisit_at from c where page_id % 17 = 0),
sent as (
  select *, page_id * 4 + 1 + n as record_id,
    case when page_id % 13 = 0 then null when page_id % 11 = 0 then '"changed"' when page_id % 7 = 0 then null else tag end as etag,
    case when page_id % 13 <> 0 then seen - 86400 end as dated
  from asked),
best as (
  select s.record_id, max(c.page_id) as page_id
  from sent s join c on c.canonical = s.canonical and c.seen < s.revisit_at group by s.record_id),
j as (
  select s.*, b.page_id as base_id, o.tag as base_tag, o.seen - 86400 as base_dated, o.size as base_size
  from sent s left join best b on b.record_id = s.record_id left join c o on o.page_id = b.page_id),
o as (
  select *, case when base_id is null then 'no_response' when etag is not null then case when etag = base_tag then 'resolved' else 'mismatch' end
    when dated is not null then case when dated = base_dated then 'resolved' else 'mismatch' end else 'unverified' end as outcome
  from j)
select record_id, canonical, revisit_at, base_id * 4 as refers_to, outcome,
  'cache-control=max-age=600;' || case when outcome = 'resolved' then 'content-length=' || base_size || ';content-type=text/html;' else '' end
    || 'date=t' || revisit_at || ';vary=accept' as headers
from o
"""
