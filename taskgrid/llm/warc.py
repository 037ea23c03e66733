"""Not-modified revisits of web captures (operator 7).

A revisit (a 304 answer) is joined as of its time to the latest earlier full
response of the same canonical URL. Its validators (ETag, else Last-Modified)
must agree with that response's; then the headers a 304 may renew are merged
over the response's own.

A URL may hold a third of all captures: captures are dealt by (URL, slice of
time), the last response of each slice is one row, and a window over those rows
alone carries it into later slices.

The canonical URL keeps the query (sorted, without tracking parameters): resources
of one script stay apart. Null URLs are no captures' URL and never resolve; null times come before all. A
response at the same time is not earlier; of two at one time the larger record
id counts. Repeated rows resolve each alike. An empty table gives
an empty result; extra columns are not read. URLs are the only texts, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parameters that name a visit, not a resource (besides utm_*); headers that a 304 may renew.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref")
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical(url: Column) -> Column:
    """Without scheme, ``www.``/``m.``, fragment and closing slashes; lower-case host; parameters sorted, tracking ones dropped."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://(www\.|m\.)?", ""), r"(?s)#.*$", "")
    place = F.substring_index(rest, "?", 1)
    host = F.substring_index(place, "/", 1)
    path = F.regexp_replace(F.substring(place, F.length(host) + 1, F.length(place)), "/+$", "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    given = F.split(F.substring(rest, F.length(place) + 2, F.length(rest)), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)))
    return F.concat(F.lower(host), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(""))


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """Each revisit with ``response_id``, ``status`` (resolved, mismatch, no_response) and merged ``headers``.

    ``records``: record_id, url, captured_at (long), kind (response or revisit),
    etag, last_modified, headers (map)."""
    spark = records.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = records.agg(F.percentile_approx("captured_at", [k / n for k in range(1, n)], 10000)).first()[0] \
        if n > 1 else []  # n - 1 numbers
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<bigint>")
    r = records.select("record_id", canonical(F.col("url")).alias("url_key"),
                       F.coalesce(F.col("captured_at").cast("bigint"), F.lit(-(1 << 62))).alias("at"), "kind",
                       "etag", "last_modified", "headers").withColumn(
        "slice", F.size(F.filter(cut, lambda c: c < F.col("at"))))
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "headers"))
    r = r.withColumn("resp", full)
    order = F.struct("at", "record_id")
    last = (r.filter("kind = 'response' and url_key is not null").groupBy("url_key", "slice")
            .agg(F.max_by("resp", order).alias("resp")))
    marks = last.unionByName(r.filter("kind = 'revisit' and url_key is not null").select("url_key", "slice").distinct()
                             .withColumn("resp", F.lit(None).cast(last.schema["resp"].dataType)))
    marks = marks.groupBy("url_key", "slice").agg(F.max_by("resp", F.col("resp").isNotNull()).alias("resp"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "slice", F.last("resp", True).over(before).alias("carried"))
    near = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = r.withColumn("near", F.max(F.when(F.col("kind") == "response", F.struct("at", "record_id"))).over(near))
    found = inside.filter("kind = 'revisit'").join(
        r.filter("kind = 'response'").select(F.col("url_key").alias("u"), F.struct("at", "record_id").alias("id2"),
                                             F.col("resp").alias("own")).dropDuplicates(["u", "id2"]),
        (F.col("url_key") == F.col("u")) & (F.col("near") == F.col("id2")), "left").join(
        carried, ["url_key", "slice"], "left")
    hit = F.coalesce("own", "carried")
    ok = F.when(F.col("etag").isNotNull(), F.col("etag").eqNullSafe(F.col("hit.etag"))).otherwise(
        F.col("last_modified").isNotNull() & F.col("last_modified").eqNullSafe(F.col("hit.last_modified")))
    status = F.when(F.col("hit").isNull(), "no_response").when(ok, "resolved").otherwise("mismatch")
    none = F.expr("cast(map() as map<string,string>)")
    own = F.coalesce("headers", none)
    kept = F.map_filter(F.coalesce("hit.headers", none), lambda k, _: ~F.map_contains_key(
        F.map_filter(own, lambda k2, _2: k2.isin(*PERMITTED)), k))
    merged = F.when(F.col("status") == "resolved", F.map_concat(kept, F.map_filter(own, lambda k, _: k.isin(*PERMITTED))))
    return (found.withColumn("hit", hit).withColumn("status", status)
            .select("record_id", "url_key", "status",
                    F.when(F.col("status") != "no_response", F.col("hit.record_id")).alias("response_id"),
                    merged.alias("headers")))


def records_of(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``: each page's response at time page_id, and a revisit later by the length of its html."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    size = F.length(F.coalesce("html", F.lit(""))).cast("bigint")
    head = lambda *more: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in more])
    base = pages.select("page_id", "url", tag.alias("etag"), size.alias("n"))
    a = base.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured_at"),
                    F.lit("response").alias("kind"), "etag", F.lit(None).cast("string").alias("last_modified"),
                    head("content-type", "text/html", "content-length", F.col("n").cast("string"),
                         "etag", F.col("etag"), "date", F.col("page_id").cast("string")).alias("headers"))
    b = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + F.col("n")).alias(
        "captured_at"), F.lit("revisit").alias("kind"), "etag", F.lit(None).cast("string").alias("last_modified"),
                    head("content-length", "0", "etag", F.col("etag"),
                         "date", (F.col("page_id") + F.col("n")).cast("string")).alias("headers"))
    return a.unionByName(b)


def digest(pages: DataFrame) -> DataFrame:
    out = resolve(records_of(pages.select("page_id", "url", "html")))
    return out.select(((F.col("record_id") - 1) / 2).cast("bigint").alias("page_id"), "url_key", "status",
                      (F.col("response_id") / 2).cast("bigint").alias("response_page_id"),
                      F.col("headers")["content-length"].alias("content_length"), F.col("headers")["date"].alias("date"))


SQL = r"""
WITH r AS (SELECT page_id, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(url, '^https?://(www\.|m\.)?', '', 'i'), '(?s)#.*$', '') AS rest FROM pages),
q AS (SELECT *, split_part(rest, '?', 1) AS place, split_part(split_part(rest, '?', 1), '/', 1) AS host,
    list_sort(list_filter(string_split(substr(rest, length(split_part(rest, '?', 1)) + 2), '&'), lambda p: p <> ''
      AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN
      ('fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'msclkid', 'ref'))) AS kept FROM r),
k AS (SELECT page_id, md5(html) AS tag, length(html) AS n,
    lower(host) || regexp_replace(substr(place, length(host) + 1), '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM q),
m AS (SELECT b.page_id, b.url_key, b.tag, b.n, arg_max(a.page_id, a.page_id) AS response_page_id,
             arg_max(a.tag, a.page_id) AS tag2, arg_max(a.n, a.page_id) AS n2
      FROM k b LEFT JOIN k a ON a.url_key = b.url_key AND a.page_id < b.page_id + b.n GROUP BY ALL)
SELECT page_id, url_key,
  CASE WHEN response_page_id IS NULL THEN 'no_response' WHEN tag = tag2 THEN 'resolved' ELSE 'mismatch' END AS status,
  response_page_id, CASE WHEN tag = tag2 THEN CAST(n2 AS VARCHAR) END AS content_length,
  CASE WHEN tag = tag2 THEN CAST(page_id + n AS VARCHAR) END AS date FROM m"""
