"""Text, URL, date and HTML function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.functions import text as T
from jobgrain.operators import extract as X
from jobgrain.plans.registry import query
from jobgrain.sources.views import postings, table


@query("""
WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS x FROM pages),
q AS (SELECT page_id, string_split(x, '?')[1] AS base, x, list_filter(string_split(regexp_extract(x, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT (lower(string_split(p, '=')[1]) IN
  ('_ga', '_gl', 'gh_src', 'iis', 'iisn', 'lever-source', 'ref', 'referrer', 'source', 'src') OR lower(p) LIKE 'utm\\_%' ESCAPE '\\')) AS kept FROM u)
SELECT page_id, CASE WHEN contains(x, '?') AND len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS url FROM q
""")
def t8_canonical_url(spark, sf_dir):
    """T8."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '(?is)<style.*?</style>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<br\\s*/?>', ' ', 'g'), '(?i)</(p|div|li|tr|td|th|h[1-6])>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS t FROM c)
SELECT page_id, md5(trim(regexp_replace(t, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text_md5, length(trim(regexp_replace(t, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS chars FROM d
""")
def t18_plain_text(spark, sf_dir):
    """T18, S2."""
    t = T.plain_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("chars"))


@query("""
SELECT location_text, count(*) AS total, CASE WHEN t = '' THEN 'unknown' WHEN regexp_matches(t, '\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches(t, '\\b(remote|work from home|wfh|anywhere)\\b') THEN 'remote' ELSE 'non_remote' END AS mode
FROM (SELECT location_text, trim(regexp_replace(lower(location_text), '[^a-z0-9]+', ' ', 'g')) AS t FROM postings) p GROUP BY location_text, t
""")
def f8_work_mode(spark, sf_dir):
    """F8: computed once for each distinct location."""
    places = postings(spark, sf_dir).groupBy("location_text").agg(F.count("*").alias("total"))
    return places.withColumn("mode", T.work_mode(F.col("location_text")))


@query("SELECT canonical_url, replace(replace(rtrim(to_base64(unhex(sha256(canonical_url))), '='), '+', '-'), '/', '_') AS document_id, company_name, position_name FROM postings WHERE NOT hidden AND trim(position_name) <> ''")
def s8_s9_index_documents(spark, sf_dir):
    """S8, S9."""
    rows = postings(spark, sf_dir).where(~F.col("hidden") & ~T.is_blank(F.col("position_name")))
    return rows.select("canonical_url", T.document_id(F.col("canonical_url")).alias("document_id"), "company_name", "position_name")


@query("SELECT location_text, trim(regexp_replace(strip_accents(lower(location_text)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM (SELECT DISTINCT location_text FROM postings) p")
def t1_search_text(spark, sf_dir):
    """T1."""
    return postings(spark, sf_dir).select("location_text").distinct().withColumn("folded", T.search_text(F.col("location_text")))


@query("SELECT posting_no, CAST(nullif(posting_date, '') AS BIGINT) AS epoch FROM (SELECT posting_no, CASE WHEN length(posting_date) BETWEEN 1 AND 9 THEN '0' || posting_date ELSE posting_date END AS posting_date FROM postings) p")
def t11_posting_date(spark, sf_dir):
    """T11 on ten-digit epochs (other forms: tests)."""
    padded = F.when(F.length("posting_date").between(1, 9), F.concat(F.lit("0"), F.col("posting_date"))).otherwise(F.col("posting_date"))
    return postings(spark, sf_dir).select("posting_no", T.posted_epoch(padded, 0).alias("epoch"))


@query("""
WITH n AS (SELECT company_id, company_name, canonical_url, position_name, first_seen_epoch, source_job_id, ats_key, count(*) OVER (PARTITION BY company_id) AS k FROM postings)
SELECT company_id, true AS feed_ok, company_name, position_name, canonical_url, 'Pay & terms of ' || ats_key AS description_plain, source_job_id, ats_key AS department, CASE WHEN position_name <> '' THEN first_seen_epoch END AS posted_at_epoch FROM n WHERE company_id % 7 <> 0
UNION ALL SELECT DISTINCT company_id, false, '', '', '', '', '', '', NULL FROM n WHERE company_id % 7 = 0
""")
def s2_rss_postings(spark, sf_dir):
    """A feed for each company, cut off in the middle for some, as postings."""
    rows = postings(spark, sf_dir)
    date = F.date_format(F.timestamp_seconds("first_seen_epoch"), "dd MMM yyyy HH:mm:ss")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    item = tag("item", F.concat(
        tag("title", F.col("position_name")), tag("link", F.concat("canonical_url", F.lit("?utm_source=rss"))), tag("description", F.concat(F.lit("<![CDATA[<p>Pay &amp; terms of ]]>"), "ats_key", F.lit("<![CDATA[</p>]]>"))),
        tag("pubDate", F.when(F.col("position_name") != "", F.concat(F.lit("Mon, "), date, F.lit(" GMT"))).otherwise("soon")), F.lit('<guid isPermaLink="false">'), F.col("source_job_id"), F.lit("</guid>"), tag("category", F.col("ats_key")),
    ))
    feeds = rows.groupBy("company_id").agg(F.first("company_name").alias("name"), F.array_join(F.collect_list(item), "").alias("items"))
    body = tag("channel", F.concat(tag("title", F.col("name")), F.col("items")))
    whole = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0">'), body, F.lit("</rss>"))
    payload = F.when(F.col("company_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 30)).otherwise(whole)
    return X.rss_postings(feeds.select("company_id", payload.alias("payload")))
