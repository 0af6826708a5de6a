"""Search-usage queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from jobgrain.operators import usage as U
from jobgrain.plans.registry import query
from jobgrain.sources.views import AS_OF, postings, search_events


@query("""
SELECT event_type, count(*) AS total, count(DISTINCT nullif(trim(anonymous_session_key), '')) AS sessions FROM search_events GROUP BY 1
UNION ALL SELECT '(all)', count(*), count(DISTINCT nullif(trim(anonymous_session_key), '')) FROM search_events
""")
def u1_totals(spark, sf_dir):
    """U1."""
    return U.totals_by_type(search_events(spark, sf_dir))


@query("""
WITH s AS (SELECT event_type, query_normalized AS term, count(*) AS total, min(created_epoch) AS first_seen, max(created_epoch) AS last_seen FROM search_events GROUP BY 1, 2
  UNION ALL SELECT '(all)', query_normalized, count(*), min(created_epoch), max(created_epoch) FROM search_events GROUP BY 2)
SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY total DESC, term) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""")
def u2_top_terms(spark, sf_dir):
    """U2."""
    return U.top_terms(search_events(spark, sf_dir))


_POOR = "SELECT query_normalized AS term, count(*) AS total, max(created_epoch) AS last_seen FROM search_events WHERE event_type = 'postings' AND {} GROUP BY 1 ORDER BY total DESC, term LIMIT 10"


@query(_POOR.format("result_count = 0"))
def u3_zero_result_queries(spark, sf_dir):
    """U3."""
    return U.poor_queries(search_events(spark, sf_dir), "zero")


@query(_POOR.format("result_count BETWEEN 1 AND 9"))
def u3_low_result_queries(spark, sf_dir):
    """U3, few results."""
    return U.poor_queries(search_events(spark, sf_dir), "low")


@query("SELECT referrer_host AS value, count(*) AS total FROM search_events WHERE referrer_host <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def u4_top_referrers(spark, sf_dir):
    """U4."""
    return U.top_values(search_events(spark, sf_dir), "referrer_host")


@query("SELECT user_agent_family AS value, count(*) AS total FROM search_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def u4_top_user_agents(spark, sf_dir):
    """U4."""
    return U.top_values(search_events(spark, sf_dir), "user_agent_family")


@query("""
SELECT b.bucket, count(e.event_id) AS total FROM (VALUES ('zero'), ('low'), ('normal'), ('unknown')) b(bucket) LEFT JOIN
  (SELECT event_id, CASE WHEN result_count IS NULL THEN 'unknown' WHEN result_count = 0 THEN 'zero' WHEN result_count < 10 THEN 'low' ELSE 'normal' END AS bucket FROM search_events WHERE event_type = 'postings') e
  ON e.bucket = b.bucket GROUP BY 1
""")
def u5_result_buckets(spark, sf_dir):
    """U5, zero-filled."""
    return U.result_buckets(search_events(spark, sf_dir))


@query("""
SELECT total, hits, misses, total - hits - misses AS other, round(hits / (hits + misses), 4) AS hit_rate
FROM (SELECT count(*) AS total, count(*) FILTER (cache_status = 'hit') AS hits, count(*) FILTER (cache_status = 'miss') AS misses FROM search_events) c
""")
def u6_cache_status(spark, sf_dir):
    """U6."""
    return U.cache_status(search_events(spark, sf_dir))


@query("""
SELECT m.mode, count(e.event_id) AS total FROM (VALUES ('all'), ('remote'), ('hybrid'), ('onsite'), ('non_remote')) m(mode)
LEFT JOIN (SELECT event_id, CASE WHEN remote_filter IN ('all', 'remote', 'hybrid', 'onsite', 'non_remote') THEN remote_filter ELSE 'all' END AS mode FROM search_events) e ON e.mode = m.mode GROUP BY 1
""")
def u7_remote_modes(spark, sf_dir):
    """U7, zero-filled."""
    return U.remote_modes(search_events(spark, sf_dir))


@query("""
SELECT value, count(*) AS total FROM (SELECT trim(unnest(string_split(country_filters, ','))) AS value FROM search_events) s WHERE value <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
""")
def u8_country_filters(spark, sf_dir):
    """U8."""
    return U.csv_values(search_events(spark, sf_dir), "country_filters")


@query("""
SELECT total, zero, known, round(zero / CASE WHEN known > 0 THEN known ELSE total END, 4) AS zero_rate
FROM (SELECT count(*) AS total, count(*) FILTER (result_count = 0) AS zero, count(result_count) AS known FROM search_events WHERE event_type = 'postings') c
""")
def u9_zero_result_rate(spark, sf_dir):
    """U9."""
    return U.zero_result_rate(search_events(spark, sf_dir))


_INTENTS = "(SELECT DISTINCT query_normalized AS alias, 'intent ' || (CAST(substr(query_normalized, 2) AS INTEGER) % 7) AS intent FROM search_events WHERE CAST(substr(query_normalized, 2) AS INTEGER) % 3 = 0 UNION ALL SELECT 'never', 'intent never')"


@query(f"""
WITH c AS (SELECT lower(trim(query_normalized)) AS alias, count(*) AS n FROM search_events GROUP BY 1), i AS {_INTENTS},
m AS (SELECT coalesce(i.intent, c.alias) AS intent, sum(n) AS total FROM c LEFT JOIN i USING (alias) GROUP BY 1)
SELECT intent, CAST(total AS BIGINT) AS total FROM (SELECT * FROM m UNION ALL SELECT DISTINCT intent, 0 FROM i WHERE intent NOT IN (SELECT intent FROM m)) x ORDER BY total DESC, intent LIMIT 20
""")
def u10_popular_searches(spark, sf_dir):
    """U10, Q24."""
    events = search_events(spark, sf_dir)
    n = F.substring("query_normalized", 2, 9).cast("int")
    intents = events.where(n % 3 == 0).select(F.col("query_normalized").alias("alias"), F.concat(F.lit("intent "), (n % 7).cast("string")).alias("intent")).distinct()
    return U.popular_searches(events, intents.union(spark.createDataFrame([("never", "intent never")], "alias string, intent string")))


@query(f"SELECT canonical_url, md5('day:' || canonical_url) AS draw FROM postings WHERE NOT hidden AND first_seen_epoch >= {AS_OF} - 90 * 86400 AND first_seen_epoch < {AS_OF} ORDER BY draw LIMIT 25")
def u14_daily_sample(spark, sf_dir):
    """U14."""
    return U.daily_sample(postings(spark, sf_dir), AS_OF - 90 * 86400, AS_OF, "day", 25).select("canonical_url", "draw")


@query("SELECT event_type, count(*) AS total FROM search_events WHERE created_epoch >= 1705186800 AND created_epoch < 1705273200 GROUP BY 1")
def u1_local_day(spark, sf_dir):
    """U1 over the local day 2024-01-14 in Europe/Berlin (UTC+1)."""
    day = U.local_day(search_events(spark, sf_dir), date(2024, 1, 14), "Europe/Berlin")
    return day.groupBy("event_type").agg(F.count("*").alias("total"))


@query("SELECT CAST(floor(created_epoch / 3600) * 3600 AS BIGINT) AS hour_epoch, event_type, count(*) AS total, count(*) FILTER (result_count = 0) AS zero FROM search_events GROUP BY 1, 2")
def st2_hourly_batch(spark, sf_dir):
    """ST2's counts, computed as a batch."""
    return U.hourly(search_events(spark, sf_dir))
