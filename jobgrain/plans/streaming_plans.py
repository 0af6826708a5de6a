"""Streaming queries over the event table, compared with the same counts in SQL.

In append mode a window is written once the watermark has passed it, so each query leaves out what the last events may still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.plans.merge_plans import snapshot
from jobgrain.plans.quality_plans import _AMBIG, _B, _MODE, _PLACE_OK
from jobgrain.plans.registry import query
from jobgrain.sources.storage import VersionedTables, new_path
from jobgrain.sources.views import EARLIER, epoch, posting_cache, table
from jobgrain.streaming import jobs


def event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return e.select(
        "event_id", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("created_at"), F.concat(F.lit("ats"), (F.col("user_id") % 12).cast("string")).alias("ats_key"), F.col("event_type").alias("raw_type"),
        F.when(F.col("event_type") == "view", "postings").when(F.col("event_type") == "click", "suggest").otherwise("filter_options").alias("event_type"),
        (F.floor("value") % 20).cast("int").alias("result_count"), F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("anonymous_session_key"),
    )


_CLOSED = "(SELECT max(epoch(ts)) - 7200 FROM events)"


@query(f"""
SELECT CAST(floor(created_epoch / 3600) * 3600 AS BIGINT) AS hour_epoch, event_type, count(*) AS total, count(*) FILTER (result_count = 0) AS zero
FROM search_events GROUP BY 1, 2 HAVING hour_epoch + 3600 <= {_CLOSED}
""")
def st2_hourly_stream(spark, sf_dir):
    """ST2."""
    return jobs.run_to_table(jobs.hourly_counts(event_stream(spark, sf_dir)), spark, "hourly")


@query(f"""
WITH h AS (SELECT 'ats' || (user_id % 12) AS ats_key, unnest(range(0, 24)) AS k, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour FROM events WHERE event_type = 'error')
SELECT hour + (k + 1) * 3600 AS until_epoch, ats_key, count(*) AS failures FROM h GROUP BY 1, 2 HAVING until_epoch <= (SELECT max(epoch(ts)) - 7200 FROM events WHERE event_type = 'error')
""")
def st4_rolling_failures(spark, sf_dir):
    """ST4."""
    return jobs.run_to_table(jobs.rolling_failures(event_stream(spark, sf_dir).where("raw_type = 'error'")), spark, "rolling")


@query(f"""
WITH g AS (SELECT 's' || user_id AS k, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS b FROM events WHERE user_id % 10 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT k, t, sum(b) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT k AS anonymous_session_key, CAST(floor(min(t) / 1000000) AS BIGINT) AS start_epoch, CAST(floor((max(t) + 1800000000) / 1000000) AS BIGINT) AS end_epoch, count(*) AS events FROM s GROUP BY k, n
HAVING max(t) / 1000000.0 + 1800 <= (SELECT max(epoch(ts)) - 7200 FROM events WHERE user_id % 10 <> 0)
""")
def st7_sessions(spark, sf_dir):
    """ST7."""
    return jobs.run_to_table(jobs.sessions(event_stream(spark, sf_dir)), spark, "sessions")


_ATTENTION = "e_type LIKE 'parser%'"


@query(f"""
WITH h AS (SELECT ats_key, created_epoch, error_type AS e_type, unnest(range(0, 24)) AS k, CAST(floor(created_epoch / 3600) * 3600 AS BIGINT) AS hour FROM run_errors)
SELECT hour + (k + 1) * 3600 AS until_epoch, ats_key, count(*) AS failures, count(*) FILTER ({_ATTENTION}) AS attention, round(count(*) FILTER ({_ATTENTION}) * 100 / count(*), 2) AS attention_percent
FROM h GROUP BY 1, 2 HAVING until_epoch <= (SELECT max(epoch(ts)) - 7200 FROM events WHERE event_type = 'error')
""")
def st4_rolling_rates(spark, sf_dir):
    """ST4: failures and their share of parser attention over rolling days."""
    kinds = ("network", "parser_empty", "http", "parser_schema", "timeout", "validation")
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("created_at"), F.concat(F.lit("ats"), (F.col("user_id") % 12).cast("string")).alias("ats_key"),
        F.element_at(F.array(*map(F.lit, kinds)), (k % 6 + 1).cast("int")).alias("error_type"), F.lit("failed").alias("error_message"),
    )
    return jobs.run_to_table(jobs.rolling_rates(rows), spark, "rates")


_OUTBOX = """
e AS (SELECT 'u' || user_id AS canonical_url, event_id AS id, epoch_us(ts) // 1000 AS t, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'delete' ELSE 'upsert' END AS what FROM events),
k AS (SELECT *, last_value(CASE WHEN what <> 'failed' THEN id END IGNORE NULLS) OVER w AS entry, last_value(CASE WHEN what <> 'failed' THEN what END IGNORE NULLS) OVER w AS operation, lead(t) OVER (PARTITION BY canonical_url ORDER BY t, id) AS next_t FROM e
  WINDOW w AS (PARTITION BY canonical_url ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, count(*) FILTER (what = 'failed') OVER (PARTITION BY canonical_url, entry ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS failures FROM k WHERE entry IS NOT NULL),
m AS (SELECT max(t) - 7200000 AS mark FROM e),
d AS (SELECT canonical_url, entry AS id, operation, 1 AS attempt, t AS sent FROM n, m WHERE what <> 'failed' AND t <= mark
  UNION ALL SELECT canonical_url, entry, operation, failures + 1, t + failures * 60000 FROM n, m WHERE what = 'failed' AND (next_t IS NULL OR next_t > t + failures * 60000) AND t + failures * 60000 <= mark)"""


def outbox_stream(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("raw_type") == "error", "failed").when(F.col("raw_type") == "signup", "delete").otherwise("upsert")
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("raw_type", F.col("event_type"))
    return e.select(
        F.timestamp_millis(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")).alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("canonical_url"), kind.alias("operation"),
    )


@query(f"WITH {_OUTBOX} SELECT canonical_url, id, operation, CAST(attempt AS INTEGER) AS attempt, CAST(floor(sent / 1000) AS BIGINT) AS at_epoch FROM d")
def st3_deliveries(spark, sf_dir):
    """ST3: when operations are sent, with waits after failures, as far as the watermark has come."""
    return jobs.run_to_table(jobs.deliveries(outbox_stream(spark, sf_dir)), spark, "deliveries")


def landed(lines: DataFrame, spark, sf_dir) -> DataFrame:
    """Rows as a crawler lands them: tracking parameters, blank titles and ids, doubtful places."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("l_linenumber")
    place = F.when(n % 5 == 0, "Remote").when(n % 3 == 0, " Multiple locations ").otherwise(F.col("n_name"))
    return lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("https://jobs.example/p/"), F.col("l_orderkey").cast("string"), F.when(n % 2 == 0, "?utm_source=feed").otherwise("#apply")).alias("canonical_url"),
        F.concat(F.lit(" "), "s_name").alias("company_name"), F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("Line "), n.cast("string"))).alias("position_name"),
        F.concat(F.lit("ats"), (F.col("l_suppkey") % 5).cast("string")).alias("ats_key"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("source_job_id"),
        F.lit("v1").alias("parser_version"), F.when(n % 3 == 0, "").otherwise(F.col("n_name")).alias("country"), F.lit("").alias("region"), F.lit("").alias("city"), place.alias("location_text"),
        F.when(n % 2 == 0, "unknown").otherwise("hybrid").alias("remote_type"), F.when(n % 4 == 0, "").otherwise("yesterday").alias("posting_date"), ((F.col("l_quantity") + 25) / 75).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("dep "), F.col("l_returnflag"))).alias("department"), epoch("l_shipdate").alias("seen_epoch"),
        F.struct(epoch("l_shipdate").alias("t"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e")).alias("arrival"),
    )


_URL = "'https://jobs.example/p/' || l_orderkey"
_LANDED = f"""
l AS (SELECT {_URL} AS canonical_url, s_name AS company_name, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'Line ' || l_linenumber END AS position_name, 'ats' || (l_suppkey % 5) AS ats_key,
  CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE l_partkey::VARCHAR END AS source_job_id, 'v1' AS parser_version, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE n_name END AS country, '' AS region, '' AS city,
  CASE WHEN l_linenumber % 5 = 0 THEN 'Remote' WHEN l_linenumber % 3 = 0 THEN 'Multiple locations' ELSE n_name END AS location_text,
  CASE WHEN l_linenumber % 2 = 1 THEN 'hybrid' WHEN l_linenumber % 5 = 0 THEN 'remote' ELSE 'unknown' END AS remote_type, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(epoch(l_shipdate) AS BIGINT) - 86400 END AS posted_at_epoch,
  (l_quantity + 25) / 75 AS confidence, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'dep ' || l_returnflag END AS department, CAST(epoch(l_shipdate) AS BIGINT) AS seen_epoch,
  row(CAST(epoch(l_shipdate) AS BIGINT), l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS arrival FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT *, list_filter([CASE WHEN {_B.format('source_job_id')} THEN 'missing_source_job_id' END, CASE WHEN CAST(round(confidence * 100) AS INTEGER) < 35 THEN 'low_quality_score' END, CASE WHEN confidence < 0.35 THEN 'low_parser_confidence' END,
  CASE WHEN {_AMBIG} AND NOT {_MODE} THEN 'ambiguous_location' END, CASE WHEN NOT {_PLACE_OK} AND NOT {_MODE} THEN 'no_geo_no_remote' END], lambda x: x IS NOT NULL) AS doubts FROM l),
b AS (SELECT *, CASE WHEN position_name = '' THEN 'invalid' WHEN len(doubts) > 0 THEN 'quarantined' ELSE 'valid' END AS validation_status, CASE WHEN position_name = '' THEN 'missing position_name' ELSE array_to_string(doubts, ',') END AS validation_error,
  position_name <> '' AND len(doubts) = 0 AS accepted FROM d),
f AS (SELECT canonical_url, arg_max(company_name, arrival) FILTER (accepted) AS company_name, arg_max(position_name, arrival) FILTER (accepted) AS position_name, arg_max(country, arrival) FILTER (accepted AND country <> '') AS country,
  arg_max(department, arrival) FILTER (accepted AND department <> '') AS department, coalesce(arg_max(remote_type, arrival) FILTER (accepted AND remote_type <> 'unknown'), 'unknown') AS remote_type, min(seen_epoch) FILTER (accepted) AS first_seen,
  max(seen_epoch) FILTER (accepted) AS last_seen, count(*) FILTER (accepted) AS n, arg_max(accepted, arrival) AS shown FROM b GROUP BY 1),
p AS (SELECT * FROM postings WHERE first_seen_epoch < {EARLIER}),
m AS (SELECT coalesce(p.canonical_url, f.canonical_url) AS canonical_url, CASE WHEN n > 0 THEN f.company_name ELSE p.company_name END AS company_name, CASE WHEN n > 0 THEN f.position_name ELSE p.position_name END AS position_name,
  CASE WHEN n > 0 AND f.country IS NOT NULL THEN f.country ELSE p.country END AS country, CASE WHEN n > 0 AND f.department IS NOT NULL THEN f.department WHEN p.canonical_url IS NULL THEN NULL ELSE '' END AS department,
  CASE WHEN n > 0 AND f.remote_type <> 'unknown' THEN f.remote_type ELSE coalesce(p.remote_type, 'unknown') END AS remote_type, CASE WHEN f.canonical_url IS NOT NULL THEN NOT shown ELSE p.hidden END AS hidden, greatest(last_seen, last_seen_epoch) AS seen,
  CASE WHEN f.canonical_url IS NULL THEN '' WHEN p.canonical_url IS NULL THEN CASE WHEN shown THEN 'upsert' ELSE '' END WHEN NOT shown THEN CASE WHEN p.hidden THEN '' ELSE 'delete' END WHEN p.hidden THEN 'upsert' ELSE '' END AS operation
  FROM p FULL JOIN f ON p.canonical_url = f.canonical_url WHERE p.canonical_url IS NOT NULL OR n > 0),
c AS (SELECT canonical_url, last_seen_epoch, validation_status, validation_error, company_name FROM posting_cache WHERE last_seen_epoch < {EARLIER}),
k AS (SELECT canonical_url, arg_max(row(seen_epoch, validation_status, validation_error, company_name), arrival) AS x FROM b GROUP BY 1)"""


@query(f"""
WITH {_LANDED}
SELECT 'posting' AS sink, canonical_url, concat_ws('|', company_name, position_name, country, coalesce(department, '-'), remote_type, hidden, seen) AS image, 1 AS n FROM m
UNION ALL SELECT 'outbox', canonical_url, operation, 1 FROM m WHERE operation <> ''
UNION ALL SELECT 'rejection', canonical_url, concat_ws('|', validation_status, validation_error, seen_epoch), count(*) FROM b WHERE NOT accepted GROUP BY 1, 2, 3
UNION ALL SELECT 'cache', coalesce(c.canonical_url, k.canonical_url), CASE WHEN k.canonical_url IS NULL THEN concat_ws('|', c.last_seen_epoch, c.validation_status, c.validation_error, c.company_name) ELSE concat_ws('|', x[1], x[2], x[3], x[4]) END, 1
  FROM c FULL JOIN k ON c.canonical_url = k.canonical_url
""")
def st1_ingest(spark, sf_dir):
    """ST1, S6, M1-M4, Q4: landed rows through the gate into four tables that one commit makes visible."""
    tables = VersionedTables(spark, new_path(spark, "ingest"), buckets=16)
    cache = posting_cache(spark, sf_dir).where(F.col("last_seen_epoch") < EARLIER).withColumn("remote_type", F.lit(""))
    jobs.start_tables(tables, snapshot(spark, sf_dir), cache)
    lines = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/lineitem.parquet*")
    jobs.run_batches(landed(lines, spark, sf_dir), jobs.ingest_sink(tables), new_path(spark, "ingest-state"))
    image = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c]).alias("image")
    one = F.lit(1).cast("long").alias("n")
    p = tables.read("postings").withColumn("department", F.coalesce("department", F.lit("-")))
    return (
        p.select(F.lit("posting").alias("sink"), "canonical_url", image("company_name", "position_name", "country", "department", "remote_type", "hidden", "last_seen_epoch"), one)
        .union(tables.read("outbox").select(F.lit("outbox"), "canonical_url", "operation", one))
        .union(tables.read("rejections").groupBy(F.lit("rejection"), "canonical_url", image("validation_status", "validation_error", "seen_epoch")).agg(F.count("*")))
        .union(tables.read("posting_cache").select(F.lit("cache"), "canonical_url", image("last_seen_epoch", "validation_status", "validation_error", "company_name"), one))
    )


@query("""
WITH e AS (SELECT event_id, event_type AS type, CAST(value AS VARCHAR) AS count_, json_extract_string(props, '$.k') AS k, user_id FROM events)
SELECT event_id, CASE type WHEN 'click' THEN 'suggest' ELSE 'postings' END AS event_type, 'q' || k || ' ' || type AS query, CAST(least(2000000, greatest(0, floor(CAST(count_ AS DOUBLE)))) AS BIGINT) AS result_count, 'NATION_' || (user_id % 25) || ',NATION_1' AS country_filters,
  sha256('s' || user_id) AS anonymous_session_key FROM e
""")
def s7_event_append(spark, sf_dir):
    """A stream of landed events appended in their stored form."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    k, blank = F.get_json_object("props", "$.k"), F.lit("")
    raw = e.select(
        "event_id", F.when(F.col("event_type") == "click", " Search-Suggest").otherwise(F.col("event_type")).alias("type"), F.concat(F.lit("  q"), k, F.lit("   "), F.col("event_type")).alias("query"), F.col("value").cast("string").alias("result_count"),
        F.concat(F.lit(" NATION_"), (F.col("user_id") % 25).cast("string"), F.lit(",, NATION_1 ")).alias("countries"), blank.alias("country"), blank.alias("language"), F.upper(F.sha2(F.concat(F.lit("s"), F.col("user_id").cast("string")), 256)).alias("session"), blank.alias("referrer"), blank.alias("agent"),
    )
    tables = VersionedTables(spark, new_path(spark, "events"))
    jobs.run_batches(raw, jobs.event_sink(tables), new_path(spark, "events-state"))
    return tables.read("events").select("event_id", "event_type", "query", "result_count", "country_filters", "anonymous_session_key")
