"""Job-posting views over the supplied tables, once as DataFrames and once as the same SQL for the oracle.

``orders`` carry the postings, ``lineitem`` the incoming batches with duplicates, ``events`` the searches, runs and errors.
All times are epoch seconds; nothing depends on the clock or the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2001-09-01, shortly after the last posting was seen.
AS_OF = 999_302_400
#: 2024-01-31, the day after the last event.
EVENTS_AS_OF = 1_706_659_200
DAY = 86_400
#: Postings first seen before this time stand for an earlier state of a store.
EARLIER = AS_OF - 1_500 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})").cast("long")


def blank_when(n: int, value: Column, key: str = "o_orderkey") -> Column:
    return F.when(F.col(key) % n == 0, F.lit("")).otherwise(value)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the read model that search and audits work on."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    city = blank_when(5, F.concat(F.lit("City "), (F.col("o_custkey") % 50).cast("string")))
    location = (
        F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.lit("Remote")).when(k % 23 == 0, F.lit("Multiple locations"))
        .when(k % 29 == 0, F.lit("Hybrid - Main Office")).otherwise(F.concat(F.lit("City "), (F.col("o_custkey") % 50).cast("string"), F.lit(", "), F.col("n_name")))
    )
    first = epoch("o_orderdate")
    return rows.select(
        F.concat(F.lit("https://jobs.example/p/"), k.cast("string")).alias("canonical_url"),
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("company_name"),
        blank_when(97, F.concat("c_mktsegment", F.lit(" "), "o_orderpriority")).alias("position_name"),
        F.lower("c_mktsegment").alias("ats_key"),
        blank_when(11, F.col("n_name")).alias("country"),
        blank_when(7, F.col("r_name")).alias("region"),
        city.alias("city"),
        location.alias("location_text"),
        F.when(F.col("o_orderstatus") == "F", "remote").when(F.col("o_orderstatus") == "O", "onsite").otherwise("unknown").alias("remote_type"),
        F.lower(F.col("o_orderpriority")).alias("industry"),
        first.alias("first_seen_epoch"),
        (first + F.lit(DAY) * (k % 60)).alias("last_seen_epoch"),
        F.when(k % 31 == 0, F.lit(None)).otherwise(first).cast("long").alias("posted_at_epoch"),
        F.when(k % 31 == 0, F.lit("")).otherwise(first.cast("string")).alias("posting_date"),
        (k % 13 == 0).alias("hidden"),
        ((k % 100) / 100).alias("confidence"),
        blank_when(37, (k % 9000).cast("string")).alias("source_job_id"),
        F.concat(F.lit("v"), (k % 3).cast("string")).alias("parser_version"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Order total "), F.col("o_orderstatus"))).alias("description_plain"),
        k.alias("posting_no"),
    )


POSTINGS_SQL = """
SELECT 'https://jobs.example/p/' || o_orderkey AS canonical_url, c_custkey AS company_id, c_name AS company_name,
  CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE c_mktsegment || ' ' || o_orderpriority END AS position_name, lower(c_mktsegment) AS ats_key,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE n_name END AS country, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE r_name END AS region,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'City ' || (o_custkey % 50) END AS city,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'Remote' WHEN o_orderkey % 23 = 0 THEN 'Multiple locations'
       WHEN o_orderkey % 29 = 0 THEN 'Hybrid - Main Office' ELSE 'City ' || (o_custkey % 50) || ', ' || n_name END AS location_text,
  CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'O' THEN 'onsite' ELSE 'unknown' END AS remote_type, lower(o_orderpriority) AS industry,
  CAST(epoch(o_orderdate) AS BIGINT) AS first_seen_epoch, CAST(epoch(o_orderdate) AS BIGINT) + 86400 * (o_orderkey % 60) AS last_seen_epoch,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS posted_at_epoch,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) END AS posting_date,
  o_orderkey % 13 = 0 AS hidden, (o_orderkey % 100) / 100.0::DOUBLE AS confidence,
  CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE CAST(o_orderkey % 9000 AS VARCHAR) END AS source_job_id, 'v' || (o_orderkey % 3) AS parser_version,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Order total ' || o_orderstatus END AS description_plain, o_orderkey AS posting_no
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def posting_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsed row with its validation status."""
    k = F.col("posting_no")
    status = F.when(k % 10 == 0, "quarantined").when(k % 10 == 1, "invalid").otherwise("valid")
    error = F.when(k % 10 == 0, F.when(k % 20 == 0, "ambiguous_location").otherwise("no_geo_no_remote")).when(k % 10 == 1, "missing title").otherwise("")
    return postings(spark, sf_dir).select(
        "canonical_url", "ats_key", "parser_version", "company_name", "position_name", "last_seen_epoch", "confidence", "source_job_id", "hidden", "posting_no",
        status.alias("validation_status"), error.alias("validation_error"), F.md5(F.col("canonical_url")).alias("raw_payload_hash"),
    )


CACHE_SQL = """
SELECT canonical_url, ats_key, parser_version, company_name, position_name, last_seen_epoch, confidence, source_job_id, hidden, posting_no,
  CASE posting_no % 10 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'invalid' ELSE 'valid' END AS validation_status,
  CASE posting_no % 10 WHEN 0 THEN CASE WHEN posting_no % 20 = 0 THEN 'ambiguous_location' ELSE 'no_geo_no_remote' END WHEN 1 THEN 'missing title' ELSE '' END AS validation_error,
  md5(canonical_url) AS raw_payload_hash
FROM postings
"""


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed batch in arrival order, with repeats of a posting and blank fields."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("l_orderkey")
    return rows.select(
        F.concat(F.lit("https://jobs.example/p/"), k.cast("string")).alias("canonical_url"),
        F.col("s_name").alias("company_name"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("position_name"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("n_name")).alias("country"),
        F.when(F.col("l_linenumber") % 2 == 0, "unknown").otherwise("hybrid").alias("remote_type"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("dep "), F.col("l_returnflag"))).alias("department"),
        (F.col("l_quantity") / 100).alias("confidence"), epoch("l_shipdate").alias("seen_epoch"),
        F.struct(epoch("l_shipdate").alias("t"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e")).alias("arrival"),
    )


INCOMING_SQL = """
SELECT 'https://jobs.example/p/' || l_orderkey AS canonical_url, s_name AS company_name, 'Line ' || l_linenumber AS position_name,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE n_name END AS country, CASE WHEN l_linenumber % 2 = 0 THEN 'unknown' ELSE 'hybrid' END AS remote_type,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE 'dep ' || l_returnflag END AS department, l_quantity / 100 AS confidence, CAST(epoch(l_shipdate) AS BIGINT) AS seen_epoch,
  row(CAST(epoch(l_shipdate) AS BIGINT), l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS arrival
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, suggestions and filter requests."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("created_at"), epoch("ts").alias("created_epoch"),
        F.when(F.col("event_type") == "view", "postings").when(F.col("event_type") == "click", "suggest").otherwise("filter_options").alias("event_type"),
        F.concat(F.lit("q"), k.cast("string")).alias("query_normalized"), (F.floor("value") % 20).cast("int").alias("result_count"),
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("anonymous_session_key"),
        F.when(e % 3 == 0, "hit").when(e % 3 == 1, "miss").otherwise("").alias("cache_status"),
        F.when(e % 4 == 0, "remote").when(e % 4 == 1, "hybrid").when(e % 4 == 2, "all").otherwise("").alias("remote_filter"),
        F.when(e % 5 == 0, "").when(e % 5 == 1, "Germany, France").otherwise(F.concat(F.lit("NATION_"), (e % 25).cast("string"))).alias("country_filters"),
        F.when(e % 6 == 0, "").otherwise(F.concat(F.lit("host"), (e % 6).cast("string"), F.lit(".example"))).alias("referrer_host"),
        F.concat(F.lit("family"), (e % 7).cast("string")).alias("user_agent_family"),
    )


SEARCH_EVENTS_SQL = """
SELECT event_id, ts AS created_at, CAST(floor(epoch(ts)) AS BIGINT) AS created_epoch,
  CASE event_type WHEN 'view' THEN 'postings' WHEN 'click' THEN 'suggest' ELSE 'filter_options' END AS event_type,
  'q' || CAST(json_extract(props, '$.k') AS INTEGER) AS query_normalized, CAST(floor(value) AS INTEGER) % 20 AS result_count,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 's' || user_id END AS anonymous_session_key,
  CASE event_id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE '' END AS cache_status,
  CASE event_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'all' ELSE '' END AS remote_filter,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Germany, France' ELSE 'NATION_' || (event_id % 25) END AS country_filters,
  CASE event_id % 6 WHEN 0 THEN '' ELSE 'host' || (event_id % 6) || '.example' END AS referrer_host, 'family' || (event_id % 7) AS user_agent_family
FROM events
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingestion run per day of events."""
    day = F.floor(epoch("ts") / DAY).cast("long")
    return table(spark, sf_dir, "events").groupBy(day.alias("run_id")).agg(
        F.min(epoch("ts")).alias("started_epoch"), F.max(epoch("ts")).alias("finished_epoch"), F.count("*").alias("total_targets"),
        F.count_if(F.col("event_type") == "error").alias("failure_count"), F.count_if(F.col("event_type") == "purchase").alias("posting_upsert_count"),
        F.count_if(F.col("event_type") == "signup").alias("rejected_count"),
    ).withColumn("success_count", F.col("total_targets") - F.col("failure_count"))


RUNS_SQL = """
SELECT run_id, started_epoch, finished_epoch, total_targets, failure_count, posting_upsert_count, rejected_count, total_targets - failure_count AS success_count FROM (
  SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS run_id, min(CAST(floor(epoch(ts)) AS BIGINT)) AS started_epoch, max(CAST(floor(epoch(ts)) AS BIGINT)) AS finished_epoch,
    count(*) AS total_targets, count(*) FILTER (event_type = 'error') AS failure_count, count(*) FILTER (event_type = 'purchase') AS posting_upsert_count,
    count(*) FILTER (event_type = 'signup') AS rejected_count FROM events GROUP BY 1) r
"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of ingestion runs."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = ["network", "parser_empty", "http", "parser_schema", "timeout", "validation"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), F.floor(epoch("ts") / DAY).cast("long").alias("run_id"), epoch("ts").alias("created_epoch"),
        F.concat(F.lit("ats"), (F.col("user_id") % 12).cast("string")).alias("ats_key"), F.concat(F.lit("https://c"), F.col("user_id").cast("string"), F.lit(".example")).alias("company_url"),
        kind.alias("error_type"),
        F.when(k % 6 == 2, F.when(k % 4 == 0, 429).when(k % 4 == 1, 404).when(k % 4 == 2, 503).otherwise(403)).cast("int").alias("http_status"),
        F.concat(F.lit("failed with code "), (k % 9).cast("string")).alias("error_message"),
    )


ERRORS_SQL = """
SELECT event_id AS error_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS run_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_epoch, 'ats' || (user_id % 12) AS ats_key,
  'https://c' || user_id || '.example' AS company_url, ['network', 'parser_empty', 'http', 'parser_schema', 'timeout', 'validation'][k % 6 + 1] AS error_type,
  CAST(CASE WHEN k % 6 = 2 THEN CASE k % 4 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 403 END END AS INTEGER) AS http_status, 'failed with code ' || (k % 9) AS error_message
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error') e
"""


def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last success and failure of each crawl target (a user of the events)."""
    t = epoch("ts")
    ok = F.col("event_type").isin("purchase", "signup")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(F.when(ok, t)).alias("last_success_epoch"), F.max(F.when(F.col("event_type") == "error", t)).alias("last_failure_epoch"),
        F.count_if(F.col("event_type") == "error").alias("failures"),
    )
    return rows.select(
        F.concat(F.lit("ats"), (F.col("user_id") % 12).cast("string")).alias("ats_key"), F.concat(F.lit("https://c"), F.col("user_id").cast("string"), F.lit(".example")).alias("company_url"),
        F.concat(F.lit("Company "), (F.col("user_id") % 40).cast("string")).alias("company_name"), "last_success_epoch", "last_failure_epoch",
        F.when(F.coalesce("last_failure_epoch", F.lit(0)) > F.coalesce("last_success_epoch", F.lit(0)), (F.col("failures") % 5) + 1).otherwise(0).cast("int").alias("consecutive_failures"),
        (F.coalesce("last_success_epoch", "last_failure_epoch", F.lit(0)) + (F.col("user_id") % 9) * 43200).alias("next_sync_epoch"),
    )


SYNC_SQL = """
SELECT 'ats' || (user_id % 12) AS ats_key, 'https://c' || user_id || '.example' AS company_url, 'Company ' || (user_id % 40) AS company_name, last_success_epoch, last_failure_epoch,
  CAST(CASE WHEN coalesce(last_failure_epoch, 0) > coalesce(last_success_epoch, 0) THEN failures % 5 + 1 ELSE 0 END AS INTEGER) AS consecutive_failures,
  coalesce(last_success_epoch, last_failure_epoch, 0) + (user_id % 9) * 43200 AS next_sync_epoch
FROM (SELECT user_id, max(CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(floor(epoch(ts)) AS BIGINT) END) AS last_success_epoch,
        max(CASE WHEN event_type = 'error' THEN CAST(floor(epoch(ts)) AS BIGINT) END) AS last_failure_epoch, count(*) FILTER (event_type = 'error') AS failures
      FROM events GROUP BY 1) u
"""


def application_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's overlay: applied and ignored postings."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 6 < 2).select(
        F.concat(F.lit("https://jobs.example/p/"), k.cast("string")).alias("canonical_url"), (k % 6 == 0).alias("applied"), (k % 12 == 1).alias("ignored")
    )


STATE_SQL = """
SELECT 'https://jobs.example/p/' || o_orderkey AS canonical_url, o_orderkey % 6 = 0 AS applied, o_orderkey % 12 = 1 AS ignored FROM orders WHERE o_orderkey % 6 < 2
"""

#: Location texts as boards write them.
LOCATIONS = (
    "Berlin, Germany", "Münich, Bavaria", "New York, NY", "Remote - California", "TX-Austin-HQ", "US-CA-San Jose", "CA-ON-Toronto", "Toronto, ON", "DE - Remote", "GBR-London",
    "Zürich, Schweiz", "İstanbul, Türkiye", "Kraków, PL", "Paris / FR", "São Paulo, Brasil", "Hybrid - Škoda Plzeň, Czech Republic", "Multiple locations", "Worldwide", "Remote, EMEA", "Bengaluru",
    "Springfield, Greene County, MO", "Springfield, IL", "Portland, Oregon, United States", "Atlantis, Lost Kingdom", "Latin America", "Sydney NSW, Australia", "Hong Kong", "Tokyo; Japan", "IN", "IN-Pune",
    "You will be working with customers and our team to provide experience with skills in external places.", "Various - Nationwide", "Cork", "Georgia", "SGP", "Work from home",
)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with location texts of all kinds."""
    k = F.col("posting_no")
    place = F.element_at(F.array(*map(F.lit, LOCATIONS)), (k % len(LOCATIONS) + 1).cast("int"))
    return postings(spark, sf_dir).select(
        "canonical_url", "posting_no", "company_name", F.when(k % 8 == 0, F.concat("position_name", F.lit(" - remote"))).otherwise(F.col("position_name")).alias("position_name"), "ats_key",
        F.when(k % 6 == 0, F.col("country")).otherwise("").alias("country"), F.when(k % 6 == 0, F.col("region")).otherwise("").alias("region"), "remote_type", "hidden", "last_seen_epoch", "posted_at_epoch",
        "industry", "posting_date", "confidence", place.alias("location_text"),
    )


LOCATED_SQL = f"""
SELECT canonical_url, posting_no, company_name, CASE WHEN posting_no % 8 = 0 THEN position_name || ' - remote' ELSE position_name END AS position_name, ats_key,
  CASE WHEN posting_no % 6 = 0 THEN country ELSE '' END AS country, CASE WHEN posting_no % 6 = 0 THEN region ELSE '' END AS region, remote_type, hidden, last_seen_epoch, posted_at_epoch, industry, posting_date, confidence,
  [{', '.join("'" + x + "'" for x in LOCATIONS)}][posting_no % {len(LOCATIONS)} + 1] AS location_text
FROM postings
"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl targets: their source key is spelled in several ways."""
    k = F.col("c_custkey")
    key = F.when(k % 3 == 0, "ats").when(k % 3 == 1, "ATS-").otherwise("Ats ")
    return table(spark, sf_dir, "customer").select(
        k.alias("company_id"), F.col("c_name").alias("company_name"), F.concat(key, (k % 12).cast("string")).alias("ats_key"),
        F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example")).alias("company_url"), (F.lit(1_700_000_000) + k * 4321).cast("long").alias("created_epoch"),
    )


COMPANIES_SQL = """
SELECT c_custkey AS company_id, c_name AS company_name, CASE c_custkey % 3 WHEN 0 THEN 'ats' WHEN 1 THEN 'ATS-' ELSE 'Ats ' END || (c_custkey % 12) AS ats_key,
  'https://c' || c_custkey || '.example' AS company_url, 1700000000 + c_custkey * 4321 AS created_epoch FROM customer
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source, with its protection status."""
    n = F.col("n")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("n")).distinct()
    status = F.when(n % 6 == 1, "quarantine_only").when(n % 6 == 2, "canary_only").when(n % 6 == 3, "auto_disabled").when(n % 6 == 4, "").otherwise("normal")
    return rows.select(F.concat(F.lit("ats"), n.cast("string")).alias("ats_key"), F.concat(F.lit("Source "), n.cast("string")).alias("display_name"), (n % 6 != 3).alias("enabled"), status.alias("protection_status"))


SOURCES_SQL = """
SELECT 'ats' || n AS ats_key, 'Source ' || n AS display_name, n % 6 <> 3 AS enabled, CASE n % 6 WHEN 1 THEN 'quarantine_only' WHEN 2 THEN 'canary_only' WHEN 3 THEN 'auto_disabled' WHEN 4 THEN '' ELSE 'normal' END AS protection_status
FROM (SELECT DISTINCT user_id % 12 AS n FROM events) e
"""


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day and source; those of the last day are running."""
    day, n = F.floor(epoch("ts") / DAY).cast("long"), F.col("user_id") % 12
    rows = table(spark, sf_dir, "events").groupBy((day * 100 + n).alias("id"), n.alias("n"), day.alias("day")).agg(
        F.count("*").alias("fetch_count"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("accepted_count"), F.count_if(F.col("event_type") == "error").alias("rejected_count"), F.min(epoch("ts")).alias("started_epoch")
    )
    return rows.select("id", F.concat(F.lit("ats"), F.col("n").cast("string")).alias("ats_key"), "fetch_count", "accepted_count", "rejected_count", "started_epoch", F.when(F.col("day") >= 19752, "running").otherwise("done").alias("status"))


SOURCE_RUNS_SQL = """
SELECT day * 100 + n AS id, 'ats' || n AS ats_key, fetch_count, accepted_count, rejected_count, started_epoch, CASE WHEN day >= 19752 THEN 'running' ELSE 'done' END AS status FROM (
  SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, user_id % 12 AS n, count(*) AS fetch_count, count(*) FILTER (event_type IN ('purchase', 'signup')) AS accepted_count, count(*) FILTER (event_type = 'error') AS rejected_count,
    min(CAST(floor(epoch(ts)) AS BIGINT)) AS started_epoch FROM events GROUP BY 1, 2) r
"""

_SQL = {
    "postings": POSTINGS_SQL, "posting_cache": CACHE_SQL, "incoming": INCOMING_SQL, "search_events": SEARCH_EVENTS_SQL, "runs": RUNS_SQL, "run_errors": ERRORS_SQL,
    "sync_state": SYNC_SQL, "application_state": STATE_SQL, "located": LOCATED_SQL, "companies": COMPANIES_SQL, "sources": SOURCES_SQL, "source_runs": SOURCE_RUNS_SQL,
}


def oracle(body: str) -> str:
    """``body`` with the views it names in front of it."""
    import re

    used = [v for v in _SQL if re.search(rf"\b{v}\b", body)]
    if {"posting_cache", "located"} & {*used} and "postings" not in used:
        used.insert(0, "postings")
    ctes = [f"{v} AS ({_SQL[v].strip()})" for v in used]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*ctes, body[15:]])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*ctes, body[5:]])}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
