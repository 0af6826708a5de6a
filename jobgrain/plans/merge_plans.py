"""Merge and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.operators import merge as M
from jobgrain.plans.registry import query
from jobgrain.sources.views import AS_OF, EARLIER, EVENTS_AS_OF, application_state, epoch, errors, incoming, posting_cache, postings, runs, sync_state

_OK = "NOT (department = '' AND country = '')"
_BATCH = f"b AS (SELECT *, {_OK} AS accepted FROM incoming)"
_FOLD = f"""
{_BATCH},
f AS (SELECT canonical_url, arg_max(company_name, arrival) FILTER (accepted) AS company_name, arg_max(position_name, arrival) FILTER (accepted) AS position_name, arg_max(confidence, arrival) FILTER (accepted) AS confidence,
  arg_max(country, arrival) FILTER (accepted AND trim(country) <> '') AS country, arg_max(department, arrival) FILTER (accepted AND trim(department) <> '') AS department,
  coalesce(arg_max(remote_type, arrival) FILTER (accepted AND remote_type <> 'unknown'), 'unknown') AS remote_type, min(seen_epoch) FILTER (accepted) AS first_seen_epoch, max(seen_epoch) FILTER (accepted) AS last_seen_epoch, count(*) AS rows_in_batch,
  count(*) FILTER (accepted) AS accepted_rows, arg_max(accepted, arrival) AS shown FROM b GROUP BY 1)"""
_SNAP = f"p AS (SELECT canonical_url, company_name, position_name, confidence, country, region, city, location_text, '' AS department, remote_type, first_seen_epoch, last_seen_epoch, hidden, description_plain, posting_no FROM postings WHERE first_seen_epoch < {EARLIER})"
_NEW = "f.accepted_rows > 0"
_UPSERT = f"""
WITH {_FOLD}, {_SNAP}
SELECT coalesce(p.canonical_url, f.canonical_url) AS canonical_url, CASE WHEN {_NEW} THEN f.company_name ELSE p.company_name END AS company_name,
  CASE WHEN {_NEW} THEN f.position_name ELSE p.position_name END AS position_name, CASE WHEN {_NEW} THEN f.confidence ELSE p.confidence END AS confidence,
  CASE WHEN {_NEW} AND trim(coalesce(f.country, '')) <> '' THEN f.country ELSE p.country END AS country, p.region, p.city, p.location_text, CASE WHEN {_NEW} AND trim(coalesce(f.department, '')) <> '' THEN f.department ELSE p.department END AS department,
  CASE WHEN {_NEW} AND f.remote_type <> 'unknown' THEN f.remote_type ELSE coalesce(p.remote_type, 'unknown') END AS remote_type,
  least(p.first_seen_epoch, f.first_seen_epoch) AS first_seen_epoch, greatest(p.last_seen_epoch, f.last_seen_epoch) AS last_seen_epoch,
  CASE WHEN f.canonical_url IS NOT NULL THEN NOT shown ELSE p.hidden END AS hidden, p.description_plain, p.posting_no,
  CASE WHEN f.canonical_url IS NULL THEN 'untouched' WHEN p.canonical_url IS NULL THEN CASE WHEN shown THEN 'new' ELSE 'new_hidden' END WHEN NOT shown THEN CASE WHEN p.hidden THEN 'untouched' ELSE 'hidden' END WHEN p.hidden THEN 'unhidden' ELSE 'updated' END AS change
FROM p FULL JOIN f ON p.canonical_url = f.canonical_url WHERE p.canonical_url IS NOT NULL OR {_NEW}
"""


def snapshot(spark, sf_dir):
    rows = postings(spark, sf_dir).where(F.col("first_seen_epoch") < EARLIER).withColumn("department", F.lit(""))
    return rows.select("canonical_url", "company_name", "position_name", "confidence", "country", "region", "city", "location_text", "department", "remote_type", "first_seen_epoch", "last_seen_epoch", "hidden", "description_plain", "posting_no")


def gated(spark, sf_dir):
    """The landed batch with the gate's decision on each row."""
    return incoming(spark, sf_dir).withColumn("accepted", ~((F.col("department") == "") & (F.col("country") == "")))


@query(f"WITH {_FOLD} SELECT * FROM f")
def m1_fold_batch(spark, sf_dir):
    """M1's batch, folded in arrival order."""
    return M.fold_batch(gated(spark, sf_dir))


@query(_UPSERT)
def m1_upsert(spark, sf_dir):
    """Rows that fail the gate hide, the snapshot's other columns stay."""
    return M.upsert(snapshot(spark, sf_dir), gated(spark, sf_dir))


@query(f"SELECT canonical_url, CASE change WHEN 'hidden' THEN 'delete' ELSE 'upsert' END AS operation FROM ({_UPSERT}) u WHERE change IN ('new', 'unhidden', 'hidden')")
def m3_outbox(spark, sf_dir):
    """M2, M3: writes for rows that became visible, deletes for rows that were hidden."""
    return M.outbox_of(M.upsert(snapshot(spark, sf_dir), gated(spark, sf_dir)))


@query("""
WITH o AS (SELECT event_id AS id, 'u' || user_id AS canonical_url, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation FROM events)
SELECT canonical_url, arg_max(operation, id) AS operation, max(id) AS id, count(*) AS entries FROM o GROUP BY 1
""")
def m7_compact_outbox(spark, sf_dir):
    """M7."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("canonical_url"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation")
    )
    return M.compact_outbox(rows)


@query(f"""
SELECT ats_key, CASE WHEN hidden AND last_seen_epoch < {AS_OF} - 180 * 86400 THEN 'delete' WHEN NOT hidden AND last_seen_epoch < {AS_OF} - 30 * 86400 THEN 'hide' ELSE 'keep' END AS action, count(*) AS total
FROM postings GROUP BY 1, 2
""")
def m5_retention(spark, sf_dir):
    """M5: postings."""
    return M.retention(postings(spark, sf_dir), AS_OF).groupBy("ats_key", "action").agg(F.count("*").alias("total"))


_NEXT = """
b AS (SELECT canonical_url, ats_key, country, CASE WHEN confidence < 0.25 THEN '' ELSE region END AS region FROM postings WHERE NOT hidden
  UNION ALL SELECT canonical_url || '/new', ats_key, country, region FROM postings WHERE confidence = 0.5), a AS (SELECT canonical_url, ats_key, country, region FROM postings)"""


def _after(rows):
    kept = rows.where("not hidden").select("canonical_url", "ats_key", "country", F.when(F.col("confidence") < 0.25, "").otherwise(F.col("region")).alias("region"))
    return kept.union(rows.where("confidence = 0.5").select(F.concat("canonical_url", F.lit("/new")), "ats_key", "country", "region"))


@query(f"""
WITH {_NEXT}
SELECT coalesce(a.canonical_url, b.canonical_url) AS canonical_url, CASE WHEN a.canonical_url IS NULL THEN 'created' WHEN b.canonical_url IS NULL THEN 'deleted' ELSE 'updated' END AS change_type, a.country || '/' || a.region AS before, b.country || '/' || b.region AS after
FROM a FULL JOIN b ON a.canonical_url = b.canonical_url WHERE a.canonical_url IS NULL OR b.canonical_url IS NULL OR a.country IS DISTINCT FROM b.country OR a.region IS DISTINCT FROM b.region
""")
def q16_change_log(spark, sf_dir):
    """Q16: the audit log of a run, with the images."""
    rows = postings(spark, sf_dir)
    image = lambda c: F.concat(F.col(f"{c}.country"), F.lit("/"), F.col(f"{c}.region")).alias(c)
    return M.change_log(rows, _after(rows), ["country", "region"]).select("canonical_url", "change_type", image("before"), image("after"))


@query("SELECT canonical_url, country, region FROM postings")
def q16_rollback(spark, sf_dir):
    """Q16: applying a run and rolling it back restores the snapshot."""
    rows = postings(spark, sf_dir)
    after = _after(rows)
    return M.rollback(after, M.change_log(rows, after, ["country", "region"]), ["country", "region"])


_CACHED = ("validation_status", "validation_error", "parser_version", "company_name", "position_name", "source_job_id", "confidence", "raw_payload_hash")
_SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in _CACHED)


@query(f"""
WITH n AS (SELECT * REPLACE (CASE WHEN confidence < 0.1 THEN 'v9' ELSE parser_version END AS parser_version, CASE WHEN hidden THEN md5(raw_payload_hash) ELSE raw_payload_hash END AS raw_payload_hash) FROM posting_cache),
o AS (SELECT * FROM posting_cache WHERE last_seen_epoch < {EARLIER})
SELECT n.canonical_url, CASE WHEN o.canonical_url IS NULL THEN 'new' WHEN {_SAME} THEN 'same' ELSE 'changed' END AS change FROM n LEFT JOIN o ON n.canonical_url = o.canonical_url
""")
def m4_cache_changes(spark, sf_dir):
    """M4: eight compared fields."""
    cache = posting_cache(spark, sf_dir)
    batch = cache.withColumns({"parser_version": F.when(F.col("confidence") < 0.1, "v9").otherwise(F.col("parser_version")), "raw_payload_hash": F.when(F.col("hidden"), F.md5("raw_payload_hash")).otherwise(F.col("raw_payload_hash"))})
    return M.cache_changes(cache.where(F.col("last_seen_epoch") < EARLIER), batch, "canonical_url", list(_CACHED)).select("canonical_url", "change")


@query(f"""
SELECT 'posting_cache' AS name, count(*) FILTER (last_seen_epoch >= {AS_OF} - 365 * 86400) AS kept, count(*) FILTER (last_seen_epoch < {AS_OF} - 365 * 86400) AS deleted FROM posting_cache
UNION ALL SELECT 'ingestion_run_errors', count(*) FILTER (created_epoch >= {EVENTS_AS_OF} + 80 * 86400 - 90 * 86400), count(*) FILTER (created_epoch < {EVENTS_AS_OF} + 80 * 86400 - 90 * 86400) FROM run_errors
UNION ALL SELECT 'ingestion_runs', count(*) FILTER (started_epoch >= {EVENTS_AS_OF} + 80 * 86400 - 365 * 86400), count(*) FILTER (started_epoch < {EVENTS_AS_OF} + 80 * 86400 - 365 * 86400) FROM runs
""")
def m5_m6_pruned_tables(spark, sf_dir):
    """M5, M6: cache, errors and runs by their own days."""
    c = M.pruned_counts({"posting_cache": (posting_cache(spark, sf_dir), "last_seen_epoch")}, AS_OF)
    return c.union(M.pruned_counts({"ingestion_run_errors": (errors(spark, sf_dir), "created_epoch"), "ingestion_runs": (runs(spark, sf_dir), "started_epoch")}, EVENTS_AS_OF + 80 * 86_400))


@query(f"SELECT canonical_url FROM posting_cache WHERE last_seen_epoch >= {AS_OF} - 365 * 86400 AND last_seen_epoch >= {AS_OF} - 800 * 86400 AND last_seen_epoch < {AS_OF} - 100 * 86400")
def m6_date_window(spark, sf_dir):
    """M6: what a date window keeps of the pruned cache."""
    return M.date_window(M.prune(posting_cache(spark, sf_dir), "last_seen_epoch", AS_OF, 365), "last_seen_epoch", AS_OF - 800 * 86_400, AS_OF - 100 * 86_400).select("canonical_url")


@query("""
WITH u AS (SELECT ats_key, company_url, max(created_epoch) AS last_failure_epoch, CAST(count(*) AS INTEGER) AS failures FROM run_errors GROUP BY 1, 2)
SELECT company_url, CASE WHEN u.company_url IS NOT NULL THEN u.last_failure_epoch ELSE s.last_failure_epoch END AS last_failure_epoch, CASE WHEN u.company_url IS NOT NULL THEN u.failures ELSE s.consecutive_failures END AS consecutive_failures FROM sync_state s FULL JOIN u USING (company_url)
""")
def m8_sync_state(spark, sf_dir):
    """M8: failures merged into the sync state."""
    updates = errors(spark, sf_dir).groupBy("company_url").agg(F.max("created_epoch").alias("last_failure_epoch"), F.count("*").cast("int").alias("consecutive_failures"))
    return M.merge_state(sync_state(spark, sf_dir), updates, "company_url", ["last_failure_epoch", "consecutive_failures"])


_CUT = EVENTS_AS_OF - 10 * 86_400


@query(f"""
WITH o AS (SELECT 'https://c' || user_id || '.example' AS company_url, CAST(floor(epoch(ts)) AS BIGINT) AS at_epoch, event_type <> 'error' AS ok FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND floor(epoch(ts)) >= {_CUT}),
b AS (SELECT 'https://c' || user_id || '.example' AS company_url, max(floor(epoch(ts))) FILTER (event_type <> 'error') AS s, max(floor(epoch(ts))) FILTER (event_type = 'error') AS f, count(*) FILTER (event_type = 'error') AS k FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND floor(epoch(ts)) < {_CUT} GROUP BY 1),
u AS (SELECT company_url, max(at_epoch) FILTER (ok) AS success, max(at_epoch) FILTER (NOT ok) AS failure FROM o GROUP BY 1),
n AS (SELECT company_url, count(*) FILTER (NOT ok AND (success IS NULL OR at_epoch > success)) AS failed FROM o JOIN u USING (company_url) GROUP BY 1),
x AS (SELECT company_url, greatest(s, success) AS ls, greatest(f, failure) AS lf, CASE WHEN failed IS NULL THEN k WHEN success IS NOT NULL THEN failed ELSE coalesce(k, 0) + failed END AS c FROM b FULL JOIN u USING (company_url) LEFT JOIN n USING (company_url))
SELECT company_url, CAST(ls AS BIGINT) AS last_success_epoch, CAST(lf AS BIGINT) AS last_failure_epoch, CAST(c AS INTEGER) AS consecutive_failures,
  CAST(greatest(ls, lf) + floor(CASE WHEN c > 0 THEN least(604800.0, 900 * pow(2, least(c, 16) - 1)) ELSE 21600.0 END * (1 + (('0x' || left(md5(company_url), 8))::BIGINT % 1000) / 10000)) AS BIGINT) AS next_sync_epoch FROM x
""")
def m8_t29_sync_after_runs(spark, sf_dir):
    """Successes and failures of the last days merged into the state before, and when each target is due again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('purchase', 'signup', 'error')")
    rows = e.select(F.concat(F.lit("https://c"), F.col("user_id").cast("string"), F.lit(".example")).alias("company_url"), epoch("ts").alias("at_epoch"), (F.col("event_type") != "error").alias("ok"))
    old, new = rows.where(F.col("at_epoch") < _CUT), rows.where(F.col("at_epoch") >= _CUT)
    state = old.groupBy("company_url").agg(F.max(F.when(F.col("ok"), F.col("at_epoch"))).alias("last_success_epoch"), F.max(F.when(~F.col("ok"), F.col("at_epoch"))).alias("last_failure_epoch"), F.count_if(~F.col("ok")).cast("int").alias("consecutive_failures"))
    return M.sync_after(state, new)


@query("""
WITH u AS (SELECT 'https://jobs.example/p/' || l_orderkey AS canonical_url, bool_or(l_returnflag = 'R') AS applied, bool_or(l_returnflag = 'A') AS ignored FROM lineitem GROUP BY 1)
SELECT canonical_url, CASE WHEN u.canonical_url IS NOT NULL THEN u.applied ELSE s.applied END AS applied, CASE WHEN u.canonical_url IS NOT NULL THEN u.ignored ELSE s.ignored END AS ignored FROM application_state s FULL JOIN u USING (canonical_url)
""")
def m9_m10_application_state(spark, sf_dir):
    """A user's marks merged into the overlay."""
    marks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat(F.lit("https://jobs.example/p/"), F.col("l_orderkey").cast("string")).alias("canonical_url"))
    updates = marks.agg(F.bool_or(F.col("l_returnflag") == "R").alias("applied"), F.bool_or(F.col("l_returnflag") == "A").alias("ignored"))
    return M.merge_state(application_state(spark, sf_dir), updates, "canonical_url", ["applied", "ignored"])


@query("""
SELECT canonical_url, company_name, count(*) OVER (PARTITION BY canonical_url) - 1 AS duplicates FROM incoming QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY arrival) = 1
""")
def w7_first_of_batch(spark, sf_dir):
    """W7."""
    return M.first_of_batch(incoming(spark, sf_dir), [F.asc("arrival")]).select("canonical_url", "company_name", "duplicates")
