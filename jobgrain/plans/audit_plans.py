"""Audit, backlog, dashboard and store-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.operators import audit as A
from jobgrain.plans.registry import query
from jobgrain.sources.views import AS_OF, EARLIER, EVENTS_AS_OF, errors, posting_cache, postings, runs, sync_state

_REASON = (
    "CASE WHEN http_status = 429 THEN 'rate_limited' WHEN http_status IN (401, 403) THEN 'blocked' WHEN http_status IN (404, 410) THEN 'not_found' WHEN http_status >= 500 THEN 'server_error' "
    "WHEN error_type LIKE '%timeout%' THEN 'timeout' WHEN error_type LIKE '%parser\\_%' ESCAPE '\\' OR error_type LIKE '%schema%' THEN 'parser' WHEN error_type LIKE '%validation%' THEN 'validation' "
    "WHEN error_type LIKE '%network%' THEN 'network' ELSE 'other' END"
)
_DUE = f"next_sync_epoch <= {EVENTS_AS_OF}"


@query("""
WITH w AS (SELECT run_id, ats_key, count(*) AS successes FROM sync_state JOIN runs ON last_success_epoch BETWEEN started_epoch AND finished_epoch GROUP BY 1, 2),
l AS (SELECT run_id, ats_key, count(*) AS failures FROM run_errors GROUP BY 1, 2)
SELECT run_id, ats_key, coalesce(successes, 0) AS successes, coalesce(failures, 0) AS failures, round(coalesce(successes, 0) * 100 / (coalesce(successes, 0) + coalesce(failures, 0)), 2) AS success_percent
FROM w FULL JOIN l USING (run_id, ats_key)
""")
def j5_j6_run_outcomes(spark, sf_dir):
    """Full outer join over an interval join."""
    return A.run_source_outcomes(sync_state(spark, sf_dir), errors(spark, sf_dir), runs(spark, sf_dir))


@query("""
SELECT error_id, CASE WHEN s.last_success_epoch BETWEEN r.started_epoch AND r.finished_epoch THEN 'posting_rejection' ELSE 'target_failure' END AS scope
FROM run_errors e LEFT JOIN runs r USING (run_id) LEFT JOIN (SELECT ats_key, company_url, max(last_success_epoch) AS last_success_epoch FROM sync_state GROUP BY 1, 2) s
ON s.ats_key = e.ats_key AND s.company_url = e.company_url
""")
def j7_error_scope(spark, sf_dir):
    """J7."""
    return A.error_scope(errors(spark, sf_dir), sync_state(spark, sf_dir), runs(spark, sf_dir)).select("error_id", "scope")


@query(f"SELECT ats_key, error_type, http_status, error_message, count(*) AS total, max(created_epoch) AS latest FROM run_errors WHERE created_epoch >= {EVENTS_AS_OF} - 10 * 86400 GROUP BY 1, 2, 3, 4")
def a17_error_groups(spark, sf_dir):
    """A17."""
    return A.error_groups(errors(spark, sf_dir), EVENTS_AS_OF - 10 * 86400)


@query("""
WITH e AS (SELECT * FROM run_errors WHERE error_type LIKE 'parser\\_%' ESCAPE '\\' AND lower(error_message) NOT LIKE '%policy%'),
l AS (SELECT ats_key, count(*) AS total, max(created_epoch) AS latest_epoch, arg_max(error_message, row(created_epoch, error_id)) AS latest_message FROM e GROUP BY 1),
r AS (SELECT ats_key, error_type || ': ' || error_message AS reason, count(*) AS n, row_number() OVER (PARTITION BY ats_key ORDER BY count(*) DESC, error_type || ': ' || error_message) AS k FROM e GROUP BY 1, 2)
SELECT ats_key, total, latest_epoch, latest_message, reasons FROM l JOIN (SELECT ats_key, array_to_string(list(reason || ' x' || n ORDER BY k), '|') AS reasons FROM r WHERE k <= 5 GROUP BY 1) b USING (ats_key)
""")
def a10_w5_parser_attention(spark, sf_dir):
    """A10, W5, F11."""
    return A.parser_attention(errors(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""
SELECT ats_key, count(*) AS targets, count(*) FILTER ({_DUE}) AS due, count(*) FILTER ({_DUE} AND ats_key <> 'ats3') AS runnable_due, min(next_sync_epoch) FILTER ({_DUE}) AS oldest_due,
  count(*) FILTER (consecutive_failures > 0) AS failing, CAST(sum(CASE WHEN consecutive_failures > 0 THEN consecutive_failures ELSE 0 END) AS BIGINT) AS failure_pressure FROM sync_state GROUP BY 1
""")
def a16_backlog(spark, sf_dir):
    """A16, A25."""
    return A.backlog(sync_state(spark, sf_dir), EVENTS_AS_OF, paused=("ats3",))


@query(f"""
WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ats_key ORDER BY consecutive_failures > 0, next_sync_epoch, company_name, company_url) AS INTEGER) AS source_rank FROM sync_state WHERE {_DUE})
SELECT ats_key, company_url, source_rank FROM r WHERE source_rank <= 5 ORDER BY source_rank, next_sync_epoch, ats_key, company_url LIMIT 30
""")
def w2_w3_due_targets(spark, sf_dir):
    """Fair share per source."""
    return A.due_targets(sync_state(spark, sf_dir), EVENTS_AS_OF, 5, 30).select("ats_key", "company_url", "source_rank")


@query(f"SELECT b AS daily_budget, due, CAST(ceil(due / b) AS BIGINT) AS days FROM (SELECT count(*) FILTER ({_DUE}) AS due FROM sync_state) d, (VALUES (10), (50), (200)) v(b)")
def a43_days_to_clear(spark, sf_dir):
    """A43."""
    due = sync_state(spark, sf_dir).agg(F.count_if(F.col("next_sync_epoch") <= EVENTS_AS_OF).alias("due"))
    return A.days_to_clear(due, [10, 50, 200])


@query("""
WITH r AS (SELECT * FROM runs ORDER BY started_epoch DESC, run_id DESC LIMIT 20)
SELECT count(*) AS runs, min(run_id) AS first_run, max(run_id) AS last_run, CAST(sum(total_targets) AS BIGINT) AS total_targets, CAST(sum(success_count) AS BIGINT) AS success_count,
  CAST(sum(failure_count) AS BIGINT) AS failure_count, CAST(sum(posting_upsert_count) AS BIGINT) AS posting_upsert_count, CAST(sum(rejected_count) AS BIGINT) AS rejected_count,
  round(sum(success_count) * 100 / sum(total_targets), 2) AS success_percent, round(sum(failure_count) * 100 / sum(total_targets), 2) AS failure_percent FROM r
""")
def a19_w8_run_trend(spark, sf_dir):
    """A19, W8."""
    return A.run_trend(runs(spark, sf_dir), 20)


@query(f"""
WITH h AS (SELECT CAST(coalesce(sum(total_targets), 0) AS BIGINT) AS total_targets, CAST(coalesce(sum(success_count), 0) AS BIGINT) AS success_count, CAST(coalesce(sum(failure_count), 0) AS BIGINT) AS failure_count
  FROM runs WHERE started_epoch >= {EVENTS_AS_OF} - 72 * 3600),
f AS (SELECT {_REASON} AS reason, count(*) AS n FROM run_errors WHERE created_epoch >= {EVENTS_AS_OF} - 72 * 3600 GROUP BY 1)
SELECT h.*, CASE WHEN total_targets > 0 THEN round(success_count * 100 / total_targets, 2) END AS success_percent, (SELECT coalesce(array_to_string(list(reason || '=' || n ORDER BY reason), ','), '') FROM f) AS reasons FROM h
""")
def a20_health_window(spark, sf_dir):
    """A20, T28."""
    return A.health_window(runs(spark, sf_dir), errors(spark, sf_dir), EVENTS_AS_OF, 72)


@query(f"SELECT ats_key, {_REASON} AS reason, count(*) AS total FROM run_errors GROUP BY 1, 2")
def t28_failure_reasons(spark, sf_dir):
    """T28, A40."""
    return A.failure_reasons(errors(spark, sf_dir))


@query("""
SELECT day_start_epoch, targets_started, greatest(0, 330 - targets_started) AS remaining, targets_started >= 330 AS exhausted
FROM (SELECT CAST(floor(started_epoch / 86400) * 86400 AS BIGINT) AS day_start_epoch, CAST(sum(total_targets) AS BIGINT) AS targets_started FROM runs GROUP BY 1) u
""")
def a21_budget_usage(spark, sf_dir):
    """A21."""
    return A.budget_usage(runs(spark, sf_dir), 330)





@query("""
WITH s AS (SELECT DISTINCT lower(c_mktsegment) AS ats_key FROM customer UNION SELECT 'unused'),
c AS (SELECT ats_key, count(*) AS cached, count(*) FILTER (validation_status = 'valid') AS valid, count(*) FILTER (validation_status = 'quarantined') AS quarantined FROM posting_cache GROUP BY 1),
v AS (SELECT ats_key, count(*) AS visible, max(last_seen_epoch) AS newest_seen FROM postings WHERE NOT hidden GROUP BY 1), e AS (SELECT ats_key, count(*) AS errors FROM run_errors GROUP BY 1),
d AS (SELECT ats_key, coalesce(cached, 0) AS cached, coalesce(valid, 0) AS valid, coalesce(quarantined, 0) AS quarantined, coalesce(visible, 0) AS visible, coalesce(errors, 0) AS errors, newest_seen
  FROM s LEFT JOIN c USING (ats_key) LEFT JOIN v USING (ats_key) LEFT JOIN e USING (ats_key))
SELECT *, CASE WHEN cached > 0 THEN round(quarantined * 100 / cached, 2) END AS quarantine_percent, CASE WHEN cached > 0 THEN round(visible * 100 / cached, 2) END AS visible_percent,
  CASE WHEN cached < 20 THEN 'none' WHEN quarantined * 100 / cached >= 80 THEN 'disable' WHEN quarantined * 100 / cached >= 9 THEN 'quarantine_only' ELSE 'none' END AS action FROM d
""")
def j4_q8_dashboard(spark, sf_dir):
    """J4, Q8."""
    from jobgrain.sources.views import table

    sources = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("ats_key")).union(spark.createDataFrame([("unused",)], "ats_key string"))
    out = A.source_dashboard(sources, posting_cache(spark, sf_dir), postings(spark, sf_dir).where("not hidden"), errors(spark, sf_dir))
    return out.withColumn("action", A.protection_action(F.col("quarantined") * 100 / F.col("cached"), F.col("cached")))


@query("""
WITH h AS (SELECT * FROM postings WHERE source_job_id <> '')
SELECT a.canonical_url, b.canonical_url AS duplicate_of FROM h a JOIN h b ON a.ats_key = b.ats_key AND a.source_job_id = b.source_job_id AND a.canonical_url <> b.canonical_url
QUALIFY row_number() OVER (PARTITION BY a.canonical_url ORDER BY b.last_seen_epoch DESC, b.canonical_url) = 1
""")
def j9_duplicate_of(spark, sf_dir):
    """Groups of every size that share a source id."""
    return A.duplicate_of(postings(spark, sf_dir))


@query("""
SELECT canonical_url FROM postings a WHERE EXISTS (SELECT 1 FROM postings v WHERE NOT v.hidden AND lower(v.company_name) = lower(a.company_name)
  AND lower(v.position_name) = lower(a.position_name) AND v.canonical_url <> a.canonical_url AND v.last_seen_epoch BETWEEN a.last_seen_epoch - 60 * 86400 AND a.last_seen_epoch)
""")
def j8_title_duplicates(spark, sf_dir):
    """J8."""
    rows = postings(spark, sf_dir)
    return A.recent_title_duplicates(rows, rows.where("not hidden"), 60).select("canonical_url")


@query(f"""
SELECT canonical_url, 'missing' AS side FROM postings WHERE first_seen_epoch >= {EARLIER} AND NOT hidden
UNION ALL SELECT canonical_url, 'extra' FROM postings WHERE hidden AND first_seen_epoch < {EARLIER}
""")
def j12_o3_store_diff(spark, sf_dir):
    """What an index lacks, and what it should not hold."""
    rows = postings(spark, sf_dir)
    return A.diff_ids(rows.where("not hidden"), rows.where(F.col("first_seen_epoch") < EARLIER), "canonical_url")


@query("""
SELECT canonical_url, 'company_name' AS field, company_name AS left_value, CASE WHEN posting_no % 8 = 0 THEN upper(company_name) ELSE company_name END AS right_value FROM postings WHERE posting_no % 8 = 0 AND upper(company_name) <> company_name
UNION ALL SELECT canonical_url, 'country', country, NULL FROM postings WHERE posting_no % 12 = 0
""")
def j13_field_diff(spark, sf_dir):
    """J13."""
    left = postings(spark, sf_dir)
    right = left.withColumn("company_name", F.when(F.col("posting_no") % 8 == 0, F.upper("company_name")).otherwise(F.col("company_name"))).withColumn("country", F.when(F.col("posting_no") % 12 != 0, F.col("country")))
    return A.diff_fields(left, right, "canonical_url", ["company_name", "country", "region"])


_NEW = f"first_seen_epoch >= {AS_OF} - 365 * 86400 AND first_seen_epoch < {AS_OF}"
_IDX = "NOT hidden AND regexp_matches(canonical_url, '(?i)^https?://') AND trim(position_name) <> ''"
_GROW = f"count(*) AS new_rows, count(*) FILTER (NOT hidden) AS new_visible, count(*) FILTER ({_IDX}) AS new_indexable, count(*) FILTER ({_IDX} AND country <> '' AND region <> '') AS new_clean"


@query(f"""
SELECT *, CASE WHEN new_visible > 0 THEN round(new_clean * 100 / new_visible, 2) END AS clean_percent FROM (
  SELECT ats_key, {_GROW} FROM postings WHERE {_NEW} GROUP BY 1 UNION ALL SELECT '(all)', {_GROW} FROM postings WHERE {_NEW}) g
""")
def a12_f10_growth(spark, sf_dir):
    """A12, A14, F10."""
    return A.growth_by_source(postings(spark, sf_dir), AS_OF - 365 * 86400, AS_OF)


@query(f"""
WITH s AS (SELECT ats_key, count(*) AS targets, count(*) FILTER ({_DUE}) AS due, count(*) FILTER (consecutive_failures > 0) AS failing, max(last_success_epoch) AS newest_success, max(last_failure_epoch) AS newest_failure FROM sync_state GROUP BY 1),
e AS (SELECT ats_key, count(*) AS n FROM run_errors WHERE created_epoch >= {EVENTS_AS_OF} - 86400 GROUP BY 1)
SELECT ats_key, targets, due, failing, newest_success, newest_failure, coalesce(n, 0) AS day_errors, CASE WHEN newest_success IS NULL THEN 'never_succeeded' WHEN due = 0 THEN 'up_to_date'
  WHEN failing * 2 > targets THEN 'mostly_failing' WHEN coalesce(n, 0) > 0 THEN 'recent_errors' ELSE 'waiting' END AS reason FROM s LEFT JOIN e USING (ats_key)
""")
def a13_freshness(spark, sf_dir):
    """A13."""
    return A.freshness_report(sync_state(spark, sf_dir), errors(spark, sf_dir), EVENTS_AS_OF)


@query("""
WITH k AS (SELECT ats_key FROM postings UNION SELECT ats_key FROM run_errors UNION SELECT ats_key FROM sync_state)
SELECT ats_key, p.n AS postings, e.n AS errors, s.n AS targets FROM k LEFT JOIN (SELECT ats_key, count(*) AS n FROM postings GROUP BY 1) p USING (ats_key)
LEFT JOIN (SELECT ats_key, count(*) AS n FROM run_errors GROUP BY 1) e USING (ats_key) LEFT JOIN (SELECT ats_key, count(*) AS n FROM sync_state GROUP BY 1) s USING (ats_key)
""")
def a22_o2_source_spine(spark, sf_dir):
    """A22, O2."""
    n = lambda df, name: df.groupBy("ats_key").agg(F.count("*").alias(name))
    return A.source_spine(n(postings(spark, sf_dir), "postings"), n(errors(spark, sf_dir), "errors"), n(sync_state(spark, sf_dir), "targets"))


@query("""
SELECT ats_key, error_id, error_type FROM run_errors QUALIFY row_number() OVER (PARTITION BY ats_key ORDER BY created_epoch DESC, error_id DESC) = 1
""")
def a23_w6_latest_error(spark, sf_dir):
    """A23, W6."""
    return A.latest_per_key(errors(spark, sf_dir), "ats_key", [F.desc("created_epoch"), F.desc("error_id")]).select("ats_key", "error_id", "error_type")


@query("SELECT error_id, ats_key, error_type, http_status, created_epoch FROM run_errors ORDER BY created_epoch DESC, error_id DESC LIMIT 50")
def s10_newest_errors(spark, sf_dir):
    """S10."""
    return errors(spark, sf_dir).orderBy(F.desc("created_epoch"), F.desc("error_id")).limit(50).select("error_id", "ats_key", "error_type", "http_status", "created_epoch")
