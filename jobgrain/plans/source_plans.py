"""Queries about sources: protection, lanes, drift, guards, goals, aliases, status cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.functions.text import is_blank, percent
from jobgrain.operators import audit as A
from jobgrain.operators import sources as O
from jobgrain.plans.registry import query
from jobgrain.sources.views import AS_OF, DAY, EVENTS_AS_OF, companies, errors, posting_cache, postings, runs, source_runs, sources, sync_state


def _metrics(spark, sf_dir):
    """Counts by source and parser version of the cache and the postings."""
    is_ = lambda v: F.count_if(F.col("validation_status") == v)
    key = ["ats_key", "parser_version"]
    c = posting_cache(spark, sf_dir).groupBy(*key).agg(is_("valid").alias("accepted"), is_("quarantined").alias("quarantined"), is_("invalid").alias("rejected"), F.count_if(F.col("confidence") < 0.3).alias("parser_failures"), F.count_if(F.col("confidence") >= 0.9).alias("http_failures"))
    b = lambda n: is_blank(F.col(n))
    weak = F.col("remote_type") == "unknown"
    p = postings(spark, sf_dir).where("not hidden").groupBy(*key).agg(
        F.count("*").alias("visible"), F.count_if(b("country")).alias("missing_country"), F.count_if(b("city")).alias("missing_city"), F.count_if(b("country") | b("region") | b("city")).alias("missing_any_geo"),
        F.count_if(b("country") & b("region") & weak).alias("no_geo_no_remote"), F.count_if(weak).alias("unknown_remote"), F.count_if(F.col("posting_date") == "").alias("drifts"),
    )
    family = F.when(F.col("parser_version") == "v0", "direct_json").when(F.col("parser_version") == "v1", "html_public_sector").otherwise("other")
    return c.join(p, key).withColumn("family", family)


_METRICS = """
mc AS (SELECT ats_key, parser_version, count(*) FILTER (validation_status = 'valid') AS accepted, count(*) FILTER (validation_status = 'quarantined') AS quarantined, count(*) FILTER (validation_status = 'invalid') AS rejected,
  count(*) FILTER (confidence < 0.3) AS parser_failures, count(*) FILTER (confidence >= 0.9) AS http_failures FROM posting_cache GROUP BY 1, 2),
mp AS (SELECT ats_key, parser_version, count(*) AS visible, count(*) FILTER (country = '') AS missing_country, count(*) FILTER (city = '') AS missing_city, count(*) FILTER (country = '' OR region = '' OR city = '') AS missing_any_geo,
  count(*) FILTER (country = '' AND region = '' AND remote_type = 'unknown') AS no_geo_no_remote, count(*) FILTER (remote_type = 'unknown') AS unknown_remote, count(*) FILTER (posting_date = '') AS drifts FROM postings WHERE NOT hidden GROUP BY 1, 2),
m AS (SELECT *, accepted + quarantined + rejected AS n FROM mc JOIN mp USING (ats_key, parser_version)),
fig AS (SELECT *, round(accepted * 100 / n, 2) AS acc, round(100 - round(parser_failures * 100 / (n + parser_failures), 2), 2) AS suc, round(quarantined * 100 / n, 2) AS qua, round(rejected * 100 / n, 2) AS rej,
  round(missing_any_geo * 100 / visible, 2) AS anyg, round(no_geo_no_remote * 100 / visible, 2) AS nogeo, round(parser_failures * 100 / (n + parser_failures + http_failures + drifts), 2) AS pf,
  round(http_failures * 100 / (n + parser_failures + http_failures + drifts), 2) AS hf, round(drifts * 100 / (n + parser_failures + http_failures + drifts), 2) AS dr,
  CASE parser_version WHEN 'v0' THEN 85 WHEN 'v1' THEN 40 ELSE 60 END AS amin, CASE parser_version WHEN 'v0' THEN 95 WHEN 'v1' THEN 75 ELSE 85 END AS smin FROM m),
act AS (SELECT ats_key, parser_version, concat_ws('; ', CASE WHEN http_failures >= 10 AND hf >= 50 THEN 'http_blocked' END, CASE WHEN drifts >= 10 AND dr >= 10 THEN 'parser_drift' END) AS off,
  concat_ws('; ', CASE WHEN n >= 50 AND acc < amin THEN 'accepted_rate' END, CASE WHEN n >= 50 AND suc < smin THEN 'parser_success' END, CASE WHEN n >= 50 AND qua >= 70 THEN 'quarantine' END, CASE WHEN n >= 50 AND rej >= 30 THEN 'rejected' END,
    CASE WHEN visible >= 50 AND anyg >= 95 THEN 'missing_any_geo' END, CASE WHEN visible >= 50 AND nogeo > 5 THEN 'no_geo_no_remote' END, CASE WHEN parser_failures >= 10 AND pf >= 50 THEN 'parser_failure' END) AS lim FROM fig)"""


@query(f"WITH {_METRICS} SELECT ats_key, parser_version, CASE WHEN off <> '' THEN 'disable' WHEN lim <> '' THEN 'quarantine_only' ELSE 'none' END AS action, concat_ws('; ', nullif(off, ''), nullif(lim, '')) AS reasons FROM act")
def q8_protection(spark, sf_dir):
    """Q8: figures of a source against the limits of its family."""
    out = O.protection(O.source_figures(_metrics(spark, sf_dir)))
    return out.select("ats_key", "parser_version", "action", F.array_join("reasons", "; ").alias("reasons"))


def _source_actions(spark, sf_dir):
    e = errors(spark, sf_dir).groupBy("ats_key").agg(F.count_if(F.col("http_status").isNotNull()).alias("http_failures"), F.count_if(F.col("error_type").startswith("parser")).alias("parser_failures"))
    m = e.select("ats_key", F.lit(60).alias("accepted"), F.lit(5).alias("quarantined"), F.lit(2).alias("rejected"), F.lit(60).alias("visible"), "http_failures", "parser_failures", *[F.lit(0).alias(c) for c in ("missing_country", "missing_city", "missing_any_geo", "no_geo_no_remote", "unknown_remote", "drifts")], F.lit("enterprise_detail").alias("family"))
    return O.protection(O.source_figures(m))


_ACTIONS = """
e AS (SELECT ats_key, count(*) FILTER (http_status IS NOT NULL) AS h, count(*) FILTER (error_type LIKE 'parser%') AS p FROM run_errors GROUP BY 1),
a AS (SELECT ats_key, h >= 10 AND round(h * 100 / (67 + h + p), 2) >= 50 AS off, concat_ws('; ', CASE WHEN round(100 - round(p * 100 / (67 + p), 2), 2) < 85 THEN 'parser_success' END, CASE WHEN p >= 10 AND round(p * 100 / (67 + h + p), 2) >= 50 THEN 'parser_failure' END) AS lim FROM e),
x AS (SELECT ats_key, enabled, protection_status, CASE WHEN off THEN 'disable' WHEN lim <> '' THEN 'quarantine_only' ELSE 'none' END AS action, concat_ws('; ', CASE WHEN off THEN 'http_blocked' END, nullif(lim, '')) AS reasons FROM sources LEFT JOIN a USING (ats_key)),
y AS (SELECT *, coalesce(action IN ('disable', 'quarantine_only') AND NOT ((action = 'disable' AND protection_status = 'auto_disabled' AND NOT enabled) OR (action = 'quarantine_only' AND protection_status = 'quarantine_only')), false) AS change FROM x)"""


@query(f"WITH {_ACTIONS} SELECT ats_key, CASE WHEN change THEN action <> 'disable' ELSE enabled END AS enabled, CASE WHEN change THEN CASE WHEN action = 'disable' THEN 'auto_disabled' ELSE 'quarantine_only' END ELSE protection_status END AS protection_status, CASE WHEN change THEN reasons END AS reason FROM y")
def q9_protected_sources(spark, sf_dir):
    """Q9: the next state of the sources."""
    return O.apply_protection(sources(spark, sf_dir), _source_actions(spark, sf_dir))[0]


@query(f"WITH {_ACTIONS} SELECT ats_key, CASE WHEN action = 'disable' THEN 'source_auto_disabled' ELSE 'source_quarantine_only' END AS event_type, CASE WHEN action = 'disable' THEN 'error' ELSE 'warning' END AS severity, reasons AS reason FROM y WHERE change")
def q9_protection_events(spark, sf_dir):
    """Q9: the events of the change."""
    return O.apply_protection(sources(spark, sf_dir), _source_actions(spark, sf_dir))[1]


_LANES = f"""
WITH s AS (SELECT ats_key, count(*) FILTER (next_sync_epoch <= {EVENTS_AS_OF}) AS due, count(last_success_epoch) AS su, count(*) FILTER (consecutive_failures > 1) AS fa FROM sync_state GROUP BY 1),
e AS (SELECT ats_key, count(*) FILTER (error_type = 'parser_schema' AND error_message LIKE '%8') AS pb, count(*) FILTER (error_type = 'network' AND error_message LIKE '%0') AS net, count(*) FILTER (http_status = 429 AND error_message LIKE '%2') AS rl, count(*) FILTER (http_status = 403 AND error_message LIKE '%2') AS au, count(*) FILTER (error_type = 'validation') AS sq FROM run_errors GROUP BY 1),
j AS (SELECT ats_key, CASE WHEN NOT enabled THEN 'disabled' WHEN protection_status = 'canary_only' THEN 'canary' WHEN protection_status = 'quarantine_only' THEN 'quarantine_only' ELSE 'normal' END AS mode, due, su, fa, round(su * 100 / nullif(su + fa, 0), 2) AS rate, coalesce(pb, 0) AS pb, coalesce(net, 0) AS net, coalesce(rl, 0) AS rl, coalesce(au, 0) AS au, coalesce(sq, 0) AS sq FROM sources JOIN s USING (ats_key) LEFT JOIN e USING (ats_key)),
l AS (SELECT *, CASE WHEN mode = 'disabled' THEN 'disabled' WHEN pb >= 2 THEN 'parser_attention' WHEN net + rl + au >= 3 THEN 'stability' WHEN su + fa >= 3 AND rate < 60 THEN 'stability' WHEN sq >= 5 THEN 'source_quality' WHEN mode IN ('canary', 'quarantine_only') THEN 'canary' ELSE 'healthy' END AS lane FROM j)
SELECT ats_key, lane, greatest(0, least(40, CASE WHEN due > 0 THEN due ELSE 40 END, CASE lane WHEN 'disabled' THEN 0 WHEN 'parser_attention' THEN 1 WHEN 'source_quality' THEN 2 WHEN 'stability' THEN 3 WHEN 'canary' THEN 2 ELSE 12 END)) AS cap, rate AS success_percent,
  concat_ws(',', CASE lane WHEN 'disabled' THEN 'source_policy_disabled' WHEN 'parser_attention' THEN 'parser_attention' END, CASE WHEN lane = 'stability' AND net + rl + au >= 3 AND net > 0 THEN 'network' END, CASE WHEN lane = 'stability' AND net + rl + au >= 3 AND rl > 0 THEN 'rate_limit' END,
    CASE WHEN lane = 'stability' AND net + rl + au >= 3 AND au > 0 THEN 'auth' END, CASE WHEN lane = 'stability' AND net + rl + au < 3 THEN 'low_success_rate' END, CASE WHEN lane = 'source_quality' THEN 'source_quality' END,
    CASE WHEN lane = 'canary' THEN CASE WHEN mode = 'canary' THEN 'canary_only' ELSE 'quarantine_only' END END, CASE WHEN due > 0 THEN 'due_backlog' END, CASE WHEN lane = 'healthy' AND rate >= 80 THEN 'healthy_success_rate' END) AS reasons FROM l
"""


@query(_LANES)
def q10_lanes(spark, sf_dir):
    """Lane and cap of each source from its recent figures."""
    s = sync_state(spark, sf_dir).groupBy("ats_key").agg(F.count_if(F.col("next_sync_epoch") <= EVENTS_AS_OF).alias("due"), F.count("last_success_epoch").alias("successes"), F.count_if(F.col("consecutive_failures") > 1).alias("failures"))
    kind, message, status = F.col("error_type"), F.col("error_message"), F.col("http_status")
    e = errors(spark, sf_dir).groupBy("ats_key").agg(
        F.count_if((kind == "parser_schema") & message.endswith("8")).alias("parser_bug"), F.count_if((kind == "network") & message.endswith("0")).alias("network"), F.count_if((status == 429) & message.endswith("2")).alias("rate_limit"),
        F.count_if((status == 403) & message.endswith("2")).alias("auth"), F.count_if(kind == "validation").alias("source_quality"),
    )
    mode = F.when(~F.col("enabled"), "disabled").when(F.col("protection_status") == "canary_only", "canary").when(F.col("protection_status") == "quarantine_only", "quarantine_only").otherwise("normal")
    rows = sources(spark, sf_dir).select("ats_key", mode.alias("mode"), F.lit(None).cast("int").alias("policy_cap")).join(s, "ats_key").join(e, "ats_key", "left").fillna(0, ["parser_bug", "network", "rate_limit", "auth", "source_quality"])
    return O.lanes(rows, 40).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""
WITH lane AS ({_LANES}), u AS (SELECT ats_key, count(*) AS used FROM run_errors WHERE created_epoch >= {EVENTS_AS_OF} - 2 * 86400 GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ats_key ORDER BY consecutive_failures > 0, next_sync_epoch, company_name, company_url) AS INTEGER) AS source_rank FROM sync_state WHERE next_sync_epoch <= {EVENTS_AS_OF})
SELECT ats_key, company_url, source_rank FROM r LEFT JOIN lane USING (ats_key) LEFT JOIN u USING (ats_key) WHERE source_rank <= least(10, coalesce(cap, 10), greatest(0, 20 - coalesce(used, 0))) ORDER BY source_rank, next_sync_epoch, ats_key, company_url LIMIT 60
""")
def w3_capped_targets(spark, sf_dir):
    """Due targets under the caps of their sources' lanes and what is left of daily budgets."""
    used = errors(spark, sf_dir).where(F.col("created_epoch") >= EVENTS_AS_OF - 2 * 86_400).groupBy("ats_key").agg(F.count("*").alias("used"))
    return A.due_targets(sync_state(spark, sf_dir), EVENTS_AS_OF, 10, 60, q10_lanes(spark, sf_dir), used, 20).select("ats_key", "company_url", "source_rank")



def _shapes(spark, sf_dir):
    """Baselines and events with shapes of four kinds, by posting."""
    k = F.col("posting_no")
    paths = lambda *p: F.array(*map(F.lit, p))
    shape = F.when(k % 4 == 0, paths("jobs:array", "jobs[].id:number", "jobs[].title:string")).when(k % 4 == 1, paths("jobs:array", "jobs[].id:number", "jobs[].title:string", "total:number")).when(k % 4 == 2, paths("jobs:array", "jobs[]:empty")).otherwise(paths("error:string"))
    events = postings(spark, sf_dir).select("ats_key", "parser_version", shape.alias("shape_paths"))
    base = events.select("ats_key", "parser_version").distinct().where("parser_version <> 'v2'")
    return events, base.withColumn("shape_paths", paths("jobs:array", "jobs[].id:number", "jobs[].title:string"))


@query("""
SELECT ats_key, count(*) AS events, count(*) FILTER (parser_version <> 'v2' AND posting_no % 4 = 3) AS still_drift, count(*) FILTER (parser_version <> 'v2' AND posting_no % 4 IN (0, 1)) AS passed, count(*) FILTER (posting_no % 4 = 2) AS empty,
  count(*) FILTER (parser_version = 'v2' AND posting_no % 4 <> 2) AS no_baseline, count(*) FILTER (posting_no % 4 = 2 OR parser_version <> 'v2' AND posting_no % 4 IN (0, 1)) AS resolved FROM postings GROUP BY 1
""")
def q12_drift_recheck(spark, sf_dir):
    """Drift events under the present policy."""
    return O.drift_recheck(*_shapes(spark, sf_dir))


@query(f"""
WITH s AS (SELECT company_url, max(last_success_epoch) AS ok FROM sync_state GROUP BY 1)
SELECT company_id, CASE WHEN coalesce(ok, 0) > 0 THEN 'real_empty_after_prior_success' WHEN {EVENTS_AS_OF} - created_epoch < 7 * 86400 THEN 'new_never_success_empty' ELSE 'stale_never_success_empty' END AS board FROM companies LEFT JOIN s USING (company_url)
""")
def q19_empty_boards(spark, sf_dir):
    """Q19: what an empty board means."""
    s = sync_state(spark, sf_dir).groupBy("company_url").agg(F.max("last_success_epoch").alias("last_success_epoch"))
    rows = companies(spark, sf_dir).join(s, "company_url", "left")
    return rows.select("company_id", O.empty_board(rows, EVENTS_AS_OF).alias("board"))


@query("""
WITH n AS (SELECT * FROM runs ORDER BY started_epoch DESC, run_id DESC LIMIT 10), l AS (SELECT total_targets AS t, success_count AS s FROM n ORDER BY started_epoch DESC, run_id DESC LIMIT 1), g AS (SELECT sum(total_targets) AS t, sum(success_count) AS s FROM n),
a AS (SELECT count(*) AS attention FROM run_errors WHERE error_type LIKE 'parser\\_%' ESCAPE '\\' AND NOT lower(error_message) LIKE '%policy%'),
d AS (SELECT count(*) FILTER (parser_version <> 'v2' AND posting_no % 4 = 3) AS still, count(*) FILTER (posting_no % 4 = 2 OR parser_version <> 'v2' AND posting_no % 4 IN (0, 1)) AS resolved FROM postings),
x AS (SELECT round(l.s * 100 / l.t, 2) AS latest_percent, round(g.s * 100 / g.t, 2) AS trend_percent, greatest(0, attention - resolved) AS open_attention, still, g.t AS targets FROM l, g, a, d),
y AS (SELECT *, concat_ws(',', CASE WHEN latest_percent < 80 THEN 'latest_run_success_rate_below_threshold' END, CASE WHEN targets >= 50 AND trend_percent < 80 THEN 'recent_run_success_rate_below_threshold' END, CASE WHEN open_attention > 0 THEN 'parser_attention_unresolved' END, CASE WHEN still > 0 THEN 'parser_drift_unresolved' END) AS blockers FROM x)
SELECT latest_percent, trend_percent, open_attention, blockers, blockers = '' AS ready FROM y
""")
def q20_throughput_gate(spark, sf_dir):
    """Q20: may throughput be raised?"""
    return O.throughput_gate(runs(spark, sf_dir), A.parser_attention(errors(spark, sf_dir)), O.drift_recheck(*_shapes(spark, sf_dir)))


def _tenants(spark, sf_dir):
    rows = posting_cache(spark, sf_dir)
    good = F.col("validation_status") == "valid"
    return rows.groupBy("ats_key", F.col("company_name").alias("tenant")).agg(F.count_if(good).alias("gain"), F.count_if(good & (F.col("posting_no") % 9 == 0)).alias("missing"), F.count_if(good & (F.col("posting_no") % 5 == 0)).alias("weak"), F.count_if(good & (F.col("posting_no") % 97 == 1)).alias("no_place"))


def _baseline(spark, sf_dir):
    b = lambda c: is_blank(F.col(c))
    return postings(spark, sf_dir).where("not hidden").groupBy("ats_key").agg(F.count("*").alias("visible"), F.count_if(b("country") | b("region") | b("city")).alias("missing"), F.count_if(F.col("remote_type") == "unknown").alias("weak"))


_GUARDS = """
b AS (SELECT ats_key, count(*) AS sv, count(*) FILTER (country = '' OR region = '' OR city = '') AS sm, count(*) FILTER (remote_type = 'unknown') AS sw FROM postings WHERE NOT hidden GROUP BY 1),
g AS (SELECT sum(sv) AS gv, sum(sm) AS gm, sum(sw) AS gw FROM b),
t AS (SELECT ats_key, company_name AS tenant, count(*) FILTER (validation_status = 'valid') AS gain, count(*) FILTER (validation_status = 'valid' AND posting_no % 9 = 0) AS missing, count(*) FILTER (validation_status = 'valid' AND posting_no % 5 = 0) AS weak,
  count(*) FILTER (validation_status = 'valid' AND posting_no % 97 = 1) AS no_place FROM posting_cache GROUP BY 1, 2),
pr AS (SELECT t.*, concat_ws(',', CASE WHEN gain <= 0 THEN 'no_gain' END, CASE WHEN no_place > 0 THEN 'no_geo_no_remote' END, CASE WHEN round((gm + missing) * 100 / (gv + gain), 2) > round(gm * 100 / gv, 2) THEN 'g_missing_would_rise' END,
  CASE WHEN round((gw + weak) * 100 / (gv + gain), 2) > round(gw * 100 / gv, 2) THEN 'g_weak_would_rise' END, CASE WHEN round((sm + missing) * 100 / (sv + gain), 2) > round(sm * 100 / sv, 2) THEN 's_missing_would_rise' END,
  CASE WHEN round((sw + weak) * 100 / (sv + gain), 2) > round(sw * 100 / sv, 2) THEN 's_weak_would_rise' END) AS fails FROM t JOIN b USING (ats_key), g)"""


@query(f"WITH {_GUARDS} SELECT ats_key, tenant, gain, fails FROM pr")
def q18_guard_failures(spark, sf_dir):
    """What each tenant would do to the gap percentages."""
    return O.project(_baseline(spark, sf_dir), _tenants(spark, sf_dir)).select("ats_key", "tenant", "gain", F.array_join("fails", ",").alias("fails"))


@query(f"""
WITH RECURSIVE {_GUARDS},
o AS (SELECT pr.*, gv, gm, gw, sv, sm, sw, row_number() OVER (PARTITION BY ats_key ORDER BY gain DESC, tenant) AS i FROM pr JOIN b USING (ats_key), g WHERE fails = ''),
f AS (SELECT ats_key, 0::BIGINT AS i, 0::BIGINT AS run, 0::BIGINT AS miss, 0::BIGINT AS weak_, 0::BIGINT AS before, 0::BIGINT AS gain, 0::BIGINT AS missing, 0::BIGINT AS weak, false AS taken FROM b
  UNION ALL
  SELECT ats_key, i, CASE WHEN ok THEN run + gain ELSE run END, CASE WHEN ok THEN miss + missing ELSE miss END, CASE WHEN ok THEN weak_ + weak ELSE weak_ END, run, gain, missing, weak, ok
  FROM (SELECT f.ats_key, o.i, f.run, f.miss, f.weak_, o.gain, o.missing, o.weak,
    {" AND ".join(f"(20000 * (o.{p}{k} + f.{s} + o.{m}) + o.{p}v + f.run + o.gain) // (2 * (o.{p}v + f.run + o.gain)) <= (20000 * o.{p}{k} + o.{p}v) // (2 * o.{p}v)" for p in "gs" for k, s, m in (("m", "miss", "missing"), ("w", "weak_", "weak")))} AS ok
    FROM f JOIN o ON f.ats_key = o.ats_key AND o.i = f.i + 1) x),
r AS (SELECT * FROM f WHERE taken)
SELECT ats_key, stage, count(*) AS tenants, CAST(sum(gain) AS BIGINT) AS gain, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(weak) AS BIGINT) AS weak, sum(gain) >= stage AS reached FROM r, (VALUES (5), (20), (100), (1000)) v(stage) WHERE before < stage GROUP BY 1, 2
""")
def q18_safe_batches(spark, sf_dir):
    """Q18: batches that break no guard, by stage; the guards hold for the sum of what was taken."""
    return O.safe_batches(O.project(_baseline(spark, sf_dir), _tenants(spark, sf_dir)), (5, 20, 100, 1000))


_P = "round(count(*) FILTER ({0}) * 100 / count(*), 2)"


@query(f"""
WITH f AS (SELECT ats_key, parser_version, count(*) AS v, {_P.format("location_text <> ''")} AS l, {_P.format("country <> '' OR region <> '' OR city <> ''")} AS g, {_P.format("remote_type <> 'unknown'")} AS r, {_P.format("posting_date <> ''")} AS d, {_P.format("source_job_id <> ''")} AS i, count(*) FILTER (confidence < 0.1) AS fails FROM postings WHERE NOT hidden GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN ats_key = 'furniture' THEN 'disabled' WHEN parser_version = 'v2' THEN 'fixture_first' WHEN ats_key = 'building' THEN 'quarantine_quality_gate' WHEN v >= 100 THEN 'high_volume_quality_gate' WHEN v >= 95 THEN 'medium_volume_quality_gate' ELSE 'low_volume_monitor' END AS profile FROM f),
q AS (SELECT *, CASE profile WHEN 'disabled' THEN [0, 0, 0, 0] WHEN 'fixture_first' THEN [90, 85, 90, 50] WHEN 'quarantine_quality_gate' THEN [95, 90, 95, 60] WHEN 'high_volume_quality_gate' THEN [95, 90, 95, 70] WHEN 'medium_volume_quality_gate' THEN [90, 85, 90, 50] ELSE [85, 80, 85, 40] END AS w FROM p)
SELECT ats_key || parser_version AS ats_key, profile, concat_ws(',', CASE WHEN l < w[1] THEN 'location' END, CASE WHEN g < w[2] THEN 'geo' END, CASE WHEN r < w[3] THEN 'remote' END, CASE WHEN d < w[4] THEN 'date' END, CASE WHEN i < 99 THEN 'source_job_id' END) AS gaps,
  round(log10(v + 1) * 8 + greatest(0, w[1] - l) * 0.45 + greatest(0, w[2] - g) * 0.7 + greatest(0, w[3] - r) * 0.45 + greatest(0, w[4] - d) * 0.25 + greatest(0, 99 - i) * 0.35 + least(25, fails) + CASE profile WHEN 'fixture_first' THEN 30 WHEN 'disabled' THEN -100 ELSE 0 END, 2) AS priority FROM q
""")
def k9_goals(spark, sf_dir):
    """K9: profile, gaps and priority of each source."""
    b = lambda c: is_blank(F.col(c))
    p = lambda c: percent(F.count_if(c), F.count("*"))
    f = postings(spark, sf_dir).where("not hidden").groupBy("ats_key", "parser_version").agg(
        F.count("*").alias("visible"), p(~b("location_text")).alias("location_percent"), p(~(b("country") & b("region") & b("city"))).alias("geo_percent"), p(F.col("remote_type") != "unknown").alias("remote_percent"),
        p(~b("posting_date")).alias("date_percent"), p(~b("source_job_id")).alias("id_percent"), F.count_if(F.col("confidence") < 0.1).alias("failures"),
    )
    status = F.when(F.col("ats_key") == "building", "quarantine_only").otherwise("normal")
    f = f.withColumns({"fixture": F.col("parser_version") != "v2", "enabled": F.col("ats_key") != "furniture", "protection_status": status, "ats_key": F.concat("ats_key", "parser_version")})
    return O.goals(f, 100, 95).withColumn("gaps", F.array_join("gaps", ","))


_KEYED = "lower(regexp_replace(ats_key, '[^A-Za-z0-9]+', '', 'g'))"
_TARGETS = f"""
tg AS (SELECT c.company_id, {_KEYED.replace('ats_key', 'c.ats_key')} AS source_key, c.company_url, s.enabled, CASE WHEN trim(s.protection_status) = '' THEN 'normal' ELSE s.protection_status END AS status, next_sync_epoch
  FROM companies c JOIN sources s ON s.ats_key = {_KEYED.replace('ats_key', 'c.ats_key')} LEFT JOIN (SELECT ats_key, company_url, max(next_sync_epoch) AS next_sync_epoch FROM sync_state GROUP BY 1, 2) t ON t.ats_key = {_KEYED.replace('ats_key', 'c.ats_key')} AND t.company_url = c.company_url)"""


def _targets(spark, sf_dir):
    return O.source_targets(companies(spark, sf_dir), sources(spark, sf_dir), sync_state(spark, sf_dir))


@query(f"WITH {_TARGETS} SELECT company_id, source_key, status, next_sync_epoch FROM tg")
def j3_source_targets(spark, sf_dir):
    """Companies, sources and sync state on the standard spelling of the source's key."""
    return _targets(spark, sf_dir).select("company_id", "source_key", "status", "next_sync_epoch")


@query(f"""
WITH {_TARGETS}
SELECT count(*) AS configured_sources, count(*) FILTER (enabled) AS enabled_sources, count(*) FILTER (enabled AND s IN ('normal', 'public_enabled')) AS full_sources, count(*) FILTER (enabled AND s = 'canary_only') AS canary_sources, count(*) FILTER (enabled AND s = 'quarantine_only') AS quarantine_sources,
  count(*) FILTER (NOT enabled OR s IN ('disabled', 'auto_disabled')) AS disabled_sources, (SELECT count(*) FROM tg) AS targets, (SELECT count(*) FROM tg WHERE enabled AND status IN ('normal', 'public_enabled', 'canary_only')) AS crawled_targets,
  (SELECT count(*) FROM postings WHERE NOT hidden) AS postings, (SELECT count(DISTINCT company_name) FROM postings WHERE NOT hidden AND company_name <> '') AS visible_companies, (SELECT count(DISTINCT ats_key) FROM postings WHERE NOT hidden AND ats_key <> '') AS visible_sources,
  (SELECT count(*) FROM postings WHERE NOT hidden AND last_seen_epoch >= {AS_OF} - 86400) AS seen_in_a_day FROM (SELECT *, CASE WHEN trim(protection_status) = '' THEN 'normal' ELSE protection_status END AS s FROM sources) q
""")
def a4_global_counts(spark, sf_dir):
    """A4: global counts."""
    return O.global_counts(_targets(spark, sf_dir), sources(spark, sf_dir), postings(spark, sf_dir), AS_OF)


@query(f"""
WITH {_TARGETS}, s AS (SELECT ats_key, max(last_success_epoch) AS last_success_epoch, max(last_failure_epoch) AS last_failure_epoch FROM sync_state GROUP BY 1), c AS (SELECT source_key AS ats_key, count(DISTINCT company_id) AS companies FROM tg GROUP BY 1)
SELECT ats_key, display_name, enabled, protection_status, last_success_epoch, last_failure_epoch, coalesce(c.companies, 0) AS companies FROM sources LEFT JOIN s USING (ats_key) LEFT JOIN c USING (ats_key)
""")
def a35_source_admin(spark, sf_dir):
    """The admin list of sources."""
    return O.source_admin(sources(spark, sf_dir), _targets(spark, sf_dir), sync_state(spark, sf_dir))


@query("""
SELECT 'field' AS part, CAST(count(*) AS VARCHAR) AS value, CAST(count(*) FILTER (country = '') AS VARCHAR) AS detail FROM postings WHERE NOT hidden AND ats_key = 'machinery'
UNION ALL (SELECT 'error', CAST(error_id AS VARCHAR), error_type FROM run_errors WHERE ats_key = 'ats3' ORDER BY created_epoch DESC, error_id DESC LIMIT 25)
""")
def a35_parser_card(spark, sf_dir):
    """One source's card, fields and newest errors."""
    fields = O.parser_card("machinery", postings(spark, sf_dir), errors(spark, sf_dir))[0]
    newest = O.parser_card("ats3", postings(spark, sf_dir), errors(spark, sf_dir))[1]
    head = fields.select(F.lit("field").alias("part"), F.col("visible").cast("string").alias("value"), F.col("no_country").cast("string").alias("detail"))
    return head.union(newest.select(F.lit("error"), F.col("error_id").cast("string"), "error_type"))


@query(f"""
WITH {_TARGETS}
SELECT (SELECT run_id FROM runs ORDER BY started_epoch DESC, run_id DESC LIMIT 1) AS latest_run, (SELECT run_id FROM runs WHERE failure_count > 0 ORDER BY started_epoch DESC, run_id DESC LIMIT 1) AS latest_failed_run,
  (SELECT count(*) FROM tg WHERE enabled AND status NOT IN ('disabled', 'auto_disabled', 'quarantine_only') AND coalesce(next_sync_epoch, 0) <= {EVENTS_AS_OF}) AS due,
  (SELECT count(*) FROM run_errors WHERE created_epoch >= {EVENTS_AS_OF} - 172800 AND error_type LIKE 'parser%') AS attention
""")
def a42_sync_card(spark, sf_dir):
    """The status card of syncing."""
    recent = errors(spark, sf_dir).where(A.is_parser_attention() & (F.col("created_epoch") >= EVENTS_AS_OF - 2 * DAY))
    return O.sync_card(runs(spark, sf_dir), O.due_count(_targets(spark, sf_dir), EVENTS_AS_OF), recent)


@query("""
(SELECT 'active' AS listed, id, ats_key, status, started_epoch FROM source_runs WHERE status = 'running' ORDER BY started_epoch DESC, id DESC LIMIT 8) UNION ALL (SELECT 'latest', id, ats_key, status, started_epoch FROM source_runs ORDER BY id DESC LIMIT 8)
""")
def s11_run_status(spark, sf_dir):
    """Active and latest source runs."""
    return O.run_status(source_runs(spark, sf_dir), 8)


@query("SELECT run_id, total_targets, failure_count, started_epoch FROM runs ORDER BY started_epoch DESC, run_id DESC LIMIT 25")
def s10_newest_runs(spark, sf_dir):
    """The newest runs."""
    return runs(spark, sf_dir).orderBy(F.desc("started_epoch"), F.desc("run_id")).limit(25).select("run_id", "total_targets", "failure_count", "started_epoch")


@query("SELECT canonical_url, ats_key, validation_error, last_seen_epoch FROM posting_cache WHERE validation_status IN ('quarantined', 'invalid') ORDER BY last_seen_epoch DESC, canonical_url LIMIT 50")
def s10_newest_rejections(spark, sf_dir):
    """The newest quarantined and rejected rows."""
    rows = posting_cache(spark, sf_dir).where(F.col("validation_status").isin("quarantined", "invalid"))
    return rows.orderBy(F.desc("last_seen_epoch"), "canonical_url").limit(50).select("canonical_url", "ats_key", "validation_error", "last_seen_epoch")


_ALIASED = "ar AS (SELECT CASE WHEN company_id % 2 = 0 THEN ats_key ELSE ats_key || '-old' END AS ats_key, lower(company_url) AS company_url FROM (SELECT 'ats' || (c_custkey % 3) AS ats_key, c_custkey AS company_id, 'https://c' || (c_custkey % 45) || '.example' AS company_url FROM customer) z), al AS (SELECT 'ats' || n || '-old' AS ats_key, 'ats' || n AS canonical FROM (VALUES (0), (1), (2)) v(n))"


def _aliased(spark, sf_dir):
    k = F.col("company_id")
    key = F.concat(F.lit("ats"), (k % 3).cast("string"))
    rows = companies(spark, sf_dir).select(F.when(k % 2 == 0, key).otherwise(F.concat(key, F.lit("-old"))).alias("ats_key"), F.concat(F.lit("https://c"), (k % 45).cast("string"), F.lit(".example")).alias("company_url"))
    return rows, spark.createDataFrame([(f"ats{n}-old", f"ats{n}") for n in range(3)], "ats_key string, canonical string")


@query(f"WITH {_ALIASED} SELECT canonical, ar.ats_key, ar.company_url FROM ar JOIN al USING (ats_key) WHERE EXISTS (SELECT 1 FROM ar x WHERE x.ats_key = al.canonical AND x.company_url = ar.company_url)")
def j11_alias_conflicts(spark, sf_dir):
    """Rows of an alias that collide with its canonical source."""
    return O.alias_conflicts(*_aliased(spark, sf_dir), ["company_url"])


@query(f"WITH {_ALIASED}, c AS (SELECT ats_key, count(*) AS n FROM ar JOIN al USING (ats_key) WHERE EXISTS (SELECT 1 FROM ar x WHERE x.ats_key = al.canonical AND x.company_url = ar.company_url) GROUP BY 1) SELECT canonical, ats_key, count(*) AS rows, coalesce(any_value(n), 0) AS conflicts, coalesce(any_value(n), 0) = 0 AS safe FROM ar JOIN al USING (ats_key) LEFT JOIN c USING (ats_key) GROUP BY 1, 2")
def q23_alias_report(spark, sf_dir):
    """Q23: which aliases can be folded without a merge."""
    return O.alias_report(*_aliased(spark, sf_dir), ["company_url"])
