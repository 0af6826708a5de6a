"""Source operations: protection, lanes and caps, drift, guards, goals, alias conflicts, run lists and status cards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import is_blank, percent, trimmed
from jobgrain.operators.planning import shape_similarity

DAY = 86_400
#: Least accepted rate and parser success of a source family, in percent.
FAMILY_LIMITS = {"direct_json": (85, 95), "enterprise_detail": (60, 85), "html_public_sector": (40, 75)}
#: Limits of a source's figures in percent, least rows and least events that count.
LIMITS = {
    "quarantine": 70, "rejected": 30, "missing_country": 95, "missing_city": 98, "missing_any_geo": 95, "no_geo_no_remote": 5, "unknown_remote": 95, "parser_failure": 50, "http_failure": 50, "drift": 10,
    "rows": 50, "events": 10,
}
#: Statuses under which a source is crawled, and under which it is not.
CRAWLED, PAUSED = ("normal", "public_enabled", "canary_only"), ("disabled", "auto_disabled", "quarantine_only")


def status_of(c: Column) -> Column:
    return F.when(is_blank(c), "normal").otherwise(trimmed(c))


def source_figures(m: DataFrame) -> DataFrame:
    """Percentages of a source's counts (accepted, quarantined, rejected, visible, missing_*, unknown_remote, parser_failures, http_failures, drifts)."""
    c = F.col
    rows = c("accepted") + c("quarantined") + c("rejected")
    events = rows + c("parser_failures") + c("http_failures") + c("drifts")
    whole = rows + c("parser_failures")
    out = m.withColumns({"rows": rows, "accepted_percent": percent(c("accepted"), rows), "quarantine_percent": percent(c("quarantined"), rows), "rejected_percent": percent(c("rejected"), rows)})
    out = out.withColumn("parser_success_percent", F.when(whole > 0, F.round(100 - percent(c("parser_failures"), whole), 2)).otherwise(100.0))
    for name in ("missing_country", "missing_city", "missing_any_geo", "no_geo_no_remote", "unknown_remote"):
        out = out.withColumn(f"{name}_percent", percent(c(name), c("visible")))
    for name, count in (("parser_failure", "parser_failures"), ("http_failure", "http_failures"), ("drift", "drifts")):
        out = out.withColumn(f"{name}_percent", percent(c(count), events))
    return out


def protection(figures: DataFrame) -> DataFrame:
    """``action`` (disable, quarantine_only, none) and ``reasons`` (array) of ``source_figures`` rows with their ``family``."""
    c = F.col
    family = F.when(c("family").isin(*FAMILY_LIMITS), c("family")).otherwise("enterprise_detail")
    least = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in FAMILY_LIMITS.items() for x in (k, float(v[i]))]), family)
    enough, seen = c("rows") >= LIMITS["rows"], c("visible") >= LIMITS["rows"]
    over = lambda name: c(f"{name}_percent") >= LIMITS[name]
    disable = {
        "http_blocked": (c("http_failures") >= LIMITS["events"]) & over("http_failure"), "parser_drift": (c("drifts") >= LIMITS["events"]) & over("drift"),
    }
    limit = {
        "accepted_rate": enough & (c("accepted_percent") < least(0)), "parser_success": enough & (c("parser_success_percent") < least(1)),
        "quarantine": enough & over("quarantine"), "rejected": enough & over("rejected"),
        "missing_country": seen & over("missing_country") & over("unknown_remote"), "missing_city": seen & over("missing_city") & over("unknown_remote"),
        "missing_any_geo": seen & over("missing_any_geo"), "no_geo_no_remote": seen & (c("no_geo_no_remote_percent") > LIMITS["no_geo_no_remote"]),
        "parser_failure": (c("parser_failures") >= LIMITS["events"]) & over("parser_failure"),
    }
    named = lambda rules: F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    out = figures.withColumns({"_off": named(disable), "_limit": named(limit)})
    action = F.when(F.size("_off") > 0, "disable").when(F.size("_limit") > 0, "quarantine_only").otherwise("none")
    return out.withColumns({"action": action, "reasons": F.concat("_off", "_limit")}).drop("_off", "_limit")


def apply_protection(sources: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next state of the sources, and one event for each that changes (actions: ats_key, action, reasons)."""
    both = sources.join(actions.select("ats_key", "action", "reasons"), "ats_key", "left")
    same = ((F.col("action") == "disable") & (F.col("protection_status") == "auto_disabled") & ~F.col("enabled")) | ((F.col("action") == "quarantine_only") & (F.col("protection_status") == "quarantine_only"))
    change = F.coalesce(F.col("action").isin("disable", "quarantine_only") & ~same, F.lit(False))
    both = both.withColumn("change", change)
    status = F.when(F.col("action") == "disable", "auto_disabled").otherwise("quarantine_only")
    state = both.select(
        "ats_key", F.when(F.col("change"), F.col("action") != "disable").otherwise(F.col("enabled")).alias("enabled"), F.when(F.col("change"), status).otherwise(F.col("protection_status")).alias("protection_status"),
        F.when(F.col("change"), F.array_join("reasons", "; ")).alias("reason"),
    )
    events = both.where("change").select(
        "ats_key", F.when(F.col("action") == "disable", "source_auto_disabled").otherwise("source_quarantine_only").alias("event_type"), F.when(F.col("action") == "disable", "error").otherwise("warning").alias("severity"),
        F.array_join("reasons", "; ").alias("reason"),
    )
    return state, events


def lanes(signals: DataFrame, target_limit: int) -> DataFrame:
    """Lane, cap and reasons of each source (signals: mode, policy_cap, due, successes, failures, parser_bug, network, rate_limit, auth, source_quality)."""
    c = F.col
    attempts = c("successes") + c("failures")
    rate = F.when(attempts > 0, F.round(c("successes") * 100 / attempts, 2))
    unstable = c("network") + c("rate_limit") + c("auth")
    lane = (
        F.when(c("mode") == "disabled", "disabled").when(c("parser_bug") >= 2, "parser_attention").when(unstable >= 3, "stability").when((attempts >= 3) & (rate < 60), "stability")
        .when(c("source_quality") >= 5, "source_quality").when(c("mode").isin("canary", "quarantine_only"), "canary").otherwise("healthy")
    )
    shares = {"parser_attention": (1, 0.02), "source_quality": (2, 0.04), "stability": (2, 0.06), "canary": (1, 0.05), "healthy": (5, 0.3)}
    out = signals.withColumns({"lane": lane, "success_percent": rate})
    want = reduce(lambda rest, kv: F.when(F.col("lane") == kv[0], max(kv[1][0], -(-int(target_limit * kv[1][1] * 100) // 100))).otherwise(rest), shares.items(), F.lit(0))
    due = F.when(c("due") > 0, c("due")).otherwise(F.lit(target_limit))
    cap = F.greatest(F.lit(0), F.least(F.coalesce(c("policy_cap"), F.lit(1 << 30)), F.lit(target_limit), due, want))
    reasons = F.array_compact(F.array(
        F.when(F.col("lane") == "disabled", "source_policy_disabled"), F.when(F.col("lane") == "parser_attention", "parser_attention"),
        *[F.when((F.col("lane") == "stability") & (unstable >= 3) & (c(n) > 0), n) for n in ("network", "rate_limit", "auth")], F.when((F.col("lane") == "stability") & (unstable < 3), "low_success_rate"),
        F.when(F.col("lane") == "source_quality", "source_quality"), F.when(F.col("lane") == "canary", F.when(c("mode") == "canary", "canary_only").otherwise("quarantine_only")),
        F.when(c("due") > 0, "due_backlog"), F.when((F.col("lane") == "healthy") & (c("success_percent") >= 80), "healthy_success_rate"),
    ))
    return out.select("ats_key", "lane", cap.cast("long").alias("cap"), "success_percent", reasons.alias("reasons"))


def goals(figures: DataFrame, high: int, medium: int) -> DataFrame:
    """Threshold profile, gaps and priority of each source (figures: visible, location_percent, geo_percent, remote_percent, date_percent, id_percent,
    failures, fixture (boolean), enabled, protection_status)."""
    c = F.col
    status = status_of(c("protection_status"))
    profile = (
        F.when(~c("enabled") | (status == "disabled"), "disabled").when(~c("fixture"), "fixture_first").when(F.contains(status, F.lit("quarantine")), "quarantine_quality_gate").when(c("visible") >= high, "high_volume_quality_gate")
        .when(c("visible") >= medium, "medium_volume_quality_gate").when(c("visible") > 0, "low_volume_monitor").otherwise("no_live_rows_fixture_target")
    )
    #: Goals of a profile for location text, place, remote type and date, in percent.
    wanted = {
        "disabled": (0, 0, 0, 0), "fixture_first": (90, 85, 90, 50), "quarantine_quality_gate": (95, 90, 95, 60), "high_volume_quality_gate": (95, 90, 95, 70), "medium_volume_quality_gate": (90, 85, 90, 50),
        "low_volume_monitor": (85, 80, 85, 40), "no_live_rows_fixture_target": (0, 0, 0, 0),
    }
    out = figures.withColumn("profile", profile)
    goal = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v[i]))]), F.col("profile"))
    short = {n: F.greatest(F.lit(0.0), goal(i) - c(f"{n}_percent")) for i, n in enumerate(("location", "geo", "remote", "date"))}
    score = F.log10(c("visible") + 1) * 8 + sum((short[n] * w for n, w in (("location", 0.45), ("geo", 0.7), ("remote", 0.45), ("date", 0.25))), F.lit(0.0)) + F.greatest(F.lit(0.0), 99 - c("id_percent")) * 0.35
    score = score + F.least(F.lit(25), c("failures")) + F.when(F.col("profile") == "fixture_first", 30).when(F.col("profile") == "disabled", -100).otherwise(0)
    gaps = F.array_compact(F.array(*[F.when(short[n] > 0, n) for n in short], F.when((c("visible") > 0) & (c("id_percent") < 99), "source_job_id")))
    return out.select("ats_key", "profile", gaps.alias("gaps"), F.round(score, 2).alias("priority"))


def drift_recheck(events: DataFrame, baselines: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Drift events (ats_key, parser_version, shape_paths) under the present policy, per source: empty job lists and similar shapes are settled."""
    rows = events.join(baselines.select("ats_key", "parser_version", F.col("shape_paths").alias("baseline")), ["ats_key", "parser_version"], "left")
    empty = F.exists("shape_paths", lambda p: p.endswith("[]:empty")) & ~F.exists("shape_paths", lambda p: F.contains(p, F.lit("[].")))
    bare = F.coalesce(F.size("baseline"), F.lit(0)) <= 0
    near = shape_similarity(F.array_distinct("baseline"), F.array_distinct("shape_paths")) >= threshold
    outcome = F.when(empty, "empty_no_jobs").when(bare, "no_baseline").when(near, "pass").otherwise("still_drift")
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return rows.withColumn("outcome", outcome).groupBy("ats_key").agg(F.count("*").alias("events"), n("still_drift").alias("still_drift"), n("pass").alias("passed"), n("empty_no_jobs").alias("empty"), n("no_baseline").alias("no_baseline"), n("pass", "empty_no_jobs").alias("resolved"))


def empty_board(state: DataFrame, as_of: int, stale_days: int = 7) -> Column:
    """What an empty board means for a target: it had jobs before, it is new, or it never had any."""
    young = (F.coalesce("created_epoch", F.lit(0)) > 0) & (F.lit(as_of) - F.col("created_epoch") < stale_days * DAY)
    return F.when(F.coalesce("last_success_epoch", F.lit(0)) > 0, "real_empty_after_prior_success").when(young, "new_never_success_empty").otherwise("stale_never_success_empty")


def throughput_gate(runs: DataFrame, attention: DataFrame, recheck: DataFrame, last: int = 10, least_percent: float = 80.0, least_targets: int = 50) -> DataFrame:
    """One row: may throughput be raised? ``blockers`` from the latest run, the trend of the last runs and unsettled parser events."""
    newest = runs.orderBy(F.desc("started_epoch"), F.desc("run_id")).limit(last)
    latest = newest.agg(F.max_by(F.struct("total_targets", "success_count"), F.struct("started_epoch", "run_id")).alias("x"), F.sum("total_targets").alias("targets"), F.sum("success_count").alias("successes"))
    latest = latest.withColumns({"latest_percent": percent(F.col("x.success_count"), F.col("x.total_targets"), None), "trend_percent": percent(F.col("successes"), F.col("targets"), None)})
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(c)).scalar()
    one = latest.withColumns({"attention": total(attention, "total"), "resolved": total(recheck, "resolved"), "still_drift": total(recheck, "still_drift")})
    open_ = F.greatest(F.lit(0), F.col("attention") - F.col("resolved"))
    blockers = F.array_compact(F.array(
        F.when(F.col("latest_percent").isNull(), "latest_run_missing"), F.when(F.col("latest_percent") < least_percent, "latest_run_success_rate_below_threshold"),
        F.when((F.col("targets") >= least_targets) & (F.col("trend_percent") < least_percent), "recent_run_success_rate_below_threshold"), F.when(open_ > 0, "parser_attention_unresolved"), F.when(F.col("still_drift") > 0, "parser_drift_unresolved"),
    ))
    return one.select("latest_percent", "trend_percent", open_.alias("open_attention"), F.array_join(blockers, ",").alias("blockers"), (F.size(blockers) == 0).alias("ready"))


def project(baseline: DataFrame, tenants: DataFrame) -> DataFrame:
    """Each tenant's effect on the gap percentages of all rows and of its source, and the guards that it would break.

    baseline: ats_key, visible, missing, weak (one row per source); tenants: ats_key, tenant, gain, missing, weak, no_place.
    """
    counted = ("visible", "missing", "weak")
    whole = baseline.agg(F.struct(*[F.sum(c).alias(c) for c in counted]).alias("whole")).scalar()
    rows = tenants.join(baseline.select("ats_key", *[F.col(c).alias(f"s_{c}") for c in counted]), "ats_key", "left").fillna(0, [f"s_{c}" for c in counted])
    rows = rows.withColumn("whole", whole).withColumns({f"g_{c}": F.col(f"whole.{c}") for c in counted}).drop("whole")
    guards = [F.when(F.col("gain") <= 0, "no_gain"), F.when(F.col("no_place") > 0, "no_geo_no_remote")]
    for side in ("g", "s"):
        for gap in ("missing", "weak"):
            after = percent(F.col(f"{side}_{gap}") + F.col(gap), F.col(f"{side}_visible") + F.col("gain"))
            rows = rows.withColumn(f"{side}_{gap}_after", after)
            guards.append(F.when(after > percent(F.col(f"{side}_{gap}"), F.col(f"{side}_visible")), f"{side}_{gap}_would_rise"))
    return rows.withColumn("fails", F.array_compact(F.array(*guards)))


def _hundredths(part: int, whole: int) -> int:
    """A percentage in hundredths, halves up; 0 of nothing."""
    return (20_000 * part + whole) // (2 * whole) if whole > 0 else 0


#: What the fold of a source's tenants needs of each.
FOLDED = ("ats_key", "gain", "missing", "weak", "g_visible", "g_missing", "g_weak", "s_visible", "s_missing", "s_weak")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tenants of whole sources -> those taken, with what the tenants before them gain. Only running sums are kept."""
    source, gain, missing, weak = None, 0, 0, 0
    for b in batches:
        taken, before = [], []
        for i, (key, *n) in enumerate(zip(*(b.column(c).to_pylist() for c in FOLDED), strict=True)):
            if key != source:
                source, gain, missing, weak = key, 0, 0, 0
            g, m, w = gain + n[0], missing + n[1], weak + n[2]
            safe = all(
                _hundredths(had + more, all_ + g) <= _hundredths(had, all_) for all_, *gaps in (n[3:6], n[6:9]) for had, more in zip(gaps, (m, w), strict=True)
            )
            if safe:
                taken.append(i)
                before.append(gain)
                gain, missing, weak = g, m, w
        rows = b.take(pa.array(taken, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("ats_key", "tenant", "gain", "missing", "weak")), pa.array(before, pa.int64())], ["ats_key", "tenant", "gain", "missing", "weak", "before"])


def safe_tenants(projected: DataFrame) -> DataFrame:
    """The tenants that a source can take one after the other, largest gains first (ties by name): (ats_key, tenant, gain, missing, weak, before).

    A tenant is taken if it passes alone and the gap percentages of all rows and of the source, with all tenants taken so far and this one, stay
    at or below the baseline's; else it is skipped and the next one is tried. ``before`` is the gain of those taken before it. What is taken does
    not depend on a target, so every stage's batch is a beginning of this list. The tenants of a source are read in sorted order by one task, which
    keeps three sums.
    """
    good = projected.where(F.size("fails") == 0).select("tenant", *[F.col(c).cast("long" if c != "ats_key" else "string").alias(c) for c in FOLDED])
    ordered = good.repartition("ats_key").sortWithinPartitions("ats_key", F.desc("gain"), "tenant")
    return ordered.mapInArrow(_greedy, "ats_key string, tenant string, gain long, missing long, weak long, before long")


def safe_batches(projected: DataFrame, stages: tuple[int, ...] = (250, 500, 1000, 2500, 5000, 10000)) -> DataFrame:
    """Per source and stage: the tenants that together gain the stage's rows without breaking a guard, largest gains first.

    ``reached`` tells whether they gain as much as the stage asks for.
    """
    rows = safe_tenants(projected).withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    out = rows.where(F.col("before") < F.col("stage")).groupBy("ats_key", "stage").agg(F.count("*").alias("tenants"), F.sum("gain").alias("gain"), F.sum("missing").alias("missing"), F.sum("weak").alias("weak"))
    return out.withColumn("reached", F.col("gain") >= F.col("stage"))


def alias_conflicts(rows: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Rows under an alias source whose keys the canonical source has too (aliases: ats_key, canonical)."""
    old = rows.join(aliases, "ats_key")
    there = rows.select(F.col("ats_key").alias("canonical"), *keys).distinct()
    return old.join(there, ["canonical", *keys], "left_semi").select("canonical", "ats_key", *keys)


def alias_report(rows: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Per alias: its rows, its conflicts, and whether it can be folded without a merge."""
    n = rows.join(aliases, "ats_key").groupBy("canonical", "ats_key").agg(F.count("*").alias("rows"))
    c = alias_conflicts(rows, aliases, keys).groupBy("canonical", "ats_key").agg(F.count("*").alias("conflicts"))
    out = n.join(c, ["canonical", "ats_key"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return out.withColumn("safe", F.col("conflicts") == 0)


def source_targets(companies: DataFrame, sources: DataFrame, state: DataFrame) -> DataFrame:
    """Crawl targets with their source and sync state, by the standard spelling of the source's key."""
    key = lambda c: F.regexp_replace(F.lower(trimmed(F.col(c))), "[^a-z0-9]+", "")
    c = companies.withColumn("source_key", key("ats_key")).drop("ats_key")
    s = sources.select(key("ats_key").alias("source_key"), "enabled", status_of(F.col("protection_status")).alias("status"))
    t = state.groupBy(key("ats_key").alias("source_key"), "company_url").agg(F.max("next_sync_epoch").alias("next_sync_epoch"), F.max("last_success_epoch").alias("last_success_epoch"))
    return c.join(s, "source_key").join(t, ["source_key", "company_url"], "left")


def due_count(targets: DataFrame, as_of: int) -> DataFrame:
    """One row: the targets to be crawled now (those never crawled among them)."""
    due = F.col("enabled") & ~F.col("status").isin(*PAUSED) & (F.coalesce("next_sync_epoch", F.lit(0)) <= as_of)
    return targets.agg(F.count_if(due).alias("due"))


def global_counts(targets: DataFrame, sources: DataFrame, postings: DataFrame, as_of: int) -> DataFrame:
    """One row of counts over companies, sources by their state, and visible postings, one pass each."""
    status, on = status_of(F.col("protection_status")), F.col("enabled")
    s = sources.agg(
        F.count("*").alias("configured_sources"), F.count_if(on).alias("enabled_sources"), F.count_if(on & status.isin("normal", "public_enabled")).alias("full_sources"), F.count_if(on & (status == "canary_only")).alias("canary_sources"),
        F.count_if(on & (status == "quarantine_only")).alias("quarantine_sources"), F.count_if(~on | status.isin("disabled", "auto_disabled")).alias("disabled_sources"),
    )
    t = (F.count("*").alias("targets"), F.count_if(F.col("enabled") & F.col("status").isin(*CRAWLED)).alias("crawled_targets"))
    name = F.col("company_name")
    p = (
        F.count("*").alias("postings"), F.countDistinct(F.when(name != "", name)).alias("visible_companies"), F.countDistinct(F.when(F.col("ats_key") != "", F.col("ats_key"))).alias("visible_sources"),
        F.count_if(F.col("last_seen_epoch") >= as_of - DAY).alias("seen_in_a_day"),
    )
    one = lambda df, columns: df.agg(F.struct(*columns).alias("x")).scalar()
    return s.withColumns({"t": one(targets, t), "p": one(postings.where(~F.col("hidden")), p)}).select(*s.columns, "t.*", "p.*")


def source_admin(sources: DataFrame, targets: DataFrame, state: DataFrame) -> DataFrame:
    """Each source with its newest success and failure and its companies; both facts are aggregated before they are joined."""
    s = state.groupBy("ats_key").agg(F.max("last_success_epoch").alias("last_success_epoch"), F.max("last_failure_epoch").alias("last_failure_epoch"))
    c = targets.groupBy(F.col("source_key").alias("ats_key")).agg(F.countDistinct("company_id").alias("companies"))
    return sources.join(s, "ats_key", "left").join(c, "ats_key", "left").withColumn("companies", F.coalesce("companies", F.lit(0)))


def parser_card(source: str, postings: DataFrame, errors: DataFrame, last: int = 25) -> tuple[DataFrame, DataFrame]:
    """One source's field quality in one row, and its newest errors."""
    rows = postings.where((F.col("ats_key") == source) & ~F.col("hidden"))
    gap = {c: F.count_if(is_blank(F.col(c))).alias(f"no_{c}") for c in ("country", "region", "city", "location_text", "posting_date")}
    return rows.agg(F.count("*").alias("visible"), *gap.values()), errors.where(F.col("ats_key") == source).orderBy(F.desc("created_epoch"), F.desc("error_id")).limit(last)


def run_status(runs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest running and the newest of all runs: (listed, id, ats_key, status, started_epoch)."""
    pick = lambda df, name, *order: df.orderBy(*order).limit(limit).select(F.lit(name).alias("listed"), "id", "ats_key", "status", "started_epoch")
    return pick(runs.where("status = 'running'"), "active", F.desc("started_epoch"), F.desc("id")).union(pick(runs, "latest", F.desc("id")))


def sync_card(runs: DataFrame, due: DataFrame, attention: DataFrame) -> DataFrame:
    """One row: the latest run, the latest with failures, due targets and parser events of a day."""
    order = F.struct("started_epoch", "run_id")
    r = runs.agg(F.max_by("run_id", order).alias("latest_run"), F.max_by("run_id", F.when(F.col("failure_count") > 0, order)).alias("latest_failed_run"))
    return r.withColumns({"due": due.select("due").scalar(), "attention": attention.agg(F.count("*").alias("n")).scalar()})
