"""Source health: backlog, failures, runs, freshness, dashboards and joins between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import failure_reason, is_blank, lowered, percent, search_text

DAY = 86_400


def diff_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks: (key, side)."""
    lost = left.select(key).join(right.select(key), key, "left_anti").distinct().withColumn("side", F.lit("missing"))
    extra = right.select(key).join(left.select(key), key, "left_anti").distinct().withColumn("side", F.lit("extra"))
    return lost.unionByName(extra)


def diff_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field that differs: (key, field, left_value, right_value); null-safe."""
    both = left.select(key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields]), key)
    cell = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), cell(f)) for f in fields]))
    return both.select(key, F.explode(changed).alias("c")).select(key, "c.*")


def interval_join(points: DataFrame, point: str, spans: DataFrame, start: str, end: str, bucket: int = DAY) -> DataFrame:
    """Points inside [start, end]: an equi-join on time buckets and a residual test, so neither side is paired with all of the other.

    A span is spread over the buckets it covers, a point lies in one, so each match is found once. Spans without an end reach
    no further than the bucket of their start.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    wide = spans.withColumn("_bucket", F.explode(F.sequence(b(start), F.greatest(b(start), F.coalesce(b(end), b(start))))))
    return points.withColumn("_bucket", b(point)).join(wide, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("_bucket")


def run_source_outcomes(state: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """Successes and failures of every (run, source): one may lack the other."""
    inside = interval_join(state.where("last_success_epoch is not null"), "last_success_epoch", runs.select("run_id", "started_epoch", "finished_epoch"), "started_epoch", "finished_epoch")
    won = inside.groupBy("run_id", "ats_key").agg(F.count("*").alias("successes"))
    lost = errors.groupBy("run_id", "ats_key").agg(F.count("*").alias("failures"))
    both = won.join(lost, ["run_id", "ats_key"], "full_outer")
    return both.select("run_id", "ats_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("successes", "failures")]).withColumn(
        "success_percent", percent(F.col("successes"), F.col("successes") + F.col("failures"), None)
    )


def error_scope(errors: DataFrame, state: DataFrame, runs: DataFrame) -> DataFrame:
    """posting_rejection where the target succeeded inside the error's run, else target_failure."""
    last = state.groupBy("ats_key", "company_url").agg(F.max("last_success_epoch").alias("last_success_epoch"))
    rows = errors.join(runs.select("run_id", "started_epoch", "finished_epoch"), "run_id", "left").join(last, ["ats_key", "company_url"], "left")
    good = F.col("last_success_epoch").between(F.col("started_epoch"), F.col("finished_epoch"))
    return rows.withColumn("scope", F.when(good, "posting_rejection").otherwise("target_failure"))


def error_groups(errors: DataFrame, since: int) -> DataFrame:
    """Errors of the window by source, type, status and message."""
    return errors.where(F.col("created_epoch") >= since).groupBy("ats_key", "error_type", "http_status", "error_message").agg(F.count("*").alias("total"), F.max("created_epoch").alias("latest"))


def is_parser_attention() -> Column:
    """Parser errors that are not policy messages."""
    return F.col("error_type").startswith("parser_") & ~lowered(F.col("error_message")).contains("policy")


def parser_attention(errors: DataFrame, top: int = 5) -> DataFrame:
    """Per source: count, latest time and message, and the most frequent reasons as an array."""
    rows = errors.where(is_parser_attention())
    latest = rows.groupBy("ats_key").agg(
        F.count("*").alias("total"), F.max("created_epoch").alias("latest_epoch"), F.max_by("error_message", F.struct("created_epoch", "error_id")).alias("latest_message")
    )
    reasons = rows.groupBy("ats_key", F.concat_ws(": ", "error_type", "error_message").alias("reason")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("ats_key").orderBy(F.desc("n"), "reason"))
    best = reasons.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("ats_key").agg(F.array_sort(F.collect_list(F.struct("rank", "reason", "n"))).alias("r"))
    return latest.join(best.select("ats_key", F.transform("r", lambda x: F.concat(x["reason"], F.lit(" x"), x["n"].cast("string"))).alias("reasons")), "ats_key")


def backlog(state: DataFrame, as_of: int, paused: tuple[str, ...] = ()) -> DataFrame:
    """Per source: targets, due, due and not paused, oldest due time, failing targets and their failures."""
    due = F.col("next_sync_epoch") <= as_of
    runnable = due & ~F.col("ats_key").isin(*paused) if paused else due
    failing = F.col("consecutive_failures") > 0
    return state.groupBy("ats_key").agg(
        F.count("*").alias("targets"), F.count_if(due).alias("due"), F.count_if(runnable).alias("runnable_due"), F.min(F.when(due, F.col("next_sync_epoch"))).alias("oldest_due"),
        F.count_if(failing).alias("failing"), F.sum(F.when(failing, F.col("consecutive_failures")).otherwise(0)).alias("failure_pressure"),
    )


def due_targets(state: DataFrame, as_of: int, per_source: int, limit: int, caps: DataFrame | None = None, used: DataFrame | None = None, daily_budget: int | None = None) -> DataFrame:
    """The targets to run next: ranked within their source (failing last, earliest due first), capped per source, then overall.

    A source's cap is ``per_source``, or less: the cap of its lane (caps: ats_key, cap), and what its daily budget leaves (used: ats_key, used).
    """
    due = state.where(F.col("next_sync_epoch") <= as_of)
    own = W.partitionBy("ats_key").orderBy(F.col("consecutive_failures") > 0, "next_sync_epoch", "company_name", "company_url")
    ranked, most = due.withColumn("source_rank", F.row_number().over(own)).where(F.col("source_rank") <= per_source), [F.lit(per_source)]
    if caps is not None:
        ranked = ranked.join(caps.select("ats_key", F.col("cap").alias("_cap")), "ats_key", "left")
        most.append(F.coalesce("_cap", F.lit(per_source)))
    if used is not None and daily_budget is not None:
        ranked = ranked.join(used.select("ats_key", F.col("used").alias("_used")), "ats_key", "left")
        most.append(F.greatest(F.lit(0), daily_budget - F.coalesce("_used", F.lit(0))))
    kept = ranked.where(F.col("source_rank") <= (F.least(*most) if len(most) > 1 else most[0]))
    return kept.orderBy("source_rank", "next_sync_epoch", "ats_key", "company_url").limit(limit).select(*state.columns, "source_rank")


def days_to_clear(due: DataFrame, budgets: list[int]) -> DataFrame:
    """Days to clear a one-row count (due) at each of a few daily budgets."""
    return due.withColumn("daily_budget", F.explode(F.array(*map(F.lit, budgets)))).select("daily_budget", "due", F.ceil(F.col("due") / F.col("daily_budget")).alias("days"))


def run_trend(runs: DataFrame, last: int) -> DataFrame:
    """Sums and rates over the newest runs."""
    rows = runs.orderBy(F.desc("started_epoch"), F.desc("run_id")).limit(last)
    sums = [F.sum(c).alias(c) for c in ("total_targets", "success_count", "failure_count", "posting_upsert_count", "rejected_count")]
    out = rows.agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), *sums)
    return out.withColumn("success_percent", percent(F.col("success_count"), F.col("total_targets"), None)).withColumn("failure_percent", percent(F.col("failure_count"), F.col("total_targets"), None))


def health_window(runs: DataFrame, errors: DataFrame, as_of: int, hours: int = 24) -> DataFrame:
    """One row: targets, successes, failures of the window, and its failure reasons as a map."""
    since = as_of - hours * 3600
    head = runs.where(F.col("started_epoch") >= since).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_targets", "success_count", "failure_count")])
    reason = failure_reason(F.col("error_type"), F.col("http_status"), F.col("error_message"))
    reasons = errors.where(F.col("created_epoch") >= since).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    folded = reasons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ",").alias("reasons"))
    return head.withColumn("success_percent", percent(F.col("success_count"), F.col("total_targets"), None)).withColumn("reasons", folded.scalar())


def failure_reasons(errors: DataFrame) -> DataFrame:
    reason = failure_reason(F.col("error_type"), F.col("http_status"), F.col("error_message"))
    return errors.groupBy("ats_key", reason.alias("reason")).agg(F.count("*").alias("total"))


def budget_usage(runs: DataFrame, daily_budget: int) -> DataFrame:
    """Targets started per UTC day against a daily budget."""
    day = F.floor(F.col("started_epoch") / DAY) * DAY
    used = runs.groupBy(day.cast("long").alias("day_start_epoch")).agg(F.sum("total_targets").alias("targets_started"))
    return used.withColumn("remaining", F.greatest(F.lit(0), daily_budget - F.col("targets_started"))).withColumn("exhausted", F.col("targets_started") >= daily_budget)


def source_dashboard(sources: DataFrame, cache: DataFrame, visible: DataFrame, errors: DataFrame) -> DataFrame:
    """Sources with cache, visible and error figures: each fact is aggregated before it is joined."""
    status = lowered(F.col("validation_status"))
    c = cache.groupBy("ats_key").agg(F.count("*").alias("cached"), F.count_if(status == "valid").alias("valid"), F.count_if(status == "quarantined").alias("quarantined"))
    v = visible.groupBy("ats_key").agg(F.count("*").alias("visible"), F.max("last_seen_epoch").alias("newest_seen"))
    e = errors.groupBy("ats_key").agg(F.count("*").alias("errors"))
    out = sources.select("ats_key").distinct()
    for part in (c, v, e):
        out = out.join(part, "ats_key", "left")
    counts = ("cached", "valid", "quarantined", "visible", "errors")
    out = out.select("ats_key", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], "newest_seen")
    return out.withColumn("quarantine_percent", percent(F.col("quarantined"), F.col("cached"), None)).withColumn("visible_percent", percent(F.col("visible"), F.col("cached"), None))


def protection_action(quarantine_percent: Column, cached: Column, disable_at: float = 80.0, quarantine_at: float = 9.0, least: int = 20) -> Column:
    """disable, quarantine_only or none for a source."""
    return F.when(cached < least, "none").when(quarantine_percent >= disable_at, "disable").when(quarantine_percent >= quarantine_at, "quarantine_only").otherwise("none")


def duplicate_of(postings: DataFrame) -> DataFrame:
    """For every posting that shares its source id with another one: the newest other URL."""
    has = postings.where(~is_blank(F.col("source_job_id"))).select("canonical_url", "ats_key", "source_job_id", "last_seen_epoch")
    order = W.partitionBy("ats_key", "source_job_id").orderBy(F.desc("last_seen_epoch"), "canonical_url")
    two = has.withColumn("rank", F.row_number().over(order))
    best = two.where("rank <= 2").groupBy("ats_key", "source_job_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("canonical_url"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("canonical_url"))).alias("second")
    ).where("second is not null")
    out = has.join(best, ["ats_key", "source_job_id"])
    return out.select("canonical_url", F.when(F.col("canonical_url") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("duplicate_of"))


#: What diagnostics show of a posting and of its cached row.
SHOWN = ("canonical_url", "company_name", "position_name", "location_text", "city", "country", "region", "remote_type", "ats_key", "source_job_id", "posting_date", "posted_at_epoch", "first_seen_epoch", "last_seen_epoch", "hidden", "parser_version", "confidence")
CACHED_SHOWN = ("raw_payload_hash", "validation_status", "validation_error")


def diagnostics(postings: DataFrame, cache: DataFrame, scored: DataFrame) -> DataFrame:
    """Postings with their quality (scored: canonical_url, quality_score, quality_flags, rejection_reason) and what the cache knows of them; null where it knows nothing."""
    c = cache.select("canonical_url", *CACHED_SHOWN, F.col("last_seen_epoch").alias("cache_seen_epoch"))
    return postings.select(*SHOWN).join(scored, "canonical_url", "left").join(c, "canonical_url", "left")


def recent_title_duplicates(batch: DataFrame, visible: DataFrame, days: int = 7) -> DataFrame:
    """Rows of the batch whose company and title were seen within some days under another URL."""
    key = lambda df, p: df.select(F.lower("company_name").alias("_c"), F.lower("position_name").alias("_t"), F.col("canonical_url").alias(f"{p}_url"), F.col("last_seen_epoch").alias(f"{p}_seen"))
    left = batch.withColumn("_c", F.lower("company_name")).withColumn("_t", F.lower("position_name"))
    right = key(visible, "v")
    near = F.col("v_seen").between(F.col("last_seen_epoch") - days * DAY, F.col("last_seen_epoch"))
    return left.join(right, (left["_c"] == right["_c"]) & (left["_t"] == right["_t"]) & (F.col("canonical_url") != F.col("v_url")) & near, "left_semi").drop("_c", "_t")


def growth_by_source(postings: DataFrame, since: int, until: int) -> DataFrame:
    """New postings of a window with the indexable and clean ones, by source and in total."""
    rows = postings.where((F.col("first_seen_epoch") >= since) & (F.col("first_seen_epoch") < until))
    title_ok = ~is_blank(F.col("position_name")) & ~lowered(F.col("position_name")).isin("untitled", "unknown")
    indexable = ~F.col("hidden") & F.col("canonical_url").rlike("(?i)^https?://") & title_ok
    clean = indexable & ~is_blank(F.col("country")) & ~is_blank(F.col("region"))
    out = rows.rollup("ats_key").agg(
        F.grouping("ats_key").alias("g"), F.count("*").alias("new_rows"), F.count_if(~F.col("hidden")).alias("new_visible"), F.count_if(indexable).alias("new_indexable"), F.count_if(clean).alias("new_clean")
    )
    return out.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("ats_key")).alias("ats_key"), "new_rows", "new_visible", "new_indexable", "new_clean").withColumn(
        "clean_percent", percent(F.col("new_clean"), F.col("new_visible"), None)
    )


def freshness_report(state: DataFrame, errors: DataFrame, as_of: int) -> DataFrame:
    """Per source: newest success and failure, due targets, errors of a day, and the reason why it is behind."""
    s = backlog(state, as_of).join(state.groupBy("ats_key").agg(F.max("last_success_epoch").alias("newest_success"), F.max("last_failure_epoch").alias("newest_failure")), "ats_key")
    e = errors.where(F.col("created_epoch") >= as_of - DAY).groupBy("ats_key").agg(F.count("*").alias("day_errors"))
    out = s.join(e, "ats_key", "left").withColumn("day_errors", F.coalesce("day_errors", F.lit(0)))
    reason = (
        F.when(F.col("newest_success").isNull(), "never_succeeded").when(F.col("due") == 0, "up_to_date").when(F.col("failing") * 2 > F.col("targets"), "mostly_failing")
        .when(F.col("day_errors") > 0, "recent_errors").otherwise("waiting")
    )
    return out.select("ats_key", "targets", "due", "failing", "newest_success", "newest_failure", "day_errors", reason.alias("reason"))


def source_spine(*metrics: DataFrame, key: str = "ats_key") -> DataFrame:
    """All metric tables side by side over the union of their keys."""
    spine = metrics[0].select(key)
    for m in metrics[1:]:
        spine = spine.union(m.select(key))
    out = spine.distinct()
    for m in metrics:
        out = out.join(m, key, "left")
    return out


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
