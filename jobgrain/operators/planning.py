"""Decisions about sources: estimates, risk, recovery, guards, repair plans and store parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import is_blank, percent

#: What one failure of each reason adds to a source's recovery score.
RECOVERY_WEIGHTS = {"parser_bug": 100, "source_quality": 80, "rate_limit": 40, "network": 30, "auth": 40, "unknown": 20, "empty_no_jobs": 10}


def estimate_decision() -> Column:
    """What to do with a source, from its scan figures; the first rule that holds."""
    c = F.col
    judged = c("clean") + c("quarantined") + c("rejected")
    return (
        F.when(c("configured_targets") <= 0, "needs_virtual_targets").when(c("targets_scanned") <= 0, "no_targets_scanned")
        .when((c("rows_fetched") <= 0) | (c("fetch_failures") >= F.greatest(F.lit(3), F.ceil(c("targets_scanned") * 0.5))), "blocked_fetch")
        .when(c("rows_parsed") <= 0, "parser_or_empty")
        .when(((c("clean") <= 0) & (c("quarantined") + c("rejected") > 0)) | (percent(c("quarantined"), judged) >= 70) | (percent(c("rejected"), judged) >= 30), "needs_parser_quality_fix")
        .when(c("no_geo_no_remote") > 0, "fails_no_geo_no_remote")
        .when((c("net_new") > 0) & ((percent(c("missing_any_geo"), c("net_new")) >= 95) | (percent(c("weak_remote"), c("net_new")) >= 95)), "needs_geo_remote_fix")
        .when(c("net_new") > 0, "candidate_after_full_inventory").when(c("clean") > 0, "already_covered_or_update_only").otherwise("needs_review")
    )


def risk_score(status: Column) -> Column:
    """Gap percentages, size, certification and errors of a source as one figure."""
    certified = F.when(status == "certified", 0).when(status == "partial", 18).otherwise(35)
    off = F.when(status.isin("disabled", "unsupported"), -100).otherwise(0)
    return F.round(
        F.col("missing_country_percent") * 0.45 + F.col("missing_city_percent") * 0.25 + F.col("missing_any_percent") * 0.55 + F.col("weak_remote_percent") * 0.35
        + F.log10(F.col("total") + 1) * 10 + certified + F.least(F.lit(25), F.col("attention")) + off, 2,
    )


def wave(status: Column, score: Column, total: Column) -> Column:
    return (
        F.when(status.isin("unsupported", "disabled"), "disabled").when(total == 0, F.when(status == "certified", "monitor").otherwise("wave-4-fixture"))
        .when(score >= 180, "wave-1-live-gap").when(score >= 130, "wave-2-live-gap").when(status != "certified", "wave-3-certification").otherwise("monitor")
    )


def recovery_priorities(counts: DataFrame) -> DataFrame:
    """Lane and score of each source (counts: ats_key, a column per reason, failure_pressure, targets_due)."""
    score = F.col("targets_due") + F.col("failure_pressure") * 10
    for reason, weight in RECOVERY_WEIGHTS.items():
        score = score + F.col(reason) * weight
    lane = (
        F.when(F.col("parser_bug") > 0, "parser_bug").when(F.col("source_quality") > 0, "source_quality")
        .when(F.col("rate_limit") + F.col("network") + F.col("auth") + F.col("unknown") > 0, "stability").when(F.col("empty_no_jobs") > 0, "empty_no_jobs_cleanup").otherwise("due_backlog")
    )
    return counts.select("ats_key", lane.alias("lane"), score.alias("score")).orderBy(F.desc("score"), "ats_key")


def reason_groups(failures: DataFrame) -> DataFrame:
    """Failures by target, by source and by error type in one pass: (level, value, total)."""
    sets = failures.groupingSets([["company_url"], ["ats_key"], ["error_type"]], "company_url", "ats_key", "error_type").agg(
        F.grouping("company_url").alias("gt"), F.grouping("ats_key").alias("gs"), F.count("*").alias("total")
    )
    level = F.when(F.col("gt") == 0, "target").when(F.col("gs") == 0, "source").otherwise("error")
    value = F.when(F.col("gt") == 0, F.col("company_url")).when(F.col("gs") == 0, F.col("ats_key")).otherwise(F.col("error_type"))
    return sets.select(level.alias("level"), value.alias("value"), "total")


def facet_delta(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of a facet in two stores and their difference, where they differ."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = n(left, "expected").join(n(right, "actual"), key, "full_outer").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "actual")])
    return both.withColumn("delta", F.col("actual") - F.col("expected")).where("delta <> 0")


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources that accept fewer rows than before (both: ats_key, accepted)."""
    both = before.withColumnRenamed("accepted", "before").join(after.withColumnRenamed("accepted", "after"), "ats_key", "left")
    return both.withColumn("after", F.coalesce("after", F.lit(0))).where(F.col("after") < F.col("before")).withColumn("lost", F.col("before") - F.col("after"))


def gap_sources(visible: DataFrame) -> DataFrame:
    """Sources with any gap."""
    gap = {"no_country": is_blank(F.col("country")), "no_region": is_blank(F.col("region")), "weak_remote": F.col("remote_type") == "unknown"}
    out = visible.groupBy("ats_key").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in gap.items()])
    return out.where(" or ".join(f"{n} > 0" for n in gap))


def failure_pressure(errors: DataFrame, top: int = 3) -> DataFrame:
    """Per target: errors, and its most frequent error groups in order."""
    groups = errors.groupBy("ats_key", "company_url", "error_type").agg(F.count("*").alias("n"), F.max("created_epoch").alias("latest"))
    item = F.struct((-F.col("n")).alias("minus"), "error_type", "n")
    out = groups.groupBy("ats_key", "company_url").agg(F.sum("n").alias("errors"), F.max("latest").alias("latest"), F.slice(F.array_sort(F.collect_list(item)), 1, top).alias("groups"))
    return out.withColumn("groups", F.transform("groups", lambda g: F.concat(g["error_type"], F.lit("="), g["n"].cast("string"))))


def fold_aliases(metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias sources folded into their canonical one: sums, and the label of the canonical row where there is one."""
    named = metrics.join(aliases, "ats_key", "left").withColumn("canonical", F.coalesce("canonical", "ats_key"))
    rank = F.struct(F.col("ats_key") != F.col("canonical"), "ats_key")
    return named.groupBy("canonical").agg(F.sum("total").alias("total"), F.max("newest").alias("newest"), F.min_by("label", rank).alias("label"), F.count("*").alias("keys"))


def patch_effect(errors: DataFrame, change: int, hours: int) -> DataFrame:
    """Errors of each source in equal spans before and after a change."""
    span = hours * 3600
    t = F.col("created_epoch")
    out = errors.where(t.between(change - span, change + span - 1)).groupBy("ats_key").agg(F.count_if(t < change).alias("before"), F.count_if(t >= change).alias("after"))
    return out.withColumn("change_percent", F.when(F.col("before") > 0, F.round((F.col("after") - F.col("before")) * 100 / F.col("before"), 2)))


def place_options(visible: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Distinct regions and cities, cities only of the chosen countries."""
    region = visible.where(~is_blank(F.col("region"))).select(F.lit("region").alias("kind"), F.col("region").alias("value"))
    city = visible.where(~is_blank(F.col("city")))
    if countries:
        city = city.where(F.col("country").isin(*countries))
    return region.union(city.select(F.lit("city"), "city")).distinct()


def top_list_mismatches(left: DataFrame, right: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Positions at which the first n of two stores differ."""
    w = W.orderBy(*order)
    top = lambda df, name: df.orderBy(*order).limit(n).select(F.row_number().over(w).alias("position"), F.col("canonical_url").alias(name))
    return top(left, "expected").join(top(right, "actual"), "position", "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


#: Sort modes whose results stand by their last sighting.
BY_SIGHTING = ("last_seen", "recent", "fresh_source")


def parity_audit(cases: DataFrame, results: DataFrame) -> DataFrame:
    """What is wrong with the answers of several stores to many searches: (case_id, store, kind, canonical_url, position).

    cases: case_id, country, remote, sort_by (blank: not asked for). results: case_id, store, position (from 1), canonical_url, position_name, company_name, country, location_text, remote_type, last_seen_epoch.
    Kinds: no_url, no_title, no_company; wrong_country (another country, or none and the place does not name it), wrong_mode (remote and hybrid cases); out_of_order (seen later than the row before it, where the
    order is by sighting); differs (another posting than the first store in the order of names has at that position, or none). All cases are judged together: their filters are columns.
    """
    rows = results.join(cases, "case_id")
    asked = lambda c: ~is_blank(F.col(c))
    wanted, named = F.lower(F.col("wanted_country")), F.lower(F.coalesce("location_text", F.lit("")))
    rows = rows.withColumn("earlier", F.lag("last_seen_epoch").over(W.partitionBy("case_id", "store").orderBy("position")))
    found = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("canonical_url"), F.lit("")).rlike("(?i)^https?://"), "no_url"), F.when(is_blank(F.col("position_name")), "no_title"), F.when(is_blank(F.col("company_name")), "no_company"),
        F.when(asked("wanted_country") & (F.lower(F.coalesce("country", F.lit(""))) != wanted) & ~(is_blank(F.col("country")) & F.contains(named, wanted)), "wrong_country"),
        F.when(F.col("wanted_remote").isin("remote", "hybrid") & ~F.col("remote_type").eqNullSafe(F.col("wanted_remote")), "wrong_mode"),
        F.when(F.col("sort_by").isin(*BY_SIGHTING) & (F.coalesce("last_seen_epoch", F.lit(0)) > F.coalesce("earlier", F.col("last_seen_epoch"), F.lit(0))), "out_of_order"),
    ))
    faults = rows.select("case_id", "store", F.explode(found).alias("kind"), "canonical_url", "position")
    at = results.select("case_id", "store", "position", "canonical_url")
    named_first = at.withColumn("first", F.col("store") == at.agg(F.min("store")).scalar())
    names = at.agg(F.array_sort(F.collect_set("store"))).scalar()  # of a few stores
    left = named_first.where("first").select("case_id", "position", F.col("canonical_url").alias("expected"), F.explode(F.slice(names, 2, 100)).alias("store"))
    both = left.join(named_first.where("not first"), ["case_id", "store", "position"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("canonical_url")))
    return faults.union(both.select("case_id", "store", F.lit("differs"), "canonical_url", "position"))


def index_repairs(postings: DataFrame, index: DataFrame) -> DataFrame:
    """What to delete from and write to an index (index: canonical_url, company_name), with the reason."""
    both = postings.select("canonical_url", "hidden", "company_name").join(index.select("canonical_url", F.col("company_name").alias("indexed"), F.lit(True).alias("there")), "canonical_url", "full_outer")
    there, known = F.coalesce("there", F.lit(False)), F.col("hidden").isNotNull()
    action = F.when(there & ~known, "delete").when(there & F.col("hidden"), "delete").when(~there & ~F.col("hidden"), "upsert").when(there & ~F.col("company_name").eqNullSafe(F.col("indexed")), "upsert")
    reason = F.when(there & ~known, "absent").when(there & F.col("hidden"), "hidden").when(~there, "missing").otherwise("changed")
    return both.withColumn("action", action).withColumn("reason", reason).where("action is not null").select("canonical_url", "action", "reason")


def shape_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two path arrays with four decimals; two empty ones are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / both, 4))


def prefix_match(value: Column, query: str) -> Column:
    """The value holds the query, or the query's words hit the value's words in order: at a word's start, or inside it from four letters on."""
    tokens = query.split()
    def step(found: Column, word: Column) -> Column:
        out = found
        for i, t in enumerate(tokens):
            hit = F.contains(word, F.lit(t)) if len(t) >= 4 else F.startswith(word, F.lit(t))
            out = F.when((found == i) & hit, i + 1).otherwise(out)
        return out
    met = F.aggregate(F.split(value, r"\s+"), F.lit(0), step)
    return (value != "") & (F.contains(value, F.lit(query)) | ((met == len(tokens)) & F.lit(bool(tokens))))
