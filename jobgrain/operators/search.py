"""Posting search: filters, ranking, pages, summaries and facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import fold, fold_text, is_blank, percent

DAY = 86_400
#: Windows that a freshness filter accepts.
FRESHNESS_DAYS = (3, 7, 30)
#: Words of a location text that tell the work mode where the stored type is unknown.
REMOTE_LOCATION_TERMS = {"remote": ("remote", "work from home", "wfh", "anywhere"), "hybrid": ("hybrid",), "onsite": ("onsite", "on-site", "in office")}
SEARCHED = ("company_name", "position_name", "location_text", "country", "region", "remote_type")
#: Other names of the sort modes.
SORT_ALIASES = {
    "recent": "last_seen", "fresh_source": "last_seen", "lastseen": "last_seen", "posted": "posted_date", "posted_at": "posted_date", "ats": "ats_source",
    "source": "ats_source", "company_asc": "ats_source", "alphabetical": "ats_source", "quality": "confidence", "quality_score": "confidence", "confidence_score": "confidence",
}


@dataclass(frozen=True)
class SearchOptions:
    """What a search asks for. ``tokens`` are alias groups: all groups must match, any alias of a group is enough."""

    ats: tuple[str, ...] = ()
    countries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    regions: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    remote: str = "all"
    require_date: bool = False
    freshness_days: int | None = None
    tokens: tuple[tuple[str, ...], ...] = ()


def contains(c: Column, term: str) -> Column:
    return F.contains(fold(c), F.lit(fold_text(term)))


def country_filter(countries: dict[str, tuple[str, ...]]) -> Column:
    """Stored country equals a term, or it is blank and the location names one."""
    terms = [t for label, aliases in countries.items() for t in (label, *aliases)]
    stored = fold(F.col("country")).isin(*[fold_text(t) for t in terms])
    return stored | (is_blank(F.col("country")) & reduce(or_, [contains(F.col("location_text"), t) for t in terms]))


def remote_unknown() -> Column:
    return is_blank(F.col("remote_type")) | (F.col("remote_type") == "unknown")


def remote_filter(mode: str) -> Column:
    named = lambda *modes: reduce(or_, [contains(F.col("location_text"), t) for m in modes for t in REMOTE_LOCATION_TERMS[m]])
    if mode == "non_remote":
        return ~F.col("remote_type").isin("remote", "hybrid") & ~(remote_unknown() & named("remote", "hybrid"))
    return (F.col("remote_type") == mode) | (remote_unknown() & named(mode))


def search_filter(options: SearchOptions, as_of: int) -> Column:
    """All filters of a search as one predicate over visible postings."""
    parts = [~F.col("hidden")]
    if options.ats:
        parts.append(F.col("ats_key").isin(*options.ats))
    if options.countries:
        parts.append(country_filter(options.countries))
    if options.regions:
        parts.append(F.col("region").isin(*options.regions))
    if options.industries:
        parts.append(F.col("industry").isin(*options.industries))
    if options.remote in ("remote", "hybrid", "onsite", "non_remote"):
        parts.append(remote_filter(options.remote))
    if options.require_date:
        parts.append(~is_blank(F.col("posting_date")))
    if options.freshness_days in FRESHNESS_DAYS:
        parts.append(F.coalesce("last_seen_epoch", F.lit(0)) >= as_of - options.freshness_days * DAY)
    for group in options.tokens:
        parts.append(reduce(or_, [contains(F.col(c), alias) for alias in group for c in SEARCHED]))
    return reduce(and_, parts)


def without_state(postings: DataFrame, state: DataFrame, applied: bool = False, ignored: bool = False) -> DataFrame:
    """Leave out postings that the user applied for or ignores, unless asked to include them."""
    out = [F.col(c) for c, keep in (("applied", applied), ("ignored", ignored)) if not keep]
    return postings.join(state.where(reduce(or_, out)).select("canonical_url").distinct(), "canonical_url", "left_anti") if out else postings


def without_companies(postings: DataFrame, blocked: DataFrame) -> DataFrame:
    """Leave out blocked companies (blocked: company_name)."""
    key = blocked.select(F.lower(F.trim("company_name")).alias("_c")).distinct()
    return postings.withColumn("_c", F.lower(F.trim("company_name"))).join(key, "_c", "left_anti").drop("_c")


def relevance(query: str) -> Column:
    """40 title, 30 company, 20 place, 10 source, 5 description: the first that holds the query."""
    of = lambda *cols: reduce(or_, [contains(F.coalesce(F.col(c), F.lit("")), query) for c in cols])
    return (
        F.when(of("position_name"), 40).when(of("company_name"), 30).when(of("location_text", "city", "country", "region"), 20)
        .when(of("ats_key"), 10).when(of("description_plain"), 5).otherwise(0)
    )


def additive_relevance(query: str) -> Column:
    of = lambda c, n: F.when(contains(F.coalesce(F.col(c), F.lit("")), query), n).otherwise(0)
    return of("position_name", 40) + of("company_name", 30) + of("location_text", 20) + of("ats_key", 10)


def sort_mode(name: str | None) -> str:
    key = "_".join("".join(ch if ch.isalnum() else " " for ch in (name or "").lower()).split())
    key = SORT_ALIASES.get(key, key)
    return key if key in ("last_seen", "posted_date", "ats_source", "confidence") else "relevance"


def order_of(mode: str) -> list[Column]:
    tail = [F.desc("last_seen_epoch"), F.asc("canonical_url")]
    return {
        "posted_date": [F.coalesce("posted_at_epoch", F.lit(0)).desc(), *tail],
        "ats_source": [F.lower("ats_key").asc(), F.lower("company_name").asc(), F.lower("position_name").asc(), *tail],
        "confidence": [F.coalesce("confidence", F.lit(0.0)).desc(), *tail],
    }.get(mode, tail)


def ranked_page(postings: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with its positions: the top rows first, so only a page's worth is ever numbered."""
    top = postings.orderBy(*order).limit(limit + offset)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order))).where(F.col("position") > offset)


def page_bounds(limit: float | None, offset: float | None, most: int = 500, deepest: int = 2000) -> dict[str, int | bool]:
    """Limit and offset within bounds, and whether either was cut."""
    want, skip = int(limit if limit is not None else most), int(offset or 0)
    out = {"limit": max(1, min(most, want)), "offset": max(0, min(deepest, skip))}
    return out | {"limit_capped": want > out["limit"], "offset_capped": skip > out["offset"]}


def hydrate(ranked: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows for a ranked list of URLs (canonical_url, position), in its order, without rows that are gone or hidden."""
    return ranked.join(postings.where(~F.col("hidden")), "canonical_url").orderBy("position")


def result_summary(found: DataFrame) -> DataFrame:
    name = F.trim("company_name")
    return found.agg(
        F.count("*").alias("total"), F.countDistinct(F.when(name != "", name)).alias("companies"), F.countDistinct("ats_key").alias("sources")
    )


def source_facets(found: DataFrame, as_of: int, limit: int = 100) -> DataFrame:
    """Per source: rows, mean confidence and quality score (of rows that have one), newest sighting, share seen in the last three days."""
    fresh = F.count_if(F.coalesce("last_seen_epoch", F.lit(0)) >= as_of - 3 * DAY)
    return (
        found.groupBy("ats_key").agg(
            F.count("*").alias("total"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("avg_confidence"),
            F.round(F.avg(F.col("quality_score").cast("double")), 2).alias("avg_quality"), F.max("last_seen_epoch").alias("newest_seen"), fresh.alias("fresh"),
        )
        .withColumn("fresh_percent", percent(F.col("fresh"), F.col("total"), None)).orderBy(F.desc("total"), "ats_key").limit(limit)
    )


def filter_options(visible: DataFrame) -> DataFrame:
    """Counts of each source, place, region and industry in one pass: (kind, value, detail, total)."""
    sets = visible.groupingSets([["ats_key"], ["country", "region"], ["region"], ["industry"]], "ats_key", "country", "region", "industry").agg(
        F.grouping("ats_key").alias("ga"), F.grouping("country").alias("gc"), F.grouping("region").alias("gr"), F.count("*").alias("total")
    )
    kind = F.when(F.col("ga") == 0, "source").when(F.col("gc") == 0, "country").when(F.col("gr") == 0, "region").otherwise("industry")
    value = F.when(F.col("ga") == 0, F.col("ats_key")).when(F.col("gc") == 0, F.col("country")).when(F.col("gr") == 0, F.col("region")).otherwise(F.col("industry"))
    detail = F.when(F.col("gc") == 0, F.col("region")).otherwise("")
    return sets.select(kind.alias("kind"), value.alias("value"), detail.alias("detail"), "total").where("coalesce(value, '') <> ''")


def suggestions(visible: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Titles, companies and places that hold the query, by count."""
    parts = []
    for kind, column in (("title", "position_name"), ("company", "company_name"), ("location", "location_text")):
        hit = visible.where(contains(F.col(column), query) & ~is_blank(F.col(column)))
        parts.append(hit.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("total")).withColumn("kind", F.lit(kind)))
    every = reduce(DataFrame.unionByName, parts)
    return every.orderBy(F.desc("total"), "kind", "value").limit(limit)
