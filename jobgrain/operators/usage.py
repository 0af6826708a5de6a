"""Search-usage reports over search events."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import public_term, trimmed, user_agent_family
from jobgrain.operators.extract import host_of

#: What a remote filter can be.
REMOTE_MODES = ("all", "remote", "hybrid", "onsite", "non_remote")
BUCKETS = ("zero", "low", "normal", "unknown")


def local_day(events: DataFrame, day: date, zone: str) -> DataFrame:
    """Events of one local calendar day: a half-open range of epoch seconds, also across clock changes."""
    start, end = (int(datetime.combine(d, time(), tzinfo=ZoneInfo(zone)).timestamp()) for d in (day, day + timedelta(days=1)))
    return events.where((F.col("created_epoch") >= start) & (F.col("created_epoch") < end))


def totals_by_type(events: DataFrame) -> DataFrame:
    """Events and distinct non-blank sessions by type, and in total."""
    session = F.nullif(F.trim("anonymous_session_key"), F.lit(""))
    out = events.rollup("event_type").agg(F.grouping("event_type").alias("g"), F.count("*").alias("total"), F.countDistinct(session).alias("sessions"))
    return out.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("event_type")).alias("event_type"), "total", "sessions")


def top_terms(events: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent terms of each type and of all together, with first and last time."""
    rows = events.where(trimmed(F.col("query_normalized")) != "")
    sums = rows.groupingSets([["event_type", "query_normalized"], ["query_normalized"]], "event_type", "query_normalized").agg(
        F.grouping("event_type").alias("g"), F.count("*").alias("total"), F.min("created_epoch").alias("first_seen"), F.max("created_epoch").alias("last_seen")
    )
    named = sums.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("event_type")).alias("event_type"), F.col("query_normalized").alias("term"), "total", "first_seen", "last_seen")
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("total"), "term"))
    return named.withColumn("rank", rank).where(F.col("rank") <= limit)


def result_bucket() -> Column:
    n = F.col("result_count")
    return F.when(n.isNull(), "unknown").when(n == 0, "zero").when(n < 10, "low").otherwise("normal")


def poor_queries(events: DataFrame, bucket: str, limit: int = 10) -> DataFrame:
    """The most frequent searches with no result (zero) or few (low)."""
    rows = events.where((F.col("event_type") == "postings") & (result_bucket() == bucket))
    return rows.groupBy(F.col("query_normalized").alias("term")).agg(F.count("*").alias("total"), F.max("created_epoch").alias("last_seen")).orderBy(F.desc("total"), "term").limit(limit)


def top_values(events: DataFrame, column: str, limit: int = 10) -> DataFrame:
    rows = events.where(trimmed(F.col(column)) != "")
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "value").limit(limit)


def filled(counts: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """Counts for each of a few fixed values, zero where there is none."""
    spine = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return spine.join(counts, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"))


def result_buckets(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("event_type") == "postings")
    return filled(rows.groupBy(result_bucket().alias("bucket")).agg(F.count("*").alias("total")), "bucket", BUCKETS)


def cache_status(events: DataFrame) -> DataFrame:
    """One row: hits, misses, other, and the hit rate with four decimals."""
    is_ = lambda v: F.count_if(F.lower("cache_status") == v)
    out = events.agg(F.count("*").alias("total"), is_("hit").alias("hits"), is_("miss").alias("misses"))
    return out.withColumn("other", F.col("total") - F.col("hits") - F.col("misses")).withColumn("hit_rate", F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 4))


def remote_modes(events: DataFrame) -> DataFrame:
    mode = F.when(F.lower("remote_filter").isin(*REMOTE_MODES), F.lower("remote_filter")).otherwise("all")
    return filled(events.groupBy(mode.alias("mode")).agg(F.count("*").alias("total")), "mode", REMOTE_MODES)


def csv_values(events: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Counts of the single values of a comma-separated column."""
    one = events.select(F.explode(F.split(column, ",")).alias("v")).select(F.trim("v").alias("value")).where("value <> ''")
    return one.groupBy("value").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "value").limit(limit)


def zero_result_rate(events: DataFrame) -> DataFrame:
    """Searches without a result over those with a known count."""
    rows = events.where(F.col("event_type") == "postings")
    out = rows.agg(F.count("*").alias("total"), F.count_if(F.col("result_count") == 0).alias("zero"), F.count("result_count").alias("known"))
    return out.withColumn("zero_rate", F.round(F.try_divide("zero", F.when(F.col("known") > 0, F.col("known")).otherwise(F.col("total"))), 4))


def popular_searches(events: DataFrame, intents: DataFrame, limit: int = 20) -> DataFrame:
    """Searches by intent (intents: alias, intent), filled up with the aliases' own names where too few are known."""
    term = F.lower(trimmed(F.col("query_normalized")))
    counts = events.groupBy(term.alias("alias")).agg(F.count("*").alias("n")).where((F.length("alias") > 1) & (F.size(F.split("alias", " ")) <= 6))
    merged = counts.join(intents, "alias", "left").groupBy(F.coalesce("intent", "alias").alias("intent")).agg(F.sum("n").alias("total"))
    spare = intents.select("intent").distinct().join(merged, "intent", "left_anti").withColumn("total", F.lit(0).cast("long"))
    return merged.unionByName(spare).orderBy(F.desc("total"), "intent").limit(limit)


def daily_sample(postings: DataFrame, since: int, until: int, seed: str, limit: int) -> DataFrame:
    """A repeatable sample of a window's postings: the smallest hashes of seed and URL."""
    rows = postings.where((F.col("first_seen_epoch") >= since) & (F.col("first_seen_epoch") < until) & ~F.col("hidden"))
    return rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("canonical_url")))).orderBy("draw").limit(limit)


def hourly(events: DataFrame) -> DataFrame:
    hour = (F.floor(F.col("created_epoch") / 3600) * 3600).cast("long")
    return events.groupBy(hour.alias("hour_epoch"), "event_type").agg(F.count("*").alias("total"), F.count_if(F.col("result_count") == 0).alias("zero"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def normalised_events(raw: DataFrame) -> DataFrame:
    """Landed search events (event_id, type, query, result_count, countries, country, language, session, referrer, agent: strings) in their stored form."""
    kind = F.trim(F.regexp_replace(F.lower(trimmed(F.col("type"))), "[^a-z0-9]+", "_"), F.lit("_"))
    event_type = F.when(kind.isin("suggest", "search_suggest"), "suggest").when(kind.isin("filter_options", "postings_filter_options"), "filter_options").otherwise("postings")
    count = F.floor(F.trim("result_count").try_cast("double"))
    one = lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 80)
    listed = F.slice(F.filter(F.transform(F.split(F.coalesce("countries", F.lit("")), ","), one), lambda x: x != ""), 1, 20)
    country = F.upper(trimmed(F.col("country")))
    language = F.filter(F.split(F.replace(trimmed(F.col("language")), F.lit("_"), F.lit("-")), "-"), lambda x: x != "")
    primary, region = F.lower(F.try_element_at(language, F.lit(1))), F.upper(F.try_element_at(language, F.lit(2)))
    code = F.when(~F.coalesce(primary.rlike("^[a-z]{2,3}$"), F.lit(False)), "").when(F.coalesce(region.rlike("^[A-Z]{2}$"), F.lit(False)), F.concat_ws("-", primary, region)).otherwise(primary)
    session = F.lower(trimmed(F.col("session")))
    return raw.select(
        "event_id", event_type.alias("event_type"), F.substring(F.regexp_replace(trimmed(F.col("query")), r"\s+", " "), 1, 160).alias("query"),
        F.when(count.isNotNull() & ~F.isnan(count), F.least(F.greatest(count, F.lit(0)), F.lit(2_000_000))).cast("long").alias("result_count"), F.array_join(listed, ",").alias("country_filters"),
        F.when(country.rlike("^[A-Z]{2}$"), country).otherwise("").alias("country_scope"), code.alias("language_code"), F.when(session.rlike("^[a-f0-9]{64}$"), session).otherwise("").alias("anonymous_session_key"),
        F.substring(host_of(F.col("referrer")), 1, 120).alias("referrer_host"), user_agent_family(F.col("agent")).alias("user_agent_family"), public_term(F.col("query")).alias("public_term"),
    )
